"""The registered queries of the trace engine over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigspark.functions import scalar as S
from sigspark.model import TraceSet, from_long, from_long_global, from_wide, trimmed
from sigspark.operators import bus, scopes, search
from sigspark.operators.held import suppress_repeats
from sigspark.timeexpr import INDEX, TS, Expr, all_of, any_of, evaluated, falling, rising, sig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

EVENTS = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> TraceSet:
    """Events: a trace for each user, a signal for each event type."""
    return from_long(table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), "user_id", ["ts", "event_id"], "event_type", "value", "ts")


def orders(spark: SparkSession, d: str) -> TraceSet:
    """Orders: a trace for each customer; price, status and priority."""
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return from_wide(t, "o_custkey", ["o_orderdate", "o_orderkey"], {"price": ("o_totalprice", "real"), "status": ("o_orderstatus", "str"), "priority": ("o_orderpriority", "str")}, "o_orderdate")


def real(name: str) -> Expr:
    return sig(name, "real")


click, error, purchase, signup, view = map(real, EVENTS)

EV = """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id, ts, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
d AS (SELECT trace_id, idx, ts, event_type, value, props, max(idx) OVER (PARTITION BY trace_id) AS max_index, """ + ", ".join(f"coalesce(last_value(CASE WHEN event_type = '{e}' THEN value END IGNORE NULLS) OVER w, 0) AS {e}" for e in EVENTS) + """ FROM ev WINDOW w AS (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, lead(click, 1) OVER t AS click_n1, lead(click, 3) OVER t AS click_n3, lag(click, 1) OVER t AS click_p1, lag(click, 2) OVER t AS click_p2, lead(view, 1) OVER t AS view_n1 FROM d WINDOW t AS (PARTITION BY trace_id ORDER BY idx)) """

# -- metadata ----------------------------------------------------------------------------------------------


@query(EV + "SELECT trace_id, event_type AS name, idx, value FROM ev")
def load_events(spark, d):
    return ev(spark, d).changes.select("trace_id", "name", "idx", F.col("rval").alias("value"))


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS trace_id, event_type AS name FROM events")
def signals_list(spark, d):
    return ev(spark, d).signals.select("trace_id", "name")


@query("SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) - 1 AS max_index FROM events GROUP BY 1")
def max_index(spark, d):
    return ev(spark, d).traces.select("trace_id", "max_index")


@query(EV + "SELECT trace_id, idx, epoch_us(ts) AS ts FROM ev")
def timestamps(spark, d):
    return ev(spark, d).timestamps


# -- values ------------------------------------------------------------------------------------------------


@query(EV + "SELECT trace_id, click AS value FROM d WHERE idx = 20")
def get_at_index(spark, d):
    return search.sample_at(ev(spark, d), "click", 20)


@query(EV + "SELECT trace_id, view AS value FROM d WHERE idx = 3")
def sample_at(spark, d):
    return search.sample_at(ev(spark, d), "view", 3)


@query(EV + "SELECT trace_id, idx, purchase AS value FROM d WHERE idx % 7 = 0")
def asof_get(spark, d):
    s = ev(spark, d)
    return search.samples(s, "purchase", s.timestamps.where("idx % 7 = 0").select("trace_id", "idx"))


@query(EV + "SELECT trace_id, idx, click, view FROM d")
def held_dense(spark, d):
    return search.held_dense(ev(spark, d), "click", "view")


@query(EV + "SELECT trace_id, event_type AS name, idx, coalesce(lead(idx) OVER (PARTITION BY trace_id, event_type ORDER BY idx), (SELECT max(m.idx) FROM ev m WHERE m.trace_id = ev.trace_id) + 1) AS end_idx, value FROM ev")
def intervals(spark, d):
    return ev(spark, d).intervals().where("seq >= 0").select("trace_id", "name", "idx", "end_idx", F.col("rval").alias("value"))


# -- find and count ----------------------------------------------------------------------------------------


@query("WITH o AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders) SELECT CAST(o_custkey AS VARCHAR) AS trace_id, idx FROM o WHERE o_orderstatus = 'F'")
def find_eq(spark, d):
    return search.find_by_trace(orders(spark, d), sig("status", "str") == "F")


@query(EV + "SELECT trace_id, idx FROM d WHERE click <> 0")
def find_neq(spark, d):
    return search.find_by_trace(ev(spark, d), click != 0)


@query(EV + "SELECT trace_id, idx FROM d WHERE click > 40")
def find_gt(spark, d):
    return search.find_by_trace(ev(spark, d), click > 40)


@query(EV + "SELECT DISTINCT idx FROM d WHERE click > 40 ORDER BY idx LIMIT 10")
def find_limit(spark, d):
    return search.find(ev(spark, d), click > 40, 10)


@query(EV + "SELECT DISTINCT idx FROM d WHERE click > 90 AND view > 90")
def find_merged(spark, d):
    return search.find(ev(spark, d), (click > 90) & (view > 90))


@query(EV + "SELECT trace_id, idx FROM d WHERE NOT (click > 40)")
def find_not(spark, d):
    return search.find_by_trace(ev(spark, d), ~(click > 40))


@query(EV + "SELECT DISTINCT d.idx AS step, (SELECT CAST(sum(least(m, d.idx)) AS BIGINT) FROM (SELECT max(idx) AS m FROM ev GROUP BY trace_id)) AS total FROM d WHERE click > 95")
def find_g(spark, d):
    found = search.find_global(ev(spark, d), click > 95)
    return found.select("step", F.aggregate("indices", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(EV + "SELECT trace_id, idx FROM d WHERE idx > 10 AND idx % 2 = 0 AND view > 50")
def find_index_condition(spark, d):
    return search.find_by_trace(ev(spark, d), (INDEX > 10) & (INDEX % 2 == 0) & (view > 50))


@query(EV + "SELECT trace_id, idx FROM d WHERE epoch_us(ts) % 2 = 0 AND view > 50")
def find_time_condition(spark, d):
    return search.find_by_trace(ev(spark, d), (TS % 2 == 0) & (view > 50))


@query(EV + "SELECT count(*) FILTER (WHERE click > 40) AS n0 FROM d")
def count_simple(spark, d):
    return search.count(ev(spark, d), click > 40)


@query(EV + "SELECT count(*) FILTER (WHERE click > 40 AND view > 40) AS n0 FROM d")
def count_and(spark, d):
    return search.count(ev(spark, d), (click > 40) & (view > 40))


@query(EV + "SELECT count(*) FILTER (WHERE click > 80 OR view > 80 OR error > 80) AS n0 FROM d")
def count_or(spark, d):
    return search.count(ev(spark, d), any_of(click > 80, view > 80, error > 80))


@query(EV + "SELECT count(*) FILTER (WHERE (click > view AND NOT (error > 10)) OR purchase + signup > 120) AS n0 FROM d")
def count_mixed(spark, d):
    return search.count(ev(spark, d), ((click > view) & ~(error > 10)) | (purchase + signup > 120))


@query(EV + "SELECT count(*) FILTER (WHERE click < 10) AS n0, count(*) FILTER (WHERE error < 10) AS n1, count(*) FILTER (WHERE purchase < 10) AS n2, count(*) FILTER (WHERE signup < 10) AS n3, count(*) FILTER (WHERE view < 10) AS n4 FROM d")
def count_batch(spark, d):
    return search.count(ev(spark, d), *[real(e) < 10 for e in EVENTS])


@query(EV + "SELECT trace_id, count(*) FILTER (WHERE click > 40) AS n0, count(*) FILTER (WHERE view = 0) AS n1 FROM d GROUP BY trace_id")
def count_by_trace(spark, d):
    return search.count_by_trace(ev(spark, d), click > 40, view == 0)


@query("WITH o AS (SELECT o_custkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders) SELECT count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS n0 FROM o")
def count_orders(spark, d):
    urgent = sig("priority", "str").map(lambda c: c.startswith("1"), "bool")
    return search.count(orders(spark, d), all_of(real("price") > 100000, sig("status", "str") == "O", urgent))


# -- edges and changes -------------------------------------------------------------------------------------


@query(EV + "SELECT trace_id, idx FROM r WHERE click > 40 AND click_p1 <= 40")
def rising_edges(spark, d):
    high = (click > 40).map(lambda c: c.cast("int"), "int")
    return search.find_by_trace(ev(spark, d), rising(high))


@query(EV + "SELECT trace_id, idx FROM r WHERE click <= 40 AND click_p1 > 40")
def falling_edges(spark, d):
    high = (click > 40).map(lambda c: c.cast("int"), "int")
    return search.find_by_trace(ev(spark, d), falling(high))


@query(EV + "SELECT count(*) FILTER (WHERE click > 0) AS n0, count(*) FILTER (WHERE click = 0) AS n1 FROM d")
def high_low(spark, d):
    return search.count(ev(spark, d), click.true(), ~click)


@query(EV + "SELECT trace_id, count(*) AS n0 FROM ev WHERE event_type = 'error' GROUP BY trace_id")
def event_pulse(spark, d):
    s = ev(spark, d)
    ones = s.changes.where("name = 'error'").withColumn("ival", F.lit(1).cast("long"))
    s = TraceSet(s.traces, s.signals, s.timestamps, ones, kind="int", pulses=frozenset({"error"}))
    return search.count_by_trace(s, sig("error") == 1).where("n0 > 0")


@query("WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER w - 1 AS idx, lag(o_orderstatus) OVER w AS was FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT CAST(o_custkey AS VARCHAR) AS trace_id, idx, o_orderstatus AS value FROM o WHERE was IS DISTINCT FROM o_orderstatus")
def change_only(spark, d):
    s = orders(spark, d)
    return suppress_repeats(s.changes.where("name = 'status'").select("trace_id", "idx", F.col("bits").alias("value")), ["trace_id"], "idx", "value")


# -- relative evaluation -----------------------------------------------------------------------------------


@query(EV + "SELECT count(*) FILTER (WHERE click_n3 > 40) AS n0 FROM r")
def reval_next(spark, d):
    return search.count(ev(spark, d), click.at(3) > 40)


@query(EV + "SELECT count(*) FILTER (WHERE click_p2 > 40) AS n0 FROM r")
def reval_prev(spark, d):
    return search.count(ev(spark, d), click.at(-2) > 40)


@query(EV + "SELECT count(*) FILTER (WHERE click_n1 IS NULL OR NOT (click_n1 > 40)) AS n0 FROM r")
def reval_oob_false(spark, d):
    return search.count(ev(spark, d), ~(click > 40).at(1))


@query(EV + "SELECT trace_id, idx FROM r WHERE click > 60 AND error < 50 AND view_n1 > view")
def reval_predicate(spark, d):
    return search.find_by_trace(ev(spark, d), all_of(click > 60, error < 50, view.at(1) > view))


# -- bodies at matches -------------------------------------------------------------------------------------


@query(EV + "SELECT trace_id, idx, click AS a, view + error AS b FROM d WHERE purchase > 90")
def whenever_collect(spark, d):
    return search.whenever(ev(spark, d), purchase > 90, a=click, b=view + error)


@query(EV + "SELECT trace_id, round(sum(view), 2) AS total, max(view) AS largest FROM d WHERE click > 40 GROUP BY trace_id")
def whenever_sum(spark, d):
    return search.whenever(ev(spark, d), click > 40, v=view).groupBy("trace_id").agg(F.round(F.sum("v"), 2).alias("total"), F.max("v").alias("largest"))


@query(EV + "SELECT count(*) FILTER (WHERE click > 40 AND view > 50) AS n0, count(*) FILTER (WHERE click > 40 AND error > 50) AS n1 FROM d")
def whenever_multi(spark, d):
    return search.count(ev(spark, d), (click > 40) & (view > 50), (click > 40) & (error > 50))


# -- folds -------------------------------------------------------------------------------------------------


@query(EV + "SELECT trace_id, round(sum(click), 2) AS value FROM d GROUP BY trace_id")
def fold_sum(spark, d):
    return search.fold_signal(ev(spark, d), "click", "sum").select("trace_id", F.round("value", 2).alias("value"))


@query(EV + "SELECT trace_id, max(click) AS value FROM d GROUP BY trace_id")
def fold_max(spark, d):
    return search.fold_signal(ev(spark, d), "click", "max")


@query(EV + "SELECT trace_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(floor(click) AS BIGINT) ORDER BY idx)), lambda a, x: (a * 31 + x) % 1000003) AS value FROM d GROUP BY trace_id")
def fold_closure(spark, d):
    merge = lambda a, x: ((a * 31 + F.floor(x)) % 1000003).cast("long")
    return search.fold_ordered(ev(spark, d), "click", F.lit(0).cast("long"), merge)


@query(EV + "SELECT trace_id, round(sum(view), 2) AS value FROM d WHERE idx >= 5 GROUP BY trace_id")
def fold_signal(spark, d):
    return search.fold_signal(ev(spark, d), "view", "sum", start=5).select("trace_id", F.round("value", 2).alias("value"))


@query(EV + ", f AS (SELECT trace_id, min(idx) FILTER (WHERE error > 80) AS stop FROM d GROUP BY trace_id) SELECT d.trace_id, max(view) AS value FROM d JOIN f USING (trace_id) WHERE stop IS NULL OR idx < stop GROUP BY d.trace_id")
def fold_signal_stop(spark, d):
    return search.fold_signal(ev(spark, d), "view", "max", error > 80)


# -- cursor and frames -------------------------------------------------------------------------------------


@query(EV + "SELECT count(*) FILTER (WHERE click > 40) AS n0 FROM d WHERE idx BETWEEN 10 AND 29")
def trim_trace(spark, d):
    return search.count(trimmed(ev(spark, d), 10, 29), click > 40)


@query(EV + "SELECT a.idx, a.click AS left_value, coalesce(b.click, last_value(b.click IGNORE NULLS) OVER (ORDER BY a.idx)) AS right_value FROM (SELECT idx, click FROM d WHERE trace_id = (SELECT trace_id FROM (SELECT trace_id, max(idx) AS m FROM ev GROUP BY 1) ORDER BY m DESC, trace_id LIMIT 1)) a LEFT JOIN (SELECT idx, click FROM d WHERE trace_id = (SELECT trace_id FROM (SELECT trace_id, max(idx) AS m FROM ev GROUP BY 1) ORDER BY m, trace_id LIMIT 1)) b ON a.idx = b.idx")
def multi_trace_align(spark, d):
    s = ev(spark, d)
    ends = s.traces.agg(F.min(F.struct(-F.col("max_index"), F.col("trace_id")))["trace_id"].alias("a"), F.min(F.struct("max_index", "trace_id"))["trace_id"].alias("b")).first()
    return search.align(s, ends.a, ends.b, "click")


# -- names -------------------------------------------------------------------------------------------------

NAMES = "WITH names AS (SELECT r_name || '.' || n_name || '.' || c_name AS name, c_acctbal, r_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "


def names(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.concat_ws(".", "r_name", "n_name", "c_name").alias("name"), "c_acctbal", "r_name", "n_name")


@query(NAMES + "SELECT DISTINCT split_part(substr(name, 6), '.', 1) || '.' AS child FROM names WHERE starts_with(name, 'ASIA.')")
def local_scopes(spark, d):
    return scopes.local_scopes(names(spark, d), "ASIA.")


@query("WITH t AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT left(name, length(name) - 6) AS prefix, 0 AS i FROM t WHERE ends_with(name, 'widget') UNION ALL SELECT left(name, length(name) - 4), 1 FROM t WHERE ends_with(name, 'bolt')) SELECT prefix FROM c GROUP BY prefix HAVING count(DISTINCT i) = 2")
def groups(spark, d):
    return scopes.groups(table(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), ["widget", "bolt"])


@query(EV + "SELECT 'click' AS grp, count(*) FILTER (WHERE click > 40) AS n FROM d UNION ALL SELECT 'view', count(*) FILTER (WHERE view > 40) FROM d")
def in_groups_count(spark, d):
    body = scopes.by_group(["click", "view"], lambda p: real(p) > 40)
    n = search.count(ev(spark, d), *body.values())
    return n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("grp"), F.col(f"n{i}").alias("n")) for i, p in enumerate(body)])).alias("r")).select("r.*")


# -- bus ---------------------------------------------------------------------------------------------------

valid, ready = click > 40, view > 20
opcode = error.map(lambda c: F.floor(c / 12.5).cast("long"), "int")


@query(EV + "SELECT trace_id, idx FROM d WHERE click > 40 AND view > 20")
def handshake(spark, d):
    return bus.handshakes(ev(spark, d), valid, ready)


@query(EV + "SELECT count(*) FILTER (WHERE click > 40) AS valid_cycles, count(*) FILTER (WHERE click > 40 AND NOT view > 20) AS stalls, count(*) FILTER (WHERE click > 40 AND view > 20) AS beats, count(*) AS cycles, round(100.0 * count(*) FILTER (WHERE click > 40 AND view > 20) / count(*), 4) AS util_pct FROM d")
def utilisation(spark, d):
    return bus.utilisation(ev(spark, d), valid, ready)


@query(EV + "SELECT trace_id, count(*) FILTER (WHERE click > 40 AND view > 20) AS beats, 8 * count(*) FILTER (WHERE click > 40 AND view > 20) AS bytes, round(8 * count(*) FILTER (WHERE click > 40 AND view > 20) / count(*), 4) AS bytes_per_cycle FROM d GROUP BY trace_id")
def bandwidth(spark, d):
    return bus.bandwidth(ev(spark, d), valid, ready, 8)


@query(EV + ", m AS (SELECT trace_id, CAST(floor(error / 12.5) AS BIGINT) AS opcode, row_number() OVER (PARTITION BY trace_id ORDER BY idx) AS k FROM d WHERE click > 40 AND view > 20) SELECT opcode, count(*) AS n FROM m WHERE k <= 20 GROUP BY opcode")
def opcode_mix_first(spark, d):
    return bus.mix(ev(spark, d), valid & ready, opcode, 20)


@query(EV + ", q AS (SELECT trace_id, idx, click > 40 AS req, view > 60 AS resp FROM d), n AS (SELECT trace_id, idx, req, min(CASE WHEN resp THEN idx END) OVER (PARTITION BY trace_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, count(*) FILTER (WHERE req) OVER (PARTITION BY trace_id ORDER BY idx) AS nth FROM q) SELECT trace_id, count(*) AS samples, min(nxt - idx) AS least, max(nxt - idx) AS largest, CAST(sum(nxt - idx) AS BIGINT) AS total FROM n WHERE req AND nxt IS NOT NULL AND (nth - 1) % 3 = 0 GROUP BY trace_id")
def latency(spark, d):
    return bus.latency(ev(spark, d), click > 40, view > 60, 3)


# -- aggregates, truth, membership -------------------------------------------------------------------------


@query("SELECT doc_id, strlen(text) AS n FROM documents")
def length_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", S.byte_length(F.col("text")).cast("long").alias("n"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 1000) AS BIGINT) <> 0 AS number_true, c_mktsegment <> '' AS text_true FROM customer")
def truthy(spark, d):
    from sigspark.timeexpr import truthy as true

    return table(spark, d, "customer").select("c_custkey", true(F.floor(F.col("c_acctbal") / 1000), "int").alias("number_true"), true(F.col("c_mktsegment"), "str").alias("text_true"))


@query("SELECT p_partkey, list_contains([1, 5, 9, 14, 20], p_size) AS is_in, list_has_all([p_size, 7, 8], [7, 8]) AS has_all FROM part")
def in_list(spark, d):
    return table(spark, d, "part").select("p_partkey", S.contains_all(F.array(*map(F.lit, (1, 5, 9, 14, 20))), F.col("p_size")).alias("is_in"), S.contains_all(F.array("p_size", F.lit(7), F.lit(8)), F.lit(7), F.lit(8)).alias("has_all"))


@query("SELECT p_partkey, contains(p_type, 'BRASS') AS is_in FROM part")
def in_string(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_type").contains("BRASS").alias("is_in"))


# -- scalar functions --------------------------------------------------------------------------------------


@query("SELECT p_partkey, CAST(pow(p_size, 5) AS BIGINT) AS v FROM part")
def pow_int(spark, d):
    return table(spark, d, "part").select("p_partkey", S.power_int(F.col("p_size"), F.lit(5)).alias("v"))


@query("SELECT p_partkey, CAST((p_size - 25) % 7 AS BIGINT) AS v FROM part")
def mod_sign(spark, d):
    return table(spark, d, "part").select("p_partkey", S.modulo(F.col("p_size") - 25, F.lit(7)).alias("v"))


@query("SELECT p_partkey, CAST(round((p_size - 25) / 2) AS BIGINT) AS v FROM part")
def round_half_away(spark, d):
    return table(spark, d, "part").select("p_partkey", S.round_away((F.col("p_size") - 25) / 2).alias("v"))


@query("SELECT p_partkey, (p_partkey >> 2) & 15 AS v, (p_partkey >> 3) & 1 AS b FROM part")
def bit_slice(spark, d):
    return table(spark, d, "part").select("p_partkey", S.bit_slice(F.col("p_partkey"), 5, 2).alias("v"), S.bit_slice(F.col("p_partkey"), 3).alias("b"))


@query("SELECT p_partkey, CAST(list_sum(range(0, p_size, 3)) AS BIGINT) AS up, len(range(p_size, 5, -2)) AS down FROM part")
def range_list(spark, d):
    s = F.col("p_size")
    up = S.integer_range(F.lit(0), s, 3)
    return table(spark, d, "part").select("p_partkey", F.when(F.size(up) > 0, S.total(up)).alias("up"), F.size(S.integer_range(s, F.lit(5), -2)).cast("long").alias("down"))


@query("SELECT p_partkey, substr(p_type, 3, 4) AS part, substr(p_type, 2, 1) AS one FROM part")
def substring(spark, d):
    return table(spark, d, "part").select("p_partkey", S.text_slice(F.col("p_type"), 2, 6).alias("part"), S.text_slice(F.col("p_type"), 1).alias("one"))


@query("SELECT p_partkey, bin(p_partkey) AS b, CASE WHEN length(bin(p_size)) < 8 THEN lpad(bin(p_size), 8, '0') ELSE bin(p_size) END AS w FROM part")
def conv_bin(spark, d):
    return table(spark, d, "part").select("p_partkey", S.to_bin(F.col("p_partkey")).alias("b"), S.to_bin(F.col("p_size"), 8).alias("w"))


@query("SELECT p_partkey, CASE WHEN p_partkey > 0 THEN p_partkey - CAST(pow(2, length(bin(p_partkey))) AS BIGINT) ELSE 0 END AS v FROM part")
def bits_to_sint(spark, d):
    return table(spark, d, "part").select("p_partkey", S.bits_to_signed(F.bin("p_partkey")).alias("v"))


@query("SELECT 'int' AS key_type, 'str' AS name_type, 'float' AS price_type")
def type_name(spark, d):
    kinds = dict(table(spark, d, "part").dtypes)
    return spark.range(1).select(*[F.lit(S.type_name(kinds[c])).alias(n) for c, n in (("p_partkey", "key_type"), ("p_name", "name_type"), ("p_retailprice", "price_type"))])


# -- lists and maps ----------------------------------------------------------------------------------------

SIZES = "WITH l AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity, l_partkey) AS q FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3) "


def sizes(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_quantity", "l_partkey"))).alias("q"))
    return t.where(F.size("q") >= 3).select("l_orderkey", F.transform("q", lambda x: x["l_quantity"]).alias("q"))


@query(SIZES + "SELECT l_orderkey, len(q[2:]) AS n, list_sum(q[2:]) AS total FROM l")
def list_rest(spark, d):
    r = S.rest(F.col("q"))
    return sizes(spark, d).select("l_orderkey", F.size(r).cast("long").alias("n"), F.aggregate(r, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(SIZES + "SELECT l_orderkey, len(q) - 1 AS n, list_sum(list_transform(range(1, len(q)), lambda i: q[i] * q[i + 1])) AS total FROM l")
def list_zip(spark, d):
    z = S.zipped(F.col("q"), S.rest(F.col("q")))
    return sizes(spark, d).select("l_orderkey", F.size(z).cast("long").alias("n"), F.aggregate(z, F.lit(0.0), lambda a, x: a + x[0] * x[1]).alias("total"))


@query(SIZES + "SELECT l_orderkey, list_sum(q[2:3]) AS total FROM l")
def list_slice(spark, d):
    return sizes(spark, d).select("l_orderkey", F.aggregate(S.list_slice(F.col("q"), 1, 3), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(SIZES + "SELECT l_orderkey, list_sum(q) AS total, list_avg(q) AS mean, list_max(q) AS largest, list_min(q) AS least FROM l")
def list_folds(spark, d):
    q = F.col("q")
    return sizes(spark, d).select("l_orderkey", F.aggregate(q, F.lit(0.0), lambda a, x: a + x).alias("total"), S.average(q).alias("mean"), F.array_max(q).alias("largest"), F.array_min(q).alias("least"))


def pairs(spark, d):
    return table(spark, d, "part").select("p_partkey", F.create_map(F.lit("x"), F.col("p_partkey"), F.lit("y"), F.col("p_size").cast("long")).alias("m"))


@query("SELECT p_partkey, 7 AS x, CAST(p_size AS BIGINT) AS y, 3 AS n FROM part")
def map_set(spark, d):
    m = S.with_key(S.with_key(F.col("m"), F.lit("x"), F.lit(7).cast("long")), F.lit("z"), F.lit(1).cast("long"))
    return pairs(spark, d).select("p_partkey", m["x"].cast("int").alias("x"), m["y"].alias("y"), F.size(m).alias("n"))


@query("SELECT p_partkey, p_partkey AS x, CAST(5 AS BIGINT) AS z FROM part")
def map_get_default(spark, d):
    five = F.lit(5).cast("long")
    return pairs(spark, d).select("p_partkey", S.at_key(F.col("m"), F.lit("x"), five).alias("x"), S.at_key(F.col("m"), F.lit("z"), five).alias("z"))


@query("SELECT p_partkey, 1 AS n, false AS has_x FROM part")
def map_del(spark, d):
    m = S.without_key(F.col("m"), F.lit("x"))
    return pairs(spark, d).select("p_partkey", F.size(m).alias("n"), F.map_contains_key(m, "x").alias("has_x"))


# -- control -----------------------------------------------------------------------------------------------


@query(EV + "SELECT trace_id, idx FROM d WHERE click > 40 INTERSECT SELECT trace_id, idx FROM d WHERE view > 40")
def intersect_idx(spark, d):
    s = ev(spark, d)
    return search.find_by_trace(s, click > 40).intersect(search.find_by_trace(s, view > 40))


@query(EV + "SELECT trace_id, idx FROM d EXCEPT SELECT trace_id, idx FROM d WHERE view > 40")
def except_idx(spark, d):
    s = ev(spark, d)
    return s.timestamps.select("trace_id", "idx").subtract(search.find_by_trace(s, view > 40))


@query(EV + "SELECT trace_id, event_type, idx, row_number() OVER (PARTITION BY trace_id, event_type ORDER BY idx) AS nth FROM ev")
def nth_change(spark, d):
    s = ev(spark, d)
    return s.changes.select("trace_id", F.col("name").alias("event_type"), "idx", F.row_number().over(Window.partitionBy("trace_id", "name").orderBy("idx")).cast("long").alias("nth"))


# -- one trace over all rows, dumps, the language ----------------------------------------------------------

EVG = """WITH ev AS (SELECT event_type, floor(value) AS value, epoch_us(ts) AS ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events),
d AS (SELECT idx, ts, """ + ", ".join(f"coalesce(last_value(CASE WHEN event_type = '{e}' THEN value END IGNORE NULLS) OVER w, 0) AS {e}" for e in EVENTS) + """ FROM ev WINDOW w AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) """


def evg(spark: SparkSession, d: str) -> TraceSet:
    """Events: one trace of all users, whole values."""
    t = table(spark, d, "events").select("event_id", "ts", "event_type", F.floor("value").alias("value"))
    return from_long_global(t, "all", ["ts", "event_id"], "event_type", "value", "ts", "int", 1000)


@query(EVG + "SELECT count(*) FILTER (WHERE click > 40 AND view > 40) AS n0, count(*) FILTER (WHERE error = 0) AS n1 FROM d")
def count_global(spark, d):
    return search.count(evg(spark, d), (sig("click") > 40) & (sig("view") > 40), sig("error") == 0)


@query(EVG + "SELECT idx FROM (SELECT idx, click, lag(click) OVER (ORDER BY idx) AS was FROM d) WHERE click > 90 AND was <= 90")
def find_global_edges(spark, d):
    high = (sig("click") > 90).map(lambda c: c.cast("int"), "int")
    return search.find(evg(spark, d), rising(high))


@query(EVG + "SELECT 'top.' || event_type AS name, idx, CAST(value AS BIGINT) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY idx) AS was FROM ev) WHERE was IS DISTINCT FROM value")
def vcd_roundtrip(spark, d):
    """Written as a dump and read back: every change of value, at its index."""
    from sigspark.sources.sink import vcd_lines, write_vcd
    from sigspark.sources.vcd import read_vcd
    from sigspark.storage import shared_folder

    s = evg(spark, d)
    path = f"{shared_folder(spark, 'dump')}/all.vcd"
    values = s.changes.select("idx", "name", F.bin("ival").alias("bits"))
    write_vcd(vcd_lines(values, s.timestamps.select("idx", "ts"), [(e, 64, "integer") for e in EVENTS]), path)
    return read_vcd(spark, path).changes.select("name", "idx", F.col("ival").alias("value"))


PROGRAM = """
(defun high [x] (> x 40))
(defmacro both [a b] `(&& ,a ,b))
(define n 0)
(whenever (high click) (if (= view@1 error) (set! n (+ n click))))
(list (count (both (high click) (high view))) (length (find (!= click@-1 click))) n (first (find (> purchase 90) 1)))
"""


@query(EVG + ", r AS (SELECT *, lead(view) OVER (ORDER BY idx) AS view_n1, lag(click) OVER (ORDER BY idx) AS click_p1 FROM d) SELECT count(*) FILTER (WHERE click > 40 AND view > 40) AS a, count(*) FILTER (WHERE click_p1 IS DISTINCT FROM click) AS b, CAST(coalesce(sum(CASE WHEN click > 40 AND view_n1 = error THEN click END), 0) AS BIGINT) AS c, min(CASE WHEN purchase > 90 THEN idx END) AS d FROM r")
def lang_eval(spark, d):
    """A program of functions, macros, searches and updates over the trace of all events."""
    from sigspark.lang.interp import Interpreter
    from sigspark.session import Session

    run = Interpreter(Session(spark))
    run.session.attach("all", evg(spark, d).cached())
    return spark.createDataFrame([tuple(run.run(PROGRAM))], "a long, b long, c long, d long")


def evs(spark: SparkSession, d: str) -> TraceSet:
    """Events as one trace whose signals lie in scopes: top.io for click and view, top.core for the others."""
    name = F.concat(F.when(F.col("event_type").isin("click", "view"), "top.io.").otherwise("top.core."), "event_type")
    t = table(spark, d, "events").select("event_id", "ts", name.alias("event_type"), F.floor("value").alias("value"))
    return from_long_global(t, "all", ["ts", "event_id"], "event_type", "value", "ts", "int", 1000)


def program(spark: SparkSession, d: str, code: str, schema: str, setup: Callable | None = None) -> DataFrame:
    """One row: the list that a program over the scoped trace ends with."""
    from sigspark.lang.interp import Interpreter
    from sigspark.session import Session

    run = Interpreter(Session(spark))
    run.session.attach("all", evs(spark, d).cached())
    if setup:
        setup(run)
    return spark.createDataFrame([tuple(run.run(code))], schema)


@query(EVG + "SELECT count(DISTINCT event_type) AS a, count(DISTINCT event_type) AS b, CAST(bool_or(event_type = 'click') AS BIGINT) AS c, CAST(bool_or(event_type = 'nothing') AS BIGINT) AS d, 64 AS e, 1 AS f, max(idx) AS g, 1 AS h, 'all' AS i, string_agg(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN 'top.io.' ELSE 'top.core.' END || event_type, ' ' ORDER BY CASE WHEN event_type IN ('click', 'view') THEN 'top.io.' ELSE 'top.core.' END || event_type) AS j FROM ev")
def lang_metadata(spark, d):
    code = """(list (length SIGNALS) (length SIGNALS-NO-ALIAS) (if (signal? 'top.io.click) 1 0) (if (signal? "click") 1 0) (signal-width 'top.io.view) (signal-width 'nothing) MAX-INDEX (length (loaded-traces)) TRACE-NAME
      (fold (fn [a x] (if (= a "") x (+ a " " x))) "" (SIGNALS "all")))"""
    return program(spark, d, code, "a long, b long, c long, d long, e int, f int, g long, h int, i string, j string")


@query(EVG + "SELECT 7 AS a, (SELECT CAST(click AS BIGINT) FROM d WHERE idx = 7) AS b, (SELECT ts FROM ev WHERE idx = 7) AS c, 0 AS e, CAST((SELECT max(idx) FROM ev) >= 100000000 AS INT) AS f, 0 AS g, (SELECT CAST(view AS BIGINT) FROM d WHERE idx = 20) AS h, (SELECT CAST(click AS BIGINT) FROM d WHERE idx = 33) AS i, (SELECT CAST(click AS BIGINT) FROM d WHERE idx = 5) AS j, (SELECT CAST(error AS BIGINT) FROM d WHERE idx = 2) AS k")
def lang_cursor(spark, d):
    code = """(step 7) (define a INDEX) (define b (get "top.io.click")) (define c TS) (step -100) (define e INDEX) (define f (if (step 100000000) 1 0)) (define h (timeframe (step 20) (get "view")))
      (list a b c e f INDEX h (sample-at 'click 33) (reval click 5) error@2)"""
    return program(spark, d, code, "a int, b long, c long, e int, f int, g int, h long, i long, j long, k long")


@query(EVG + "SELECT count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view')) AS a, 2 AS b, 'core. io.' AS c, (SELECT count(*) FROM d WHERE click > 40) AS e, 'top.io.' AS f, '3 2' AS g, '' AS h, (SELECT count(*) FROM d WHERE error > 60) AS i FROM ev")
def lang_scopes(spark, d):
    code = """(defun joined [l] (fold (fn [a x] (if (= a "") (+ "" x) (+ a " " x))) "" l))
      (define a (in-scope "top.io." (length LOCAL-SIGNALS))) (define g (joined (all-scopes (length LOCAL-SIGNALS)))) (define f (in-scopes '("top.core." "top.io.") CS))
      (set-scope "top.") (define c (joined LOCAL-SCOPES)) (unset-scope)
      (list a (length SCOPES) c (in-scope "top.io." (count (> ~click 40))) f g CS (scoped "top.core." (count (> error 60))))"""
    return program(spark, d, code, "a long, b int, c string, e long, f string, g string, h string, i long")


@query(EVG + "SELECT 'top.io.' AS a, (SELECT count(*) FROM d WHERE view > 40) AS b, (SELECT CAST(error AS BIGINT) FROM d WHERE idx = 50) AS c, (SELECT CAST(click AS BIGINT) FROM d WHERE idx = 50) AS e, 'top.io.' AS f, 5 AS g")
def lang_groups(spark, d):
    code = """(define g (groups "click" "view")) (define b (in-groups g (count (> #view 40)))) (define f (in-groups g CG)) (define top.seen 5)
      (list (first g) b (in-group "top.core." (timeframe (step 50) #error)) (in-group "top.io." (timeframe (step 50) (resolve-group "click"))) f (in-scope "top." (resolve-scope seen)))"""
    return program(spark, d, code, "a string, b long, c long, e long, f string, g int")


@query(EVG + "SELECT (SELECT CAST(purchase AS BIGINT) FROM d WHERE idx = 40) AS a, count(*) FILTER (WHERE signup > 50) AS b, count(*) FILTER (WHERE click > 40) AS c, 0 AS e, count(*) FILTER (WHERE view > 90) AS f FROM d")
def lang_names(spark, d):
    code = """(step 40) (define a (get "core.purchase")) (step -40) (define b (count (> (get "signup") 50))) (alias pressed top.io.click) (define c (count (> pressed 40))) (unalias pressed)
      (list a b c (if (defined? 'pressed) 1 0) (count (> top.io.view 90)))"""
    return program(spark, d, code, "a long, b long, c long, e int, f long")


@query(EVG + ", n AS (SELECT count(*) FILTER (WHERE click > 40) AS n FROM d) SELECT n + 2 AS a, CASE n % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'default' END AS b, CASE WHEN n < 10 THEN 'small' WHEN n < 1000 THEN 'middle' ELSE 'large' END AS c, CASE WHEN n > 5 THEN n END AS e, CASE WHEN n <= 5 THEN n END AS f, (SELECT count(*) FROM d WHERE idx BETWEEN 1 AND 30 AND click > 40) AS g, n * n AS h, n + 1 AS i, 3 * n AS j, n - 1 AS k, 9 AS l, '(if (> x 0) (do (print x) (print x)) nil)' AS m, 2 * n AS o, 0 AS p FROM n")
def lang_control(spark, d):
    from sigspark.lang.reader import show

    code = """(define n (count (> click 40))) (define h 0) (define i 0)
      (timeframe (while (< i 30) (do (step 1) (set! i INDEX) (when (> (get "click") 40) (set! h (+ h 1))))))
      (defmacro twice-if [c a] `(if ,c (do ,a ,a) nil)) (defun sq [x] (* x x)) (define total 0) (for/list (x (list 2 3 4)) (set! total (+ total x)))
      (defmacro unless2 [c a] (let ([v (gensym)]) `(let ([,v ,c]) (if ,v 0 ,a))))
      (list (let ([a n] [b 2]) (+ a b)) (case (mod n 3) [0 "zero"] [1 "one"] [default "default"]) (cond [(< n 10) "small"] [(< n 1000) "middle"] [else "large"]) (when (> n 5) n) (unless (> n 5) n)
        h (call 'sq n) ((fn [x] (+ x 1)) n) (eval (parse "(* 3 n)")) (eval '(- n 1)) total (macroexpand '(twice-if (> x 0) (print x))) (twice-if #t (* 2 n)) (unless2 #t 1))"""
    from sigspark.lang.interp import Interpreter
    from sigspark.session import Session

    run = Interpreter(Session(spark))
    run.session.attach("all", evs(spark, d).cached())
    out = run.run(code)
    return spark.createDataFrame([tuple(show(x) if k == 11 else x for k, x in enumerate(out))], "a long, b string, c string, e long, f long, g long, h long, i long, j long, k long, l long, m string, o long, p int")


@query(EVG + ", n AS (SELECT count(*) FILTER (WHERE click > 40) AS n, count(*) FILTER (WHERE view > 70) AS m FROM d) SELECT n + m + 3 AS a, n - m AS b, -n AS c, n * m * 2 AS e, n / 4 AS f, CAST(floor(n / 4) AS BIGINT) AS g, CAST(ceil(n / 4) AS BIGINT) AS h, CAST(round(n / 4) AS BIGINT) AS i, abs(m - n) AS j, n | m AS k, n & m AS l, xor(n, m) AS o, (m - n) % 7 AS p, pow(n % 10, 3) :: BIGINT AS q, n % 10 AS r, (n > m) :: INT AS s, (n = m) :: INT AS t, n + 0.5 AS u FROM n")
def lang_math(spark, d):
    code = """(define n (count (> click 40))) (define m (count (> view 70)))
      (list (+ n m 3) (- n m) (- n) (* n m 2) (/ n 4) (floor (/ n 4)) (ceil (/ n 4)) (round (/ n 4)) (abs (- m n)) (bor n m) (band n m) (bxor n m) (mod (- m n) 7) (** (mod n 10) 3) (length (range (mod n 10))) (if (> n m) 1 0) (if (= n m) 1 0) (+ n 0.5))"""
    return program(spark, d, code, "a long, b long, c long, e long, f double, g long, h long, i long, j long, k long, l long, o long, p long, q long, r long, s int, t int, u double")


@query(EVG + ", n AS (SELECT count(*) FILTER (WHERE click > 40) AS n FROM d) SELECT 'n=' || n || 'x' AS a, substr(n || 'abcdef', 2, 3) AS b, n AS c, n || '' AS e, n || '.5' AS f, bin(n) AS g, n - CAST(pow(2, length(bin(n))) AS BIGINT) AS h, '<class ''int''>' AS i, '<class ''str''>' AS j, 1 AS k, 0 AS l, 1 AS m, 1 AS o, length('' || n) AS p, '(1 \"a\" b nil)' AS q FROM n")
def lang_text(spark, d):
    from sigspark.lang.interp import Interpreter
    from sigspark.lang.reader import show
    from sigspark.session import Session

    code = """(define n (count (> click 40))) (define s (int->string n))
      (list (string-append "n=" n 'x) (slice (+ s "abcdef") 1 4) (string->int s) (symbol->string (string->symbol s)) (int->string (+ n 0.5)) (convert/bin n) (bits->sint (convert/bin n)) (type n) (type s)
        (if (&& (int? n) (string? s) (symbol? 'n) (list? ())) 1 0) (if (atom? (list n)) 1 0) (if (null? ()) 1 0) (if (empty? ()) 1 0) (length s) (list 1 "a" 'b nil))"""
    run = Interpreter(Session(spark))
    run.session.attach("all", evs(spark, d).cached())
    out = run.run(code)
    return spark.createDataFrame([tuple(show(x) if k == 14 else x for k, x in enumerate(out))], "a string, b string, c long, e string, f string, g string, h long, i string, j string, k int, l int, m int, o int, p int, q string")


@query(EVG + ", f AS (SELECT idx, row_number() OVER (ORDER BY idx) AS k, row_number() OVER (ORDER BY idx DESC) AS r FROM d WHERE purchase > 90) SELECT min(idx) FILTER (WHERE k = 1) AS a, min(idx) FILTER (WHERE k = 2) AS b, min(idx) FILTER (WHERE k = 3) AS c, min(idx) FILTER (WHERE r = 1) AS e, count(*) - 1 AS f, CAST(sum(2 * idx + 1) AS BIGINT) AS g, CAST(sum(idx) AS BIGINT) AS h, max(idx) AS i, min(idx) AS j, avg(idx) AS k, CAST(sum(idx) FILTER (WHERE k IN (2, 3)) AS BIGINT) AS l, 1 AS m, CAST(sum(idx * k) AS BIGINT) AS o, CAST(sum(-idx) AS BIGINT) AS p, count(*) AS q FROM f")
def lang_lists(spark, d):
    code = """(define f (find (> purchase 90))) (define z (zip f (range 1 (+ 1 (length f)))))
      (list (first f) (second f) (third f) (last f) (length (rest f)) (sum (map (fn [x] (+ 1 (* 2 x))) f)) (fold + 0 f) (max f) (min f) (average f) (sum (slice f 1 3)) (if (in (second f) f) 1 0)
        (fold (fn [a p] (+ a (* (first p) (second p)))) 0 z) (sum (for/list (x f) 0 (- x))) (length (map + f f)))"""
    return program(spark, d, code, "a long, b long, c long, e long, f long, g long, h long, i long, j long, k double, l long, m int, o long, p long, q long")


@query(EVG + ", n AS (SELECT count(*) FILTER (WHERE click > 40) AS n FROM d) SELECT n AS a, 7 AS b, n + 7 AS c, 5 AS e, 2 AS f, 2 * n AS g, 1 AS h FROM n")
def lang_maps(spark, d):
    from sigspark.lang.interp import LangError

    def setup(run):
        try:
            run.run('(define missing 0) (geta (array "x" 1) "y")')
        except LangError:
            run.run("(set! missing 1)")

    code = """(define n (count (> click 40))) (define m (array ["x" n] ["y" 2])) (define k (seta m "y" 7))
      (list (geta m "x") (geta k "y") (+ (geta (dela k "y") "x") (geta k "y")) (geta/default m 5 "z") (geta m "y") (geta (mapa m (fn [v] (* 2 v))) "x") missing)"""
    return program(spark, d, code, "a long, b long, c long, e int, f int, g long, h int", setup)


@query(EVG + "SELECT count(*) FILTER (WHERE click + view > 100) AS a, 1 AS b, (SELECT CAST(click + view AS BIGINT) FROM d WHERE idx = 12) AS c FROM d")
def lang_virtual(spark, d):
    code = """(defsig both (+ click view)) (list (count (> both 100)) (length VIRTUAL-SIGNALS) (timeframe (step 12) both))"""
    return program(spark, d, code, "a long, b int, c long")


@query(EVG + ", v AS (SELECT idx, CAST(click + view > 100 AS BIGINT) AS b FROM d) SELECT 'top.hot' AS name, idx, b AS value FROM (SELECT *, lag(b) OVER (ORDER BY idx) AS was FROM v) WHERE was IS DISTINCT FROM b")
def dump_trace(spark, d):
    """A virtual signal written as a dump and loaded again."""
    from sigspark.lang.interp import Interpreter
    from sigspark.session import Session
    from sigspark.storage import shared_folder

    run = Interpreter(Session(spark))
    run.session.attach("all", evs(spark, d).cached())
    path = f"{shared_folder(spark, 'virtual')}/hot.vcd"
    run.run(f'(defsig hot (> (+ click view) 100)) (dump-trace "{path}") (load "{path}" "v")')
    return run.session.traces["v"].data.changes.select("name", "idx", F.col("ival").alias("value"))


@query(EVG + "SELECT (SELECT CAST(sum(view) AS BIGINT) FROM d WHERE idx < 60) AS a, (SELECT CAST(max(view) AS BIGINT) FROM d WHERE idx BETWEEN 10 AND 59) AS b, (SELECT CAST(sum(click) FILTER (WHERE error > 50) AS BIGINT) FROM d) AS c, (SELECT max(idx) FROM d WHERE signup > 90) AS e")
def lang_folds(spark, d):
    code = """(define c 0) (whenever (> error 50) (set! c (+ c click))) (define e (whenever (> signup 90) INDEX))
      (list (fold/signal + 0 (= INDEX 60) 'view) (timeframe (step 10) (fold/signal max 0 (= INDEX 60) 'view)) c e)"""
    return program(spark, d, code, "a long, b long, c long, e long")


@query(EVG + "SELECT 2 AS a, 4 AS b, 'all n' AS c, 'n' AS e, count(*) FILTER (WHERE idx BETWEEN 10 AND 29 AND click > 40) AS f, 19 AS g FROM d")
def lang_traces(spark, d):
    code = """(new-trace 'n 5) (define a (length (loaded-traces))) (define c (+ (first (loaded-traces)) " " (second (loaded-traces)))) (define b (MAX-INDEX "n")) (trim-trace "all" 10 29) (define f (count (> click 40))) (define g (MAX-INDEX "all")) (unload "all")
      (list a b c TRACE-NAME f g)"""
    return program(spark, d, code, "a int, b int, c string, e string, f long, g int")


@query(EVG + "SELECT count(*) FILTER (WHERE click > 40) AS a, count(*) FILTER (WHERE click > 40) + 1 AS b, 3 AS c, 'a1 002a 3.14 101' AS e FROM d")
def lang_files(spark, d):
    """Scripts from files, and formatted output."""
    import tempfile
    from pathlib import Path

    from sigspark.lang.builtins import formatted

    with tempfile.TemporaryDirectory() as folder:  # read on the driver only
        Path(folder, "lib.lisp").write_text("(define one 1) ; a comment\n(define hits (count (> click 40)))\n(define three (+ one 2))\n")
        code = f"""(eval-file "{folder}/lib.lisp") (define b (+ hits one)) (require lib) (list hits b three)"""
        row = program(spark, d, code, "a long, b long, c int", lambda run: setattr(run, "path", [folder])).first()
    text = formatted("a%d %04x %.2f %b", [1, 42, 3.14159, 5])
    return spark.createDataFrame([(*row, text)], "a long, b long, c int, e string")


def _dump(spark: SparkSession, d: str, compression: str = "none") -> str:
    from sigspark.sources.sink import vcd_lines
    from sigspark.storage import shared_folder

    s = evg(spark, d)
    path = f"{shared_folder(spark, 'dump')}/all.vcd"
    lines = vcd_lines(s.changes.select("idx", "name", F.bin("ival").alias("bits")), s.timestamps.select("idx", "ts"), [(e, 64, "integer") for e in EVENTS])
    lines.orderBy("idx", "place").select("value").write.option("compression", compression).text(path)
    return path


CHANGED = "SELECT 'top.' || event_type AS name, idx, CAST(value AS BIGINT) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY idx) AS was FROM ev) WHERE was IS DISTINCT FROM value"


@query(EVG + CHANGED)
def gz_dump(spark, d):
    """A dump of gzip parts."""
    from sigspark.sources.vcd import read_vcd

    return read_vcd(spark, _dump(spark, d, "gzip")).changes.select("name", "idx", F.col("ival").alias("value"))


@query(EVG + CHANGED)
def fst_roundtrip(spark, d):
    """A dump converted to a binary dump, and that read back: the binary writer and reader."""
    from pathlib import Path
    from urllib.parse import urlparse

    from sigspark.sources.fst import read_fst, vcd_to_fst
    from sigspark.storage import shared_folder

    folder = Path(urlparse(shared_folder(spark, "binary")).path)  # the binary reader needs a path that driver and executors open
    folder.mkdir(parents=True)
    vcd_to_fst(spark, _dump(spark, d), str(folder / "all.fst"), repeats=True)  # events of equal times are indices of their own
    s = read_fst(spark, str(folder / "all.fst"))
    w = Window.partitionBy("name").orderBy("idx")
    rows = s.changes.where("bits not rlike '[^01]'").select("name", "idx", F.col("ival").alias("value"))
    return rows.withColumn("was", F.lag("value").over(w)).where("not (was <=> value)").drop("was")


@query("WITH k AS (SELECT event_type, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events WHERE event_type IN ('click', 'view', 'error')), b AS (SELECT idx, 'top.' || event_type AS name, CASE event_type WHEN 'click' THEN CAST(CAST(value > 50 AS INT) AS VARCHAR) WHEN 'error' THEN CASE WHEN CAST(floor(value) AS INT) % 5 = 0 THEN 'xz1' ELSE bin(CAST(floor(value) AS BIGINT)) END ELSE CAST(floor(value) AS BIGINT) || '.5' END AS t FROM k), c AS (SELECT *, lag(t) OVER (PARTITION BY name ORDER BY idx) AS was FROM b) SELECT name, idx, CASE WHEN name = 'top.view' THEN NULL ELSE t END AS bits, CASE WHEN name = 'top.view' THEN 0 WHEN t = 'xz1' THEN 1 ELSE CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(x AS BIGINT) FOR x IN string_split(t, '')]), lambda a, x: 2 * a + x) AS BIGINT) END AS ival, CASE WHEN name = 'top.view' OR t = 'xz1' THEN NULL ELSE CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(x AS BIGINT) FOR x IN string_split(t, '')]), lambda a, x: 2 * a + x) AS BIGINT) END AS strict FROM c WHERE was IS DISTINCT FROM t".replace("CAST(x AS BIGINT) FOR", "CASE WHEN x = '1' THEN 1::BIGINT ELSE 0::BIGINT END FOR"))
def vcd_kinds(spark, d):
    """Scalars, vectors with unknown bits and reals through a dump."""
    from sigspark.sources.sink import vcd_lines, write_vcd
    from sigspark.sources.vcd import read_vcd
    from sigspark.storage import shared_folder

    t = table(spark, d, "events").where("event_type in ('click', 'view', 'error')").select("event_id", "ts", "event_type", "value")
    s = from_long_global(t, "all", ["ts", "event_id"], "event_type", "value", "ts", "real", 1000)
    whole = F.floor("rval").cast("long")
    bits = F.when(F.col("name") == "click", (F.col("rval") > 50).cast("int").cast("string")).when(F.col("name") == "error", F.when(whole % 5 == 0, "xz1").otherwise(F.bin(whole))).otherwise(F.concat(whole.cast("string"), F.lit(".5")))
    path = f"{shared_folder(spark, 'kinds')}/all.vcd"
    write_vcd(vcd_lines(s.changes.select("idx", "name", bits.alias("bits")), s.timestamps.select("idx", "ts"), [("click", 1, "wire"), ("error", 8, "wire"), ("view", 64, "real")]), path)
    return read_vcd(spark, path).changes.select("name", "idx", "bits", "ival", F.col("ival_strict").alias("strict"))


@query(EVG + ", c AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY idx) AS was FROM ev) SELECT event_type AS name, idx, lead(idx) OVER (PARTITION BY event_type ORDER BY idx) AS end_idx, CAST(CAST(value AS BIGINT) AS VARCHAR) AS value FROM c WHERE was IS DISTINCT FROM value")
def convert_stream(spark, d):
    """Changes that arrive in a folder, converted to intervals by a stream; run again, it goes on."""
    from sigspark.storage import shared_folder
    from sigspark.streaming.live import convert, converted

    root = shared_folder(spark, "live")
    changes = evg(spark, d).changes.select("trace_id", "name", "idx", F.col("ival").cast("string").alias("value"))
    half = changes.agg(F.floor(F.avg("idx"))).first()[0]
    for part in (f"idx < {half}", f"idx >= {half}"):
        changes.where(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        convert(spark, f"{root}/in", f"{root}/out", f"{root}/state")
    return converted(spark, f"{root}/out").select("name", "idx", "end_idx", "value")


@query("SELECT 'test.sig' || i AS name, (SELECT count(*) FROM range(1, n + 1) r(t) WHERE (t + i) % 2 = 1) AS ones FROM (SELECT count(*) AS n FROM region), range(1, 4) s(i)")
def generated_dump(spark, d):
    """The generator's dump of as many times as there are regions."""
    from sigspark.sources import synthetic
    from sigspark.sources.vcd import read_vcd
    from sigspark.storage import shared_folder

    path = f"{shared_folder(spark, 'toggle')}/all.vcd"
    synthetic.write_toggle(spark, path, 3, table(spark, d, "region").count())
    n = search.count(read_vcd(spark, path), *[sig(f"test.sig{i}") == 1 for i in (1, 2, 3)])
    return n.select(F.explode(F.array(*[F.struct(F.lit(f"test.sig{i}").alias("name"), F.col(f"n{i - 1}").alias("ones")) for i in (1, 2, 3)])).alias("r")).select("r.*")
