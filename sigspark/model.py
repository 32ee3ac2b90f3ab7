"""Traces as DataFrames: signals, time axis, value changes; adapters from ordinary tables.

A trace has a dense integer axis of indices. A signal holds its last value until the next change, so all
questions about values reduce to half-open intervals of indices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sigspark.operators.held import hold
from sigspark.operators.indexing import global_index

TRACES = "trace_id string, file string, load_order int, timescale_exp int, version string, date string, max_index bigint"
SCOPES = "trace_id string, path string, parent string, kind string, depth int"
SIGNALS = "trace_id string, sig_id int, name string, short string, scope string, width int, var_type string, id_code string, is_event boolean, decl_order int"
TIMESTAMPS = "trace_id string, idx bigint, ts bigint"
CHANGES = "trace_id string, sig_id int, name string, idx bigint, ts bigint, seq bigint, bits string, ival bigint, ival_strict bigint, rval double"

#: Value column by kind of signal.
VALUE = {"int": "ival", "real": "rval", "str": "bits"}


@dataclass
class TraceSet:
    """Traces with the same kinds of signals.

    kinds: signal -> int, real or str; a signal not named is `kind`. bucket: indices to a bucket where one trace can be
    large, so that fills and leads don't run in one task; None where traces are many and small. pulses: the event signals.
    """

    traces: DataFrame
    signals: DataFrame
    timestamps: DataFrame
    changes: DataFrame
    scopes: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)
    kind: str = "int"
    bucket: int | None = None
    pulses: frozenset[str] = frozenset()
    #: changes, and a quicker way to those of some signals, where the source has one.
    pick: tuple[DataFrame, Callable[[list[str]], DataFrame]] | None = None

    def of(self, *names: str) -> DataFrame:
        """The changes of some signals."""
        own = self.pick[1](list(names)) if self.pick and self.pick[0] is self.changes else self.changes
        return own.where(F.col("name").isin(*names))

    def value(self, name: str) -> str:
        return VALUE[self.kinds.get(name, self.kind)]

    def union(self, other: TraceSet) -> TraceSet:
        """Both sets' traces, as after loading one after the other."""
        scopes = self.scopes.unionByName(other.scopes) if self.scopes is not None and other.scopes is not None else self.scopes or other.scopes
        both = [x for x in (self.bucket, other.bucket) if x]
        return TraceSet(self.traces.unionByName(other.traces, True), self.signals.unionByName(other.signals, True), self.timestamps.unionByName(other.timestamps, True), self.changes.unionByName(other.changes, True), scopes, self.kinds | other.kinds, self.kind, min(both, default=None), self.pulses | other.pulses)

    def without(self, trace_id: str) -> TraceSet:
        """The set after unloading a trace; an unknown id changes nothing."""
        keep = lambda df: None if df is None else df.where(~F.col("trace_id").eqNullSafe(F.lit(trace_id)))
        return replace(self, **{n: keep(getattr(self, n)) for n in ("traces", "signals", "timestamps", "changes", "scopes")})

    def only(self, trace_id: str) -> TraceSet:
        keep = lambda df: None if df is None else df.where(F.col("trace_id") == trace_id)
        return replace(self, **{n: keep(getattr(self, n)) for n in ("traces", "signals", "timestamps", "changes", "scopes")})

    def cached(self) -> TraceSet:
        return replace(self, **{n: getattr(self, n).persist() for n in ("traces", "signals", "timestamps", "changes") if getattr(self, n) is not None})

    def intervals(self) -> DataFrame:
        """changes with end_idx: [idx, end_idx) is where the value holds. An unknown leading interval (bits x, value 0) where a signal's first change is after index 0, or there is none."""
        key = ["trace_id", "name"]
        rest = [c for c in self.changes.columns if c not in (*key, "idx")]
        last = self.changes.groupBy(*key, "idx").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*key, "idx", "r.*")
        ends = hold(last, key, "idx", [], self.bucket, "next_idx").join(self.traces.select("trace_id", "max_index"), "trace_id")
        known = ends.withColumn("end_idx", F.coalesce("next_idx", F.col("max_index") + 1))
        events = self.signals.where("is_event").select("trace_id", "name", F.lit(True).alias("event"))
        known = known.join(events, key, "left")
        one = known.withColumn("end_idx", F.when(F.col("event"), F.col("idx") + 1).otherwise(F.col("end_idx")))
        zero = known.where("event and idx + 1 < coalesce(next_idx, max_index + 1)").withColumn("end_idx", F.coalesce("next_idx", F.col("max_index") + 1)).withColumn("idx", F.col("idx") + 1).withColumn("ival", F.lit(0).cast("long")).withColumn("ival_strict", F.lit(0).cast("long")).withColumn("bits", F.lit("0"))
        cols = ["trace_id", "sig_id", "name", "idx", "end_idx", "ts", "seq", "bits", "ival", "ival_strict", "rval"]
        first = self.changes.groupBy(*key).agg(F.min("idx").alias("first"))
        lead = self.signals.join(self.traces.select("trace_id", "max_index"), "trace_id").join(first, key, "left").where("first is null or first > 0")
        lead = lead.select("trace_id", "sig_id", "name", F.lit(0).cast("long").alias("idx"), F.coalesce("first", F.col("max_index") + 1).alias("end_idx"), F.lit(None).cast("long").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit("x").alias("bits"), F.lit(0).cast("long").alias("ival"), F.lit(None).cast("long").alias("ival_strict"), F.lit(0.0).alias("rval"))
        return one.select(*cols).unionByName(zero.select(*cols)).unionByName(lead.select(*cols))


def _filled(changes: DataFrame, kind: str) -> DataFrame:
    have = changes.columns
    for f in T._parse_datatype_string(CHANGES).fields:
        if f.name not in have:
            changes = changes.withColumn(f.name, F.lit(None).cast(f.dataType))
    return changes.select(*[f.name for f in T._parse_datatype_string(CHANGES).fields])


def _signals(changes: DataFrame, kind: str) -> DataFrame:
    names = changes.select("trace_id", "name").distinct()
    kinds = {"int": "integer", "real": "real", "str": "string"}
    return names.select("trace_id", F.hash("name").alias("sig_id"), "name", F.element_at(F.split("name", "\\."), -1).alias("short"), F.regexp_extract("name", "^(.*)\\.[^.]*$", 1).alias("scope"), F.lit(64).alias("width"), F.lit(kinds[kind]).alias("var_type"), F.col("name").alias("id_code"), F.lit(False).alias("is_event"), F.lit(0).alias("decl_order"))


def _built(axis: DataFrame, changes: DataFrame, kind: str, kinds: dict[str, str], bucket: int | None, signals: DataFrame | None = None) -> TraceSet:
    traces = axis.groupBy("trace_id").agg(F.max("idx").alias("max_index")).select("trace_id", F.lit(None).cast("string").alias("file"), F.lit(0).alias("load_order"), F.lit(0).alias("timescale_exp"), F.lit("").alias("version"), F.lit("").alias("date"), "max_index")
    changes = _filled(changes, kind)
    return TraceSet(traces, signals if signals is not None else _signals(changes, kind), axis.select("trace_id", "idx", "ts"), changes, None, kinds, kind, bucket)


def index_rows(df: DataFrame, trace: str, order: list[str]) -> DataFrame:
    """df with trace_id string and idx: the place, from 0, in the order within the trace."""
    w = Window.partitionBy("trace_id").orderBy(*order)
    return df.withColumn("trace_id", F.col(trace).cast("string")).withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def _ts(col: str, df: DataFrame) -> Column:
    kind = dict(df.dtypes)[col]
    return F.unix_micros(F.col(col).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(col).cast("long")


def from_long(df: DataFrame, trace: str, order: list[str], signal: str, value: str, ts: str | None = None, kind: str = "real") -> TraceSet:
    """A row is one change: of the signal named in column `signal`, to `value`. Rows of a trace in `order` make its axis."""
    rows = index_rows(df, trace, order)
    rows = rows.withColumn("ts", _ts(ts, df) if ts else F.col("idx"))
    changes = rows.select("trace_id", F.col(signal).alias("name"), "idx", "ts", F.lit(0).cast("long").alias("seq"), F.col(value).cast({"int": "long", "real": "double", "str": "string"}[kind]).alias(VALUE[kind]))
    # every trace has every signal; those it never changes stay unknown
    return _built(rows, changes, kind, {}, None)


def from_long_global(df: DataFrame, trace_id: str, order: list[str], signal: str, value: str, ts: str | None = None, kind: str = "real", bucket: int = 1 << 18) -> TraceSet:
    """As from_long, with all rows in one trace; its axis and its windows are spread over tasks."""
    rows = global_index(df, order).withColumn("trace_id", F.lit(trace_id))
    rows = rows.withColumn("ts", _ts(ts, df) if ts else F.col("idx"))
    changes = rows.select("trace_id", F.col(signal).alias("name"), "idx", "ts", F.lit(0).cast("long").alias("seq"), F.col(value).cast({"int": "long", "real": "double", "str": "string"}[kind]).alias(VALUE[kind]))
    return _built(rows, changes, kind, {}, bucket)


def from_wide(df: DataFrame, trace: str, order: list[str], signals: dict[str, tuple[str, str]], ts: str | None = None) -> TraceSet:
    """A row is one index; signals: name -> (column, kind), each with a change at every index."""
    rows = index_rows(df, trace, order)
    rows = rows.withColumn("ts", _ts(ts, df) if ts else F.col("idx"))
    null = {"ival": "long", "rval": "double", "bits": "string"}
    made = [F.struct(F.lit(name).alias("name"), *[(F.col(c).cast(t) if VALUE[kind] == v else F.lit(None).cast(t)).alias(v) for v, t in null.items()]) for name, (c, kind) in signals.items()]
    changes = rows.select("trace_id", "idx", "ts", F.explode(F.array(*made)).alias("m")).select("trace_id", "m.name", "idx", "ts", F.lit(0).cast("long").alias("seq"), "m.ival", "m.rval", "m.bits")
    return _built(rows, changes, "int", {n: k for n, (_, k) in signals.items()}, None)


def empty_trace(spark, trace_id: str, timeline: int) -> TraceSet:
    """A trace without signals over `timeline` indices."""
    axis = spark.range(timeline).select(F.lit(trace_id).alias("trace_id"), F.col("id").alias("idx"), F.col("id").alias("ts"))
    made = _built(axis, spark.createDataFrame([], CHANGES), "int", {}, 1 << 20)
    return replace(made, traces=spark.createDataFrame([(trace_id, None, 0, 0, "", "", timeline - 1)], TRACES))


def trimmed(s: TraceSet, first: int, last: int) -> TraceSet:
    """Indices first to last only, counted anew from 0; a value held at first becomes a change at 0."""
    inside = s.timestamps.where(F.col("idx").between(first, last)).withColumn("idx", F.col("idx") - first)
    cut = s.changes.where(F.col("idx") <= last).withColumn("at", F.greatest(F.col("idx") - first, F.lit(0).cast("long")))
    rest = [c for c in cut.columns if c not in ("trace_id", "name", "at")]
    kept = cut.groupBy("trace_id", "name", "at").agg(F.max_by(F.struct(*rest), F.struct("idx", "seq")).alias("r"))
    events = s.signals.where("is_event").select("trace_id", "name")
    changes = kept.select("trace_id", "name", *[(F.col("at") if c == "idx" else F.col(f"r.{c}")).alias(c) for c in rest], F.col("r.idx").alias("was")).join(events.withColumn("ev", F.lit(True)), ["trace_id", "name"], "left").where(f"ev is null or was >= {first}").drop("was", "ev")
    traces = s.traces.where(f"max_index >= {first}").withColumn("max_index", F.least(F.col("max_index"), F.lit(last)) - first)
    return replace(s, traces=traces, timestamps=inside, changes=changes.select(*s.changes.columns))
