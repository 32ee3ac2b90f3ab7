"""The interval engine against a naive reading of every index, on random change logs."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sigspark.model import CHANGES, SIGNALS, TIMESTAMPS, TRACES, TraceSet, trimmed
from sigspark.operators import bus, search
from sigspark.timeexpr import INDEX, rising, sig

NAMES = ["a", "b", "c"]


def build(spark, logs, n, bucket=None, partitions=4, pulses=frozenset()):
    """logs: {trace: {name: {idx: value}}}; n: {trace: indices}."""
    changes = [(t, i, name, idx, idx * 10, idx, format(v, "b"), v, v, float(v)) for t, log in logs.items() for i, (name, own) in enumerate(log.items()) for idx, v in own.items()]
    random.Random(1).shuffle(changes)
    return TraceSet(
        spark.createDataFrame([(t, "", i, 0, "", "", n[t] - 1) for i, t in enumerate(logs)], TRACES),
        spark.createDataFrame([(t, i, name, name, "", 8, "wire", name, name in pulses, i) for t in logs for i, name in enumerate(NAMES)], SIGNALS),
        spark.createDataFrame([(t, i, i * 10) for t in logs for i in range(n[t])], TIMESTAMPS),
        spark.createDataFrame(changes, CHANGES).repartition(partitions),
        bucket=bucket, pulses=pulses,
    )


def held(log, name, i):
    own = [k for k in log.get(name, {}) if k <= i]
    return log[name][max(own)] if own else 0


logs = st.dictionaries(st.sampled_from(["t0", "t1", "t2"]), st.dictionaries(st.sampled_from(NAMES), st.dictionaries(st.integers(0, 39), st.integers(0, 3), max_size=12)), min_size=1)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(logs, st.integers(-5, 5), st.sampled_from([None, 1, 7, 100]), st.integers(1, 8))
def test_random_logs(spark, logs, k, bucket, partitions):
    n = {t: 10 + 15 * i for i, t in enumerate(sorted(logs))}
    logs = {t: {name: {i: v for i, v in own.items() if i < n[t]} for name, own in log.items()} for t, log in sorted(logs.items())}
    s = build(spark, logs, n, bucket, partitions)
    a, b = sig("a"), sig("b")
    conds = {
        "eq": (a == 1, lambda g, i, m: g("a", i) == 1),
        "zero": (a == 0, lambda g, i, m: g("a", i) == 0),
        "both": ((a > 0) & ~(b == 2), lambda g, i, m: g("a", i) > 0 and g("b", i) != 2),
        "shift": (a.at(k) > 0, lambda g, i, m: 0 <= i + k <= m and g("a", i + k) > 0),
        "not shift": (~(a.at(k) > 0), lambda g, i, m: not (0 <= i + k <= m and g("a", i + k) > 0)),
        "neq shift": (a.at(k) != 1, lambda g, i, m: not 0 <= i + k <= m or g("a", i + k) != 1),
        "edge": (rising(a), lambda g, i, m: i > 0 and g("a", i) == 1 and g("a", i - 1) == 0),
        "twice": ((a.at(1) == b).at(k), lambda g, i, m: 0 <= i + k <= m and 0 <= i + k + 1 <= m and g("a", i + k + 1) == g("b", i + k)),
        "index": ((INDEX % 3 == 0) & (b > 0), lambda g, i, m: i % 3 == 0 and g("b", i) > 0),
    }
    got = [tuple(r) for r in search.find_by_trace(s, conds["twice"][0]).collect()]
    counts = search.count(s, *[c for key, (c, _) in conds.items() if key != "index"]).first()
    want = {key: [(t, i) for t, log in logs.items() for i in range(n[t]) if f(lambda name, j, log=log: held(log, name, j), i, n[t] - 1)] for key, (_, f) in conds.items()}
    assert sorted(got) == want["twice"]
    assert list(counts) == [len(want[key]) for key in conds if key != "index"]
    assert sorted(map(tuple, search.find_by_trace(s, conds["index"][0]).collect())) == want["index"]
    assert [r.idx for r in search.find(s, conds["zero"][0], 5).collect()] == sorted({i for _, i in want["zero"]})[:5]


def test_hold_over_buckets(spark):
    """One change at index 0 of 10,000 is held to the end, whatever the buckets and partitions."""
    s = build(spark, {"t0": {"a": {0: 1}}}, {"t0": 10_000}, 64, 8)
    assert search.count(s, sig("a") == 1).first().n0 == 10_000
    assert search.sample_at(s, "a", 9_999).first().value == 1


def test_intervals_have_leading_rows(spark):
    s = build(spark, {"t0": {"a": {3: 1, 5: 0}}}, {"t0": 8})
    rows = sorted((r.name, r.idx, r.end_idx, r.bits) for r in s.intervals().collect())
    assert rows == [("a", 0, 3, "x"), ("a", 3, 5, "1"), ("a", 5, 8, "0"), ("b", 0, 8, "x"), ("c", 0, 8, "x")]


def test_pulses(spark):
    s = build(spark, {"t0": {"a": {2: 1, 3: 1, 6: 1}}}, {"t0": 8}, pulses=frozenset({"a"}))
    assert [r.idx for r in search.find(s, sig("a") == 1).collect()] == [2, 3, 6]
    assert [r.idx for r in search.find(s, sig("a") == 0).collect()] == [0, 1, 4, 5, 7]
    assert sorted((r.idx, r.end_idx, r.ival) for r in s.intervals().where("name = 'a'").collect()) == [(0, 2, 0), (2, 3, 1), (3, 4, 1), (4, 6, 0), (6, 7, 1), (7, 8, 0)]


def test_find_global_clamps(spark):
    s = build(spark, {"t0": {"a": {0: 1}}, "t1": {"a": {4: 1}}}, {"t0": 3, "t1": 6})
    assert sorted((r.step, r.indices) for r in search.find_global(s, sig("a") == 1).collect()) == [(0, [0, 0]), (1, [1, 1]), (2, [2, 2]), (4, [2, 4]), (5, [2, 5])]


def test_folds(spark):
    s = build(spark, {"t0": {"a": {0: 1, 3: 2}, "b": {4: 1}}}, {"t0": 6})
    assert search.fold_signal(s, "a", "sum").first().value == 3 * 1 + 3 * 2
    assert search.fold_signal(s, "a", "sum", sig("b") == 1).first().value == 3 + 2
    assert search.fold_signal(s, "a", "sum", start=2).first().value == 1 + 6
    from pyspark.sql import functions as F

    assert search.fold_ordered(s, "a", F.lit(0).cast("long"), lambda acc, x: acc * 10 + x).first().value == 111222


def test_trim_and_align(spark):
    s = build(spark, {"t0": {"a": {0: 1, 4: 2}}, "t1": {"a": {1: 3}}}, {"t0": 6, "t1": 3})
    t = trimmed(s, 2, 4)
    assert sorted(map(tuple, search.held_dense(t, "a").collect())) == [("t0", 0, 1), ("t0", 1, 1), ("t0", 2, 2), ("t1", 0, 3)]
    assert [tuple(r) for r in search.align(s, "t0", "t1", "a").orderBy("idx").collect()] == [(0, 1, 0), (1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 2, 3), (5, 2, 3)]


def test_bus(spark):
    s = build(spark, {"t0": {"a": {0: 1, 4: 0, 6: 1}, "b": {1: 1, 3: 0, 7: 1}, "c": {0: 2, 2: 3}}}, {"t0": 10})
    v, r = sig("a") == 1, sig("b") == 1
    assert [x.idx for x in bus.handshakes(s, v, r).orderBy("idx").collect()] == [1, 2, 7, 8, 9]
    u = bus.utilisation(s, v, r).first()
    assert (u.valid_cycles, u.stalls, u.beats, u.cycles, u.util_pct) == (8, 3, 5, 10, 50.0)
    assert {x.opcode: x.n for x in bus.mix(s, v & r, sig("c"), 3).collect()} == {2: 1, 3: 2}
    lat = bus.latency(s, sig("a") == 1, sig("b") == 1).first()
    assert (lat.samples, lat.least, lat.largest, lat.total) == (7, 1, 5, 14)


@pytest.mark.parametrize("bucket", [None, 4])
def test_plan_reads_only_named_signals(spark, tmp_path, bucket):
    s = build(spark, {"t0": {"a": {0: 1}, "b": {0: 1}}}, {"t0": 4}, bucket)
    path = str(tmp_path / "changes")
    s.changes.write.parquet(path)
    s.changes = spark.read.parquet(path)
    plan = search.count(s, sig("a") == 1)._jdf.queryExecution().executedPlan().toString()
    if bucket is None:  # one exchange of rows serves grouping and windows
        assert plan.count("hashpartitioning") == 1
    assert "EqualTo(name,a)" in plan and "rval" not in plan.split("ReadSchema")[1]


def long_axis(spark, n):
    """One trace of n indices: `on` is 1 all the time, `late` from the middle on, `beat` at a few places."""
    s = build(spark, {"t0": {"a": {0: 1}, "b": {n // 2: 1}, "c": {5: 1, 6: 0, n - 9: 1, n - 7: 0}}}, {"t0": 1}, 1 << 18)
    s.traces = spark.createDataFrame([("t0", "", 0, 0, "", "", n - 1)], TRACES)
    s.timestamps = spark.range(n).selectExpr("'t0' as trace_id", "id as idx", "id * 10 as ts")
    return s


def test_axis_of_a_published_dump(spark):
    """385,314,044 indices: what is asked for is expanded, not the axis; an index far out is found at once."""
    import time

    n = 385_314_044
    s = long_axis(spark, n)
    began = time.time()
    assert [r.idx for r in search.find(s, sig("a") == 1, 10).collect()] == list(range(10))
    assert [r.idx for r in search.find(s, sig("b") == 1, 3).collect()] == [n // 2, n // 2 + 1, n // 2 + 2]
    assert [r.idx for r in search.find(s, sig("a") == 1, 2, n - 1).collect()] == [n - 1]
    assert [r.idx for r in search.find(s, sig("c") == 1).collect()] == [5, n - 9, n - 8]
    assert search.count(s, sig("a") == 1, sig("b") == 1).first()[:] == (n, n - n // 2)
    assert search.fold_signal(s, "a", "sum", sig("b") == 1).first().value == n // 2
    lat = bus.latency(s, sig("a") == 1, sig("c") == 1, 1000).first()
    assert (lat.samples, lat.least, lat.largest) == (1 + (n - 10) // 1000, min(5, (n - 9) % 1000 or 1000), n - 9 - 1000)
    assert {r.opcode: r.n for r in bus.mix(s, sig("a") == 1, sig("b"), n - 5).collect()} == {0: n // 2, 1: n - 5 - n // 2}
    assert time.time() - began < 60


def test_expansion_in_chunks(spark, monkeypatch):
    from sigspark.operators import held

    monkeypatch.setattr(held, "CHUNK", 3)
    df = spark.createDataFrame([("x", 0, 10), ("y", 4, 5), ("z", 3, 3)], "k string, idx long, end_idx long")
    assert sorted(map(tuple, held.expand(df).collect())) == [("x", i) for i in range(10)] + [("y", 4)]


@pytest.mark.parametrize("bucket", [None, 1, 5, 1000])
def test_buckets_change_nothing(spark, bucket):
    """Repeats, as-of values, running totals, latency and mixes, over buckets, against plain loops."""
    from sigspark.operators.held import running_total, suppress_repeats

    rng = random.Random(9)
    logs = {t: {x: {i: rng.randint(0, 2) for i in sorted(rng.sample(range(60), 20))} for x in NAMES} for t in ("t0", "t1")}
    s = build(spark, logs, {"t0": 60, "t1": 45}, bucket)
    logs = {t: {x: {i: v for i, v in own.items() if t == "t0" or i < 45} for x, own in log.items()} for t, log in logs.items()}
    s.changes = s.changes.where("trace_id = 't0' or idx < 45")
    rows = s.changes.where("name = 'a'").select("trace_id", "idx", "ival")
    want = [(t, i, v) for t, log in logs.items() for k, (i, v) in enumerate(sorted(log["a"].items())) if not k or sorted(log["a"].items())[k - 1][1] != v]
    assert sorted(map(tuple, suppress_repeats(rows, ["trace_id"], "idx", "ival", bucket).collect())) == want
    at = s.timestamps.select("trace_id", "idx")
    assert sorted(map(tuple, search.samples(s, "b", at).collect())) == [(t, i, held(logs[t], "b", i)) for t in logs for i in range(60 if t == "t0" else 45)]
    got = running_total(rows, ["trace_id"], "idx", "ival", "seen", bucket).collect()
    assert sorted((r.trace_id, r.idx, r.seen) for r in got) == [(t, i, sum(v for j, v in log["a"].items() if j < i)) for t, log in logs.items() for i in sorted(log["a"])]
    for every in (1, 3):
        want = {}
        for t, log in logs.items():
            n = 60 if t == "t0" else 45
            asked = [i for i in range(n) if held(log, "a", i) == 1][::every]
            d = [min((j - i for j in range(i + 1, n) if held(log, "b", j) == 2), default=None) for i in asked]
            if d := [x for x in d if x is not None]:
                want[t] = (len(d), min(d), max(d), sum(d))
        assert {r.trace_id: (r.samples, r.least, r.largest, r.total) for r in bus.latency(s, sig("a") == 1, sig("b") == 2, every).collect()} == want
    first = [held(log, "c", i) for t, log in logs.items() for i in [i for i in range(60 if t == "t0" else 45) if held(log, "a", i) == 1][:7]]
    assert {r.opcode: r.n for r in bus.mix(s, sig("a") == 1, sig("c"), 7).collect()} == {v: first.count(v) for v in set(first)}


def test_no_window_holds_a_trace(spark):
    """With buckets, every window of rows is keyed by a bucket, or runs over a row a bucket."""
    import re

    s = build(spark, {"t0": {"a": {0: 1, 3: 0}, "b": {2: 1}}}, {"t0": 9}, 4)
    for df in (search.fold_signal(s, "a", "sum", sig("b") == 1), bus.latency(s, sig("a") == 1, sig("b") == 1), bus.mix(s, sig("a") == 1, sig("b"), 2), search.samples(s, "a", s.timestamps.select("trace_id", "idx"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for keys, order in re.findall(r"Window \[.*\], \[([^\]]*)\], \[([^\]]*)\]", plan):
            assert "_b#" in keys or order.startswith("_b#"), (keys, order)
