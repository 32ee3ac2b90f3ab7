import pandas as pd

from sigspark.streaming.live import closed_intervals, convert, converted, follow, windowed_counts

ROWS = [("t", "a", 0, "1"), ("t", "a", 2, "1"), ("t", "a", 4, "0"), ("t", "b", 1, "0"), ("t", "a", 9, "1"), ("t", "b", 7, "1")]


def test_intervals_over_batches(spark, tmp_path):
    """Two files, two batches: an interval that one opens the other closes; a repeated value opens none."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "trace_id string, name string, idx long, value string"
    for part in (ROWS[:3], ROWS[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        convert(spark, source, target, state)
    got = sorted(map(tuple, spark.read.parquet(target).collect()))
    assert got == [("t", "a", 0, 4, "1"), ("t", "a", 4, 9, "0"), ("t", "b", 1, 7, "0")]


def test_plans(spark, tmp_path):
    spark.createDataFrame(ROWS, "trace_id string, name string, idx long, value string").write.parquet(str(tmp_path / "in"))
    assert closed_intervals(follow(spark, str(tmp_path / "in"))).isStreaming
    events = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:10", "2024-01-01 00:50", "2024-01-01 01:10"]), "name": ["a", "a", "b"]}))
    assert sorted(r.n for r in windowed_counts(events).collect()) == [1, 2]


def test_conversion_keeps_last_values(spark, tmp_path):
    """Every change is there after each run, also a signal's last and that of one that changes once."""
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "trace_id string, name string, idx long, value string"
    got = []
    for part in ([*ROWS[:3], ("t", "once", 3, "x")], ROWS[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        convert(spark, source, target, state)
        got.append(sorted(map(tuple, converted(spark, target).collect()), key=repr))
    convert(spark, source, target, state)  # nothing new: nothing lost, nothing twice
    assert sorted(map(tuple, converted(spark, target).collect()), key=repr) == got[1]
    assert got[0] == [("t", "a", 0, 4, "1"), ("t", "a", 4, None, "0"), ("t", "once", 3, None, "x")]
    assert got[1] == sorted([("t", "a", 0, 4, "1"), ("t", "a", 4, 9, "0"), ("t", "a", 9, None, "1"), ("t", "b", 1, 7, "0"), ("t", "b", 7, None, "1"), ("t", "once", 3, None, "x")], key=repr)
