import bz2
import gzip
import io

import pytest

from sigspark.operators import search
from sigspark.session import Session, detect_format
from sigspark.sources import fst, sink, synthetic, vcd
from sigspark.timeexpr import known, sig

SMALL = """$date today $end
$timescale
  10 ns
$end
$scope module top $end
$var wire 1 ! clk $end
$var wire 8 # data [7:0] $end
$scope task sub $end
$var wire 1 ' rst $end
$var wire 1 a! other $end
$upscope $end
$var real 64 r temp $end
$var event 1 ev ping $end
$var wire 70 w wide $end
$var wire 0 q none $end
$upscope $end
$enddefinitions $end
$dumpvars
1!
b00000001 #
x'
$end
#10
0!
1a!
#20
1!
b1010#
r3.5 r
1ev
b{}w
#20
0!
1!
#30
#40
1ev
0'
""".replace("{}", "1" * 70 + " ")


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    path = tmp_path_factory.mktemp("vcd") / "small.vcd"
    path.write_text(SMALL)
    return str(path)


def test_small(spark, small):
    s = vcd.read_vcd(spark, small)
    t = s.traces.first()
    assert (t.max_index, t.timescale_exp, t.date) == (4, -8, "today")
    assert [r.ts for r in s.timestamps.orderBy("idx").collect()] == [10, 20, 20, 30, 40]
    assert [r.name for r in s.signals.orderBy("decl_order").collect()] == ["top.clk", "top.data [7:0]", "top.sub.rst", "top.sub.other", "top.temp", "top.ping", "top.wide"]
    d = {r.idx: r for r in search.held_dense(s, "top.clk", "top.data [7:0]", "top.sub.other", "top.wide").collect()}
    # the values before the first time are at index 0; `!` is not the end of `a!`; the last value at an index counts
    assert [d[i]["top.clk"] for i in range(5)] == [0, 1, 1, 1, 1]
    assert [d[i]["top.data [7:0]"] for i in range(5)] == [1, 10, 10, 10, 10]
    assert [d[i]["top.sub.other"] for i in range(5)] == [1] * 5
    assert d[1]["top.wide"] == -1
    assert [r.idx for r in search.find(s, sig("top.ping") == 1).collect()] == [1, 4]
    assert search.sample_at(s, "top.temp", 3).first().value == 3.5
    rst = "top.sub.rst"
    assert search.count(s, sig(rst) == 0, known(rst), known(rst) & (sig(rst) == 0), known(rst).at(1), ~known("top.clk")).first()[:] == (5, 1, 1, 1, 0)
    assert [r.idx for r in search.find(s, sig("top.clk") == 1, 2, from_index=2).collect()] == [2, 3]
    strict = {(r.idx, r.name): r.ival_strict for r in s.changes.collect()}
    assert strict[0, "top.sub.rst"] is None and strict[1, "top.data [7:0]"] == 10


@pytest.mark.parametrize("ending", [".gz", ".bz2"])
def test_compressed(spark, small, tmp_path, ending):
    path = str(tmp_path / f"small.vcd{ending}")
    (gzip if ending == ".gz" else bz2).open(path, "wt").write(SMALL)
    assert detect_format(spark, path) == "vcd"
    s = vcd.read_vcd(spark, path)
    assert search.count(s, sig("top.clk") == 1).first().n0 == 4


def test_splits_do_not_matter(spark, tmp_path):
    """Signal i is (t + i) mod 2, also where a file is cut into many splits and ids hold `#`."""
    path = str(tmp_path / "toggle.vcd")
    synthetic.write_toggle(spark, path, 6, 2000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "100k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            s = vcd.read_vcd(spark, path)
            assert s.traces.first().max_index == 1999
            wrong = search.held_dense(s, *[f"test.sig{i}" for i in range(1, 7)]).where(" or ".join(f"`test.sig{i}` <> (idx + 1 + {i}) % 2" for i in range(1, 7)))
            assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hash_in_ids(spark, tmp_path):
    path = tmp_path / "hash.vcd"
    path.write_text("$scope module top $end\n$var wire 1 # a $end\n$var wire 1 ## b $end\n$upscope $end\n$enddefinitions $end\n#1\n1#\n0##\n#2\n0#\n1##\n#END\n")
    s = vcd.read_vcd(spark, str(path))
    assert sorted(map(tuple, search.held_dense(s, "top.a", "top.b").collect())) == [("t0", 0, 1, 0), ("t0", 1, 0, 1)]


def test_no_signals_and_no_header(spark, tmp_path):
    path = tmp_path / "none.vcd"
    path.write_text("$enddefinitions $end\n#0\n#5\n")
    s = vcd.read_vcd(spark, str(path))
    assert s.traces.first().max_index == 1 and s.signals.count() == 0
    path.write_text("just text\n")
    with pytest.raises(ValueError):
        vcd.read_vcd(spark, str(path))


def test_awkward_dumps(spark, tmp_path):
    """CRLF, tabs, comments in header and body, values without a space, parts that begin in the middle of a time, lines of # in the header."""
    head = "$comment\n#7 not a time\n1a\n$end\n$scope module top $end\n$var wire 1 a a $end\n$var wire 4 b b $end\n$var real 64 r r $end\n$upscope $end\n$enddefinitions $end\n"
    (tmp_path / "d.vcd").mkdir()
    (tmp_path / "d.vcd" / "part-0").write_text((head + "$dumpvars\n1a\n$end\n#5\n$comment 0a\n0a $end\nb10b\nr-2.5e1 r\n").replace("\n", "\r\n"))
    (tmp_path / "d.vcd" / "part-1").write_text("0a\n#9\nbxz1\tb\n")
    (tmp_path / "d.vcd" / "part-2").write_text("#12\n1a\n1unknown\n\n")
    s = vcd.read_vcd(spark, str(tmp_path / "d.vcd"))
    assert [(r.idx, r.ts) for r in s.timestamps.orderBy("idx").collect()] == [(0, 5), (1, 9), (2, 12)]
    got = [(r.name, r.idx, r.bits, r.ival, r.ival_strict, r.rval) for r in s.changes.orderBy("name", "idx", "seq").collect()]
    assert got == [("top.a", 0, "1", 1, 1, 1.0), ("top.a", 0, "0", 0, 0, 0.0), ("top.a", 2, "1", 1, 1, 1.0), ("top.b", 0, "10", 2, 2, 2.0), ("top.b", 1, "xz1", 1, None, 1.0), ("top.r", 0, None, 0, None, -25.0)]
    assert [r.idx for r in search.find(s, sig("top.a") == 1).collect()] == [2]


def test_timescale():
    assert [vcd.timescale(x) for x in ("10 ns", "1ps", "100 us", "1 s", "")] == [-8, -12, -4, 0, 0]


def test_store_roundtrip(spark, small, tmp_path):
    s = vcd.read_vcd(spark, small)
    sink.write_store(s, str(tmp_path / "store"))
    assert detect_format(spark, str(tmp_path / "store")) == "store"
    back = sink.read_store(spark, str(tmp_path / "store"))
    names = ["top.clk", "top.data [7:0]", "top.sub.rst"]
    rows = lambda x: sorted(map(tuple, search.held_dense(x, *names).collect()))
    assert rows(back) == rows(s) and back.pulses == s.pulses and back.kinds == s.kinds


def test_vcd_sink(spark, small, tmp_path):
    s = vcd.read_vcd(spark, small)
    values = s.changes.where("name in ('top.clk', 'top.data [7:0]')").groupBy("name", "idx").agg({"bits": "max"}).select("name", "idx", "max(bits)").toDF("name", "idx", "bits")
    lines = sink.vcd_lines(values, s.timestamps.select("idx", "ts"), [("top.clk", 1, "wire"), ("top.data [7:0]", 8, "wire")])
    sink.write_vcd(lines, str(tmp_path / "out.vcd"))
    back = vcd.read_vcd(spark, str(tmp_path / "out.vcd"))
    assert back.traces.first().max_index == 4
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out.vcd")).collect())
    assert "b1010 " in text


def test_fst_codecs():
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert fst.read_varint(fst.varint(n), 0)[0] == n
        for m in (n, -n):
            assert fst.read_svarint(fst.svarint(m), 0)[0] == m
    assert fst.lz4_block(bytes([0x14, ord("a"), 1, 0, 0x10, ord("b")]), 10) == b"a" * 9 + b"b"
    assert fst.fastlz(bytes([0x00, ord("a"), 0x20 * 3, 0]), 6) == b"a" * 6
    with pytest.raises(ValueError):
        fst.lz4_block(bytes([0x10, ord("a")]), 2)


def test_fst_writer_and_reader(spark, tmp_path):
    f = io.BytesIO()
    w = fst.FstWriter(f, flush_bytes=800)
    w.push_scope("top")
    c, d, r = w.create_var("clk"), w.create_var("data", 12), w.create_var("r", 64, "real")
    w.push_scope("in")
    w.create_var("clk2", alias=c)
    w.pop_scope()
    w.pop_scope()
    w.emit_value_change(c, "0")
    for t in range(300):
        w.emit_time_change(t * 10)
        w.emit_value_change(c, str(t % 2))
        w.emit_value_change(d, format(t * 7 % 4096, "b") if t % 5 else "x" * 12)
        w.emit_value_change(r, t / 4)
    w.close()
    assert w.blocks > 2
    path = tmp_path / "b.fst"
    path.write_bytes(f.getvalue())
    s = fst.read_fst(spark, str(path))
    assert s.traces.first().max_index == 299
    rows = search.held_dense(s, "top.clk", "top.data", "top.in.clk2").collect()
    assert len(rows) == 300 and all(x["top.clk"] == x["top.in.clk2"] == x.idx % 2 and x["top.data"] == (x.idx * 7 % 4096 if x.idx % 5 else 0) for x in rows)
    assert search.sample_at(s, "top.r", 299).first().value == 299 / 4
    # held value, not a look ahead
    assert search.sample_at(s, "top.data", 101).first().value == 707


def test_vcd_to_fst(spark, small, tmp_path):
    fst.vcd_to_fst(spark, small, str(tmp_path / "small.fst"))
    a, b = vcd.read_vcd(spark, small), fst.read_fst(spark, str(tmp_path / "small.fst"))
    assert [r.name for r in a.signals.orderBy("decl_order").collect()] == [r.name for r in b.signals.orderBy("decl_order").collect()]
    # equal times are one index here
    assert b.traces.first().max_index == 3
    assert search.sample_at(b, "top.data [7:0]", 2).first().value == 10
    assert [r.idx for r in search.find(b, sig("top.ping") == 1).collect()] == [1, 3]


def test_fst_repeated_times(spark, small, tmp_path, monkeypatch):
    fst.vcd_to_fst(spark, small, str(tmp_path / "small.fst"), repeats=True)
    a, b = vcd.read_vcd(spark, small), fst.read_fst(spark, str(tmp_path / "small.fst"))
    assert sorted(r[1:] for r in b.timestamps.collect()) == sorted(r[1:] for r in a.timestamps.collect())
    assert [r.idx for r in search.find(b, sig("top.ping") == 1).collect()] == [r.idx for r in search.find(a, sig("top.ping") == 1).collect()] == [1, 4]
    # blocks are small, and batches too: no block ends within a run of equal times
    monkeypatch.setattr(fst, "BATCH", 7)
    f = io.BytesIO()
    w = fst.FstWriter(f, flush_bytes=200, repeats=True)
    d = w.create_var("d", 8)
    for i in range(100):
        w.emit_time_change(i // 30)
        w.emit_value_change(d, format(i, "b"))
    w.close()
    assert w.blocks == 4
    (tmp_path / "r.fst").write_bytes(f.getvalue())
    s = fst.read_fst(spark, str(tmp_path / "r.fst"))
    assert s.traces.first().max_index == 99 and sorted(r[1:] for r in s.timestamps.collect()) == [(i, i // 30) for i in range(100)]
    assert [tuple(r) for r in search.held_dense(s, "d").orderBy("idx").select("idx", "d").collect()] == [(i, i) for i in range(100)]


def test_fst_roundtrip_repeated_times(spark, tmp_path):
    """The query on events that share their times, as larger copies of the table do."""
    import duckdb

    from sigspark.plans.catalogue import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id + k * 1000000 AS event_id, ts, user_id, event_type, value + k AS value, props FROM '/root/testdata/sf0.001/events.parquet', range(3) r(k) WHERE event_id < 200) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES["fst_roundtrip"](spark, str(tmp_path)).select("name", "idx", "value").collect()
    want = con.execute(f"SELECT name, idx, value FROM ({ORACLE['fst_roundtrip']})").fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_session_formats(spark, small, tmp_path):
    s = Session(spark)
    assert s.load(small).trace_id == "t0"
    assert s.load(small, "again").max_index == 4
    assert s.step(4) and not s.step(1) and s.first().index == 4
    assert s.step(-9) and s.first().index == 0
    s.unload("nothing")
    odd = tmp_path / "dump"
    odd.write_text(SMALL)
    assert detect_format(spark, str(odd)) == "vcd"
    odd.write_bytes(b"zzz")
    with pytest.raises(ValueError):
        detect_format(spark, str(odd))
