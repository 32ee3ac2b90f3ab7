"""Value-change dumps as text: read once, in splits and without a shuffle, into a Parquet store.

The dump is cut into records at the lines that begin with `#`, so a record is a time with its changes, and a record's
place in its split is found without looking at others. One pass writes a row for each value; running sums of the splits'
record counts, a number for each split, then turn places into indices of the whole dump. So the result doesn't depend on
how the file is split. All of it is native expressions. What is asked of a signal scans the narrow columns of the store for its
identifier; `sink.write_store` makes a sorted store, for many questions. Gzip and bzip2 are read by Spark's text source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.model import CHANGES, SCOPES, SIGNALS, TRACES, TraceSet
from sigspark.storage import shared_folder

#: Powers of ten of the time units; value states and what they count as.
UNITS = {"s": 0, "ms": -3, "us": -6, "ns": -9, "ps": -12, "fs": -15}
STATES = "01xXzZuUwWlLhH-"
COMMENT = r"(?s)\$comment\b.*?\$end\b"


@dataclass
class Header:
    timescale_exp: int = 0
    version: str = ""
    date: str = ""
    records: int = 0  # that begin before $enddefinitions, the first apart
    tail: int = 0  # lines of the last of them up to $enddefinitions, which is line `tail` from 0
    scopes: list[tuple[str, str, str, int]] = field(default_factory=list)  # path, parent, kind, depth
    signals: list[dict] = field(default_factory=list)


def timescale(text: str) -> int:
    """The power of ten of a time unit: `10 ns` is -8."""
    m = re.search(r"(\d+)\s*(fs|ps|ns|us|ms|s)\b", text)
    return UNITS[m[2]] + len(m[1]) - 1 if m else 0


def parse_header(lines: list[str]) -> Header | None:
    """The declarations up to $enddefinitions; None if they are not complete."""
    h, stack, at = Header(), [], 0
    while at < len(lines):
        words = lines[at].split()
        word = words[0] if words else ""
        if word in ("$timescale", "$version", "$date", "$comment"):
            text = [lines[at].split(word, 1)[1]]
            while "$end" not in text[-1].split():
                at += 1
                if at >= len(lines):
                    return None
                text.append(lines[at])
            body = " ".join(" ".join(text).split()).removesuffix("$end").strip()
            if word == "$timescale":
                h.timescale_exp = timescale(body)
            elif word != "$comment":
                setattr(h, word[1:], body)
        elif word == "$scope" and len(words) >= 3:
            parent = ".".join(stack)
            stack.append(words[2])
            if (path := ".".join(stack)) not in {p for p, *_ in h.scopes}:
                h.scopes.append((path, parent, words[1], len(stack)))
        elif word == "$upscope" and stack:
            stack.pop()
        elif word == "$var" and len(words) >= 6 and words[-1] == "$end" and words[2].isdigit() and int(words[2]) > 0:
            short, scope = " ".join(words[4:-1]), ".".join(stack)
            h.signals.append({"sig_id": len(h.signals), "name": f"{scope}.{short}" if scope else short, "short": short, "scope": scope, "width": int(words[2]), "var_type": words[1], "id_code": words[3], "is_event": words[1] == "event", "decl_order": len(h.signals)})
        elif word == "$enddefinitions":
            records = "\n".join(lines[: at + 1]).split("\n#")
            h.records = len(records) - 1
            h.tail = re.sub(COMMENT, "", records[-1]).count("\n")
            return h
        at += 1
    return None


def first_file(spark: SparkSession, path: str) -> str:
    """The path itself, or of a folder of parts the first in name order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.isDirectory(where):
        return path
    parts = sorted(x.getPath().toString() for x in fs.listStatus(where) if x.isFile() and x.getPath().getName()[0] not in "_.")
    return parts[0] if parts else path


def read_header(spark: SparkSession, path: str) -> Header:
    """The declarations, which must lie in the first part."""
    top, n = first_file(spark, path), 1000
    while True:
        lines = [r.value for r in spark.read.text(top).limit(n).collect()]
        if h := parse_header(lines):
            return h
        if len(lines) < n:
            raise ValueError(f"{path}: no $enddefinitions")
        n *= 10


def as_int(bits: Column, strict: bool = False) -> Column:
    """Bits as a 64-bit integer, the most significant first; states other than 1 count as 0, or make it null if strict. Longer vectors keep their low 64 bits."""
    plain = F.translate(bits, STATES, "01" + "0" * (len(STATES) - 2))
    low = F.conv(F.substring(plain, F.greatest(F.length(plain) - 62, F.lit(1)), F.lit(63)), 2, 10).cast("long")
    sign = F.substring(plain, F.greatest(F.length(plain) - 63, F.lit(1)), F.lit(1))
    v = F.when((F.length(plain) >= 64) & (sign == "1"), low + F.lit(-(1 << 63))).otherwise(low)
    return F.when(~bits.rlike("[^01]"), v) if strict else v


#: Bits of a split's number that are its offset in its file.
OFFSET_BITS = 44


def _lines(records: DataFrame) -> DataFrame:
    """The lines of records (value, seg): `seg` (the split), `pos` (the record's place in its task), `n` (the line's in the record) and `line`.

    The first line of a record is its time; that of a file's first record may be anything.
    """
    text = F.when(F.contains("value", F.lit("\r")) | F.contains("value", F.lit("\t")), F.translate("value", "\t\r", " ")).otherwise(F.col("value"))
    text = F.when(F.contains("value", F.lit("$comment")), F.regexp_replace(text, COMMENT, "")).otherwise(text)
    cut = records.select("seg", F.monotonically_increasing_id().alias("pos"), F.split(text, "\n").alias("lines"))
    return cut.select("seg", "pos", F.posexplode("lines").alias("n", "raw")).withColumn("line", F.trim("raw")).drop("raw")


def _values(lines: DataFrame) -> DataFrame:
    """code and bits (a real's text with a leading r) of lines; others have null codes."""
    one, at = F.substring("line", 1, 1), F.instr("line", " ")
    rest = F.substring("line", 2, 1 << 30)
    vector = one.isin("b", "B", "r", "R")
    # without a space, a vector's identifier begins where its states end
    tight = F.regexp_extract("line", rf"^[bB][{STATES}]+(\S+)$", 1)
    code = F.when(vector, F.when(at > 0, F.ltrim(F.col("line").substr(at + 1, F.length("line")))).otherwise(tight)).when(one.isin(*STATES), F.ltrim(rest))
    body = F.when(at > 0, F.substring_index(rest, " ", 1)).otherwise(F.regexp_extract("line", rf"^[bB]([{STATES}]+)\S+$", 1))
    bits = F.when(one.isin("r", "R"), F.concat(F.lit("r"), body)).when(vector, body).otherwise(one)
    return lines.withColumn("code", code).withColumn("bits", bits)


#: Columns of the store; a record's first line has an empty code.
STORE = "seg long, pos long, n int, code string, bits string"


def write_parsed(spark: SparkSession, path: str, target: str) -> None:
    """One pass over the dump: a row for each value and for each record's first line, in the dump's order.

    seg is the file's place in name order and the split's offset in it, so splits are numbered in the dump's order.
    """
    read = spark.read.option("lineSep", "\n#").text(path)
    files = spark.createDataFrame([(f.rsplit("/", 1)[-1], i) for i, f in enumerate(sorted(read.inputFiles()))] or [("", 0)], "file string, number long")  # a row for each part
    records = read.select("value", F.substring_index("_metadata.file_path", "/", -1).alias("file"), F.col("_metadata.file_block_start").alias("start")).join(F.broadcast(files), "file", "left")
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("a part that was not listed: "), "file")).cast("long"))
    rows = _values(_lines(records.select("value", (F.shiftleft(number, OFFSET_BITS) + F.col("start")).alias("seg"))))
    of = lambda a, b: F.when(F.col("n") == 0, a).otherwise(b)
    # a filter on code would make every line be parsed twice
    rows.select("seg", "pos", "n", of(F.lit(""), F.col("code")).alias("code"), of(F.col("line"), F.col("bits")).alias("bits")).write.parquet(target)


def read_vcd(spark: SparkSession, path: str, trace_id: str = "t0", load_order: int = 0, bucket: int = 1 << 18, store: str | None = None) -> TraceSet:
    """The trace of a dump: a file, or a folder of parts in name order. store: where its values are written (default: a new shared folder).

    Values before the first time belong to index 0; a repeated time line is an index of its own; a signal's last
    value at an index counts; ids are compared whole; what stands between $comment and $end is left out. A line that begins with
    `#` without being a time is none; what follows it belongs to the time before.
    """
    h = read_header(spark, path)
    store = store or shared_folder(spark, "trace")
    write_parsed(spark, path, store)
    rows = spark.read.schema(STORE).parquet(store)
    time = F.col("bits").rlike(r"^#?\d")
    found = rows.where("code = ''").groupBy("seg").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("rows"), F.min_by("bits", "pos").alias("line"), F.sort_array(F.collect_list(F.when(~time, F.col("pos")))).alias("odd")).collect()  # a row for each split
    splits, loose, before = [], [], 0
    for i, r in enumerate(sorted(found, key=lambda r: r.seg)):
        # records that are no times: those of the header, or what a part begins with before its first time
        none = h.records + 1 if i == 0 else int(r.seg % (1 << OFFSET_BITS) == 0 and not r.line.startswith("#"))
        odd = [p - r.first for p in r.odd if p >= r.first + none]  # lines that begin with # without being times
        splits.append((r.seg, i, r.first, before - none, none, i == 0, odd))
        if none and i:
            loose.append((r.seg, r.first, 0, r.line))
        before += r.rows - none - len(odd)
    places = F.broadcast(spark.createDataFrame(splits, "seg long, ordinal int, first long, base long, none long, top boolean, odd array<long>"))
    signals = spark.createDataFrame([{"trace_id": trace_id, **s} for s in h.signals], SIGNALS)
    local = F.col("pos") - F.col("first")
    at, is_time = F.col("base") + local, local >= F.col("none")
    if any(x[-1] for x in splits):
        at, is_time = at - F.size(F.filter("odd", lambda x: x <= local)), is_time & ~F.array_contains("odd", local)
    axis = rows.where("code = ''").join(places, "seg").where(is_time).select(F.lit(trace_id).alias("trace_id"), at.alias("idx"), F.regexp_extract("bits", r"(\d+)", 1).cast("long").alias("ts"))
    dims = F.broadcast(signals.select(F.col("id_code").alias("code"), "name", "sig_id", "is_event"))  # the header's declarations
    head = F.col("top") & ((local < h.records) | (local == h.records) & (F.col("n") <= h.tail))
    real = F.when(F.col("bits").startswith("r"), F.expr("substring(bits, 2)").try_cast("double"))
    bits = F.when(~F.col("bits").startswith("r"), F.col("bits"))
    one = lambda c: F.when(F.col("is_event"), F.lit(1).cast("long")).otherwise(c)
    # the line's place in its split: the split's number, the record's place, the line's
    seq = F.shiftleft(F.col("ordinal").cast("long"), 43) + F.shiftleft(local, 20) + F.col("n")
    values = rows.where("code <> ''").select("seg", "pos", "n", "code", "bits")
    if loose:  # values before a part's first time, at its very beginning
        values = values.unionByName(_values(spark.createDataFrame(loose, "seg long, pos long, n int, line string")).where("code is not null").select("seg", "pos", "n", "code", "bits"))

    def changes_of(codes: list[str] | None) -> DataFrame:
        own = values if codes is None else values.where(F.col("code").isin(codes))
        made = own.join(places, "seg").where(~head).join(dims, "code").select(
            F.lit(trace_id).alias("trace_id"), "sig_id", "name", F.greatest(at, F.lit(0)).alias("idx"), F.lit(None).cast("long").alias("ts"), seq.alias("seq"), bits.alias("bits"),
            one(F.coalesce(as_int(bits), F.lit(0).cast("long"))).alias("ival"), one(as_int(bits, True)).alias("ival_strict"), F.coalesce(real, as_int(bits).cast("double")).alias("rval"),
        ).where(f"idx < {max(before, 1)}")
        return made.select(*[f.split()[0] for f in CHANGES.split(", ")])

    codes = {s["name"]: s["id_code"] for s in h.signals}
    changes = changes_of(None)
    pick = (changes, lambda names: changes_of(sorted({codes[n] for n in names if n in codes})))
    traces = spark.createDataFrame([(trace_id, path, load_order, h.timescale_exp, h.version, h.date, before - 1)], TRACES)
    scopes = spark.createDataFrame([(trace_id, p, parent, kind, depth) for p, parent, kind, depth in h.scopes], SCOPES)
    kinds = {s["name"]: "real" for s in h.signals if s["var_type"] in ("real", "realtime", "shortreal")}
    return TraceSet(traces, signals, axis, changes, scopes, kinds, "int", bucket, frozenset(s["name"] for s in h.signals if s["is_event"]), pick)
