"""URL filter: allow and block rules first, then the ratio of two character language models.

The urls that a rule decides are the labelled ones. Two variable-order Markov models, of accepted and of
rejected urls, give each character its probability after up to ORDER characters: counts of the longest context
are smoothed by those of the next shorter one (Witten-Bell), down to a uniform distribution, so an unseen context
falls back to what is known of its end. Their log ratio for every context and character is one array of fixed
size; a url's score is its mean over the url, compared with a threshold calibrated on labelled urls that
neither model has seen. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import cut

#: Context length, and the symbols: a place in this text (from 1), 0 for the beginning, the last for any other character.
ORDER = 3
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-"
SIZE = 32
BINS = 400


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    def __str__(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as text; null where none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(str(r))).otherwise(out)
    return out


def _codes(url: Column) -> Column:
    """The symbols of a whole url: A-Z lowered, all digits alike."""
    plain = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    table = F.create_map(*[x for i, c in enumerate(SYMBOLS) for x in (F.lit(c), F.lit(i + 1))])
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(SIZE - 1)))


def _steps(url: Column) -> Column:
    """Per character, the number of its context and itself: base-SIZE digits, oldest first."""

    def steps(codes: Column) -> Column:
        before = lambda i, j: F.coalesce(F.get(codes, i - j), F.lit(0)) * SIZE**j
        return F.transform(codes, lambda c, i: sum((before(i, j) for j in range(1, ORDER + 1)), c))

    # an array of one array binds the symbols to a name, so that they are made once a url
    return F.transform(F.array(_codes(url)), steps)[0]


def train(labelled: DataFrame, url: str = "url", accepted: str = "accepted") -> DataFrame:
    """One row with `ratio`, an array of SIZE ** (ORDER + 1) doubles: log P(accepted) - log P(rejected) of a character after a context.

    labelled: urls and the boolean `accepted`. All its rows count; they are aggregated on each side before
    anything is shuffled, and at most 2 * SIZE ** (ORDER + 1) sums come out.
    """
    spark = labelled.sparkSession
    # n-gram counts: a row's own n-grams need no grouping before the partial aggregate
    grams = cut(labelled.select(F.col(accepted).alias("y"), F.explode(_steps(F.col(url))).alias("g")).groupBy("y", "g").agg(F.count(F.lit(1)).alias("n")))
    cells = spark.range(0, SIZE ** (ORDER + 1), 1, 8).select(F.col("id").cast("int").alias("g"))
    out = cells
    for side, y in (("acc", True), ("rej", False)):
        own = grams.where(F.col("y") == y)
        p: Column = F.lit(1.0 / SIZE)
        for order in range(ORDER + 1):
            # counts of the character after the last `order` symbols, and of those symbols, and how many characters follow them
            tail = own.select((F.col("g") % SIZE ** (order + 1)).alias(f"k{order}"), "n").groupBy(f"k{order}").agg(F.sum("n").alias(f"n{side}{order}"))
            of = tail.select(F.floor(F.col(f"k{order}") / SIZE).cast("int").alias(f"c{order}"), f"n{side}{order}").groupBy(f"c{order}").agg(F.sum(f"n{side}{order}").alias(f"m{side}{order}"), F.count(F.lit(1)).alias(f"t{side}{order}"))
            out = out.withColumn(f"k{order}", F.col("g") % SIZE ** (order + 1)).withColumn(f"c{order}", F.floor(F.col("g") % SIZE ** (order + 1) / SIZE).cast("int"))
            out = out.join(tail, f"k{order}", "left").join(of, f"c{order}", "left").drop(f"k{order}", f"c{order}")
            n, m, t = (F.coalesce(F.col(f"{x}{side}{order}"), F.lit(0)) for x in "nmt")
            p = F.when(m + t > 0, (n + t * p) / (m + t)).otherwise(p)
        out = out.withColumn(side, F.log(p)).select("g", *(s for s in ("acc", "rej") if s in out.columns or s == side))
    pairs = out.select(F.struct("g", (F.col("acc") - F.col("rej")).alias("r")).alias("x"))
    return cut(pairs.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("ratio")))


def scored(df: DataFrame, ratio: DataFrame, url: str = "url") -> DataFrame:
    """df with `score`: the mean log ratio of a url's characters; 0 for null and empty ones.

    ratio: the row of train(). It reaches the expression as a scalar subquery: no join, and as an array of
    fixed size nothing that grows with the data. The optimiser puts the subquery in the place where it is used,
    so that rows don't carry it.
    """
    span = SIZE**ORDER
    total = F.aggregate(
        _codes(F.col(url)),
        F.struct(F.lit(0).alias("ctx"), F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda a, c: F.struct(((a["ctx"] * SIZE + c) % span).alias("ctx"), (a["sum"] + F.get("_ratio", a["ctx"] * SIZE + c)).alias("sum"), (a["n"] + 1).alias("n")),
        lambda a: F.when(a["n"] > 0, F.round(a["sum"] / a["n"], 9)).otherwise(0.0),
    )
    return df.withColumn("_ratio", ratio.scalar()).withColumn("score", total).drop("_ratio")


def threshold(known: DataFrame, accepted: str = "accepted") -> float:
    """The score from which on urls are accepted: the cut with the best balanced accuracy over labelled rows; 0 where a side is missing."""
    bins = known.groupBy(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") * 100))).cast("int").alias("b")).agg(F.count_if(F.col(accepted)).alias("a"), F.count_if(~F.col(accepted)).alias("r")).orderBy("b").collect()  # 2 * BINS + 1 rows at most
    all_a, all_r = sum(x.a for x in bins), sum(x.r for x in bins)
    if not all_a or not all_r:
        return 0.0
    below_a = below_r = 0
    found: list[tuple[float, int]] = []
    for x in bins:  # accept from bin b on
        found.append(((all_a - below_a) / all_a + below_r / all_r, x.b))
        below_a, below_r = below_a + x.a, below_r + x.r
    best = max(v for v, _ in found)
    ties = [b for v, b in found if v == best]
    i = [x.b for x in bins].index(ties[0])
    # in the middle of the gap that lies before the first bin accepted
    return (ties[0] + (bins[i - 1].b + 1 if i else ties[0])) / 200


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with `host`, `path`, `rule`, `score` and `verdict` (`allow` or `block`); earlier columns of these names are replaced.

    Rules decide where one fits; the model judges the rest, trained on four fifths of the urls that rules
    decide (by the url's checksum) and calibrated on the last fifth. Null and empty urls score 0. With no
    labelled url of a side, the threshold is 0.
    """
    host, path = host_and_path(F.col(url))
    base = pages.drop("host", "path", "rule", "score", "verdict").withColumn("host", host).withColumn("path", path)
    base = base.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
    allowed = F.col("rule").isin([str(r) for r in rules if r.allow])
    labelled = base.where("rule is not null").select(F.col(url).alias("url"), allowed.alias("accepted"), (F.crc32(F.coalesce(F.col(url), F.lit("")).cast("binary")) % 5 == 0).alias("held"))
    ratio = train(labelled.where("not held"))
    at = threshold(scored(labelled.where("held"), ratio).select("accepted", "score"))
    return scored(base, ratio, url).withColumn("verdict", F.when(F.coalesce(allowed, F.col("score") >= at), "allow").otherwise("block"))
