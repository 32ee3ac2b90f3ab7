"""Names: scopes, groups, resolution."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.model import TraceSet
from sigspark.timeexpr import Expr


def signals_in(s: TraceSet, prefix: str) -> DataFrame:
    return s.signals.where(F.col("name").startswith(prefix)).select("trace_id", "name")


def scopes(s: TraceSet) -> DataFrame:
    """Sorted distinct scope paths."""
    names = s.scopes.select("path") if s.scopes is not None else s.signals.where("scope <> ''").select(F.col("scope").alias("path"))
    return names.distinct().orderBy("path")


def local_scopes(names: DataFrame, scope: str, col: str = "name") -> DataFrame:
    """Direct children of a scope: the text after it up to the next dot, dot kept; distinct, sorted."""
    rest = F.substring(F.col(col), len(scope) + 1, 1 << 20)
    return names.where(F.col(col).startswith(scope)).where(F.instr(rest, ".") > 0).select(F.concat(F.substring_index(rest, ".", 1), F.lit(".")).alias("child")).distinct().orderBy("child")


def groups(names: DataFrame, suffixes: list[str], col: str = "name") -> DataFrame:
    """Prefixes with which every suffix makes a name, by first appearance of the prefix in name order (`place`)."""
    each = [F.when(F.col(col).endswith(x), F.struct(F.expr(f"left({col}, length({col}) - {len(x)})").alias("prefix"), F.lit(i).alias("i"))) for i, x in enumerate(suffixes)]
    rows = names.select(F.col(col), F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("m")).select(col, "m.*")
    found = rows.groupBy("prefix").agg(F.count_distinct("i").alias("n"), F.min(col).alias("place")).where(F.col("n") == len(set(suffixes)))
    return found.orderBy("place", "prefix").select("prefix")


def by_group(prefixes: Iterable[str], body: Callable[[str], Expr]) -> dict[str, Expr]:
    """The body's expression for each group or scope, to be evaluated in one pass."""
    return {p: body(p) for p in prefixes}


def resolve(names: list[str], wanted: str, scope: str = "", group: str = "") -> str | None:
    """A signal's full name: as written, in the scope, in the group; else exact last parts, the last component, any substring, by declaration order."""
    have = set(names)
    for n in (wanted, scope + wanted, group + wanted):
        if n in have:
            return n
    last = wanted.rsplit(".", 1)[-1]
    tests = [lambda n: n.endswith("." + wanted)]
    if len(last) <= 8 or "." not in wanted:
        tests.append(lambda n: n.rsplit(".", 1)[-1] == last or n.rsplit(".", 1)[-1].split(" ")[0] == last)
    tests.append(lambda n: wanted in n)
    for t in tests:
        for n in names:
            if t(n):
                return n
    return None
