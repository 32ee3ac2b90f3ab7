"""Bodies run at every match, as aggregates where the body allows it.

A body of updates `(set! v (+ v e))`, each perhaps under `(if c ...)` or `(when c ...)`, adds up e over the
matches. That is one aggregate, if no e or c reads a variable that the body changes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.lang.reader import Symbol
from sigspark.model import TraceSet
from sigspark.timeexpr import Expr, evaluated


@dataclass
class Update:
    name: str
    conditions: list[Any]  # forms
    amount: Any  # form


def updates(body: list[Any]) -> list[Update] | None:
    """The body as sums; None if it is anything else."""
    out: list[Update] = []

    def visit(form: Any, conds: list[Any]) -> bool:
        if not isinstance(form, list) or not form:
            return False
        head = form[0]
        if head == "do":
            return all(visit(f, conds) for f in form[1:])
        if head == "if" and len(form) == 3:
            return visit(form[2], [*conds, form[1]])
        if head == "when":
            return len(form) > 2 and all(visit(f, [*conds, form[1]]) for f in form[2:])
        if head in ("set!", "set"):
            target, value = (form[1:] if len(form) == 3 and isinstance(form[1], Symbol) else form[1] if len(form) == 2 and isinstance(form[1], list) and len(form[1]) == 2 else (None, None))
            if isinstance(target, Symbol) and isinstance(value, list) and len(value) == 3 and value[0] == "+" and target in value[1:]:
                amount = value[2] if value[1] == target else value[1]
                out.append(Update(target, conds, amount))
                return True
        return False

    if not body or not all(visit(f, []) for f in body):
        return None
    changed = {u.name for u in out}

    def reads(form: Any) -> bool:
        return form in changed if isinstance(form, Symbol) else isinstance(form, list) and any(map(reads, form))

    if any(reads(u.amount) or any(map(reads, u.conditions)) for u in out):
        return None
    return out


def sums(s: TraceSet, cond: Expr, parts: list[tuple[Expr, Expr]]) -> DataFrame:
    """One row, n, s0, s1, ...: the matches, and the sum of each amount over the matches at which its own condition holds too."""
    named = {"c": cond.true()} | {f"c{i}": c.true() for i, (c, _) in enumerate(parts)} | {f"a{i}": a for i, (_, a) in enumerate(parts)}
    df = evaluated(s, **named).where("c").withColumn("n", F.col("end_idx") - F.col("idx"))
    total = lambda i: F.sum(F.when(F.col(f"c{i}"), F.col(f"a{i}") * F.col("n")))
    return df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(total(i), F.lit(0)).alias(f"s{i}") for i in range(len(parts))])
