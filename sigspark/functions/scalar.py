"""The language's scalar functions as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def power(a: Column, b: Column) -> Column:
    """Of integers, an integer where 0 <= b <= 20 and it fits; else a double. One Column has one type, so this is a double that is whole where the integer fits."""
    return F.pow(a.cast("double"), b.cast("double"))


def power_int(a: Column, b: Column) -> Column:
    """The integer power; null where the exponent is out of 0 to 20 or the result out of 64 bits."""
    p = F.pow(a.cast("double"), b.cast("double"))
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(b, F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda acc, i: F.when(i <= b, (acc * a).cast("decimal(38,0)")).otherwise(acc))
    return F.when((b >= 0) & (b <= 20) & (F.abs(p) < 9.2e18), exact.cast("long"))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign."""
    return a.cast("long") % b.cast("long")


def round_away(x: Column) -> Column:
    """To the nearest integer, halves away from zero."""
    return F.round(x).cast("long")


def bit_slice(n: Column, high: int, low: int | None = None) -> Column:
    low = high if low is None else low
    return F.shiftrightunsigned(n, low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1))


def to_bin(n: Column, width: int | None = None) -> Column:
    """Binary digits, padded with zeros on the left, never cut; negatives in 64 bits."""
    b = F.bin(n)
    return b if width is None else F.when(F.length(b) < width, F.lpad(b, width, "0")).otherwise(b)


def bits_to_signed(bits: Column) -> Column:
    """Two's complement of up to 64 binary digits; null for anything else."""
    wide = F.conv(bits, 2, 10).cast("decimal(20,0)")
    full = F.aggregate(F.sequence(F.lit(1), F.length(bits)), F.lit(1).cast("decimal(21,0)"), lambda a, _: (a * 2).cast("decimal(21,0)"))
    return F.when(bits.rlike("^[01]{1,64}$"), F.when(bits.startswith("1"), wide - full).otherwise(wide).cast("long"))


def integer_range(start: Column, end: Column, step: int = 1) -> Column:
    """start to end, end exclusive; empty for step 0 or where nothing lies between."""
    if step == 0:
        return F.array().cast("array<bigint>")
    some = (start < end) if step > 0 else (start > end)
    return F.when(some, F.sequence(start.cast("long"), end.cast("long") - (1 if step > 0 else -1), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def text_slice(s: Column, first: int, end: int | None = None) -> Column:
    """A character, or [first, end)."""
    return F.substring(s, first + 1, 1 if end is None else end - first)


def list_slice(a: Column, first: int, end: int) -> Column:
    return F.slice(a, first + 1, max(0, end - first))


def rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def zipped(a: Column, b: Column) -> Column:
    """Pairs, as many as the shorter list has."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.array(x, y))


def fold(a: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(a, zero, merge)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)


def average(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def with_key(m: Column, key: Column, value: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def without_key(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def at_key(m: Column, key: Column, default: Column) -> Column:
    return F.when(F.map_contains_key(m, key), F.try_element_at(m, key)).otherwise(default)


def contains_all(a: Column, *needles: Column) -> Column:
    out = F.lit(True)
    for n in needles:
        out = out & F.array_contains(a, n)
    return out


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def type_name(kind: str) -> str:
    """The language's name for a Spark type."""
    k = kind.split("<")[0].split("(")[0]
    return {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "str", "boolean": "bool", "array": "list", "map": "list", "void": "NoneType"}.get(k, k)
