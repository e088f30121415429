"""Scalar helpers: rounding, intervals of proportions, tolerant comparison, times, low-discrepancy digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def clean(x: Column) -> Column:
    """0 below 1e-12, else 12 decimals."""
    return F.when(F.abs(x) < 1e-12, F.lit(0.0)).otherwise(F.round(x, 12))


def finite(x: Column) -> Column:
    """True for a number that is neither NaN nor infinite; null for null."""
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def wilson(successes: Column, n: Column, upper: bool, z: float = Z95) -> Column:
    """Bound of the Wilson score interval, within [0, 1]; null where n is 0."""
    p, n = successes / n, n.cast("double")
    z2 = z * z
    centre = p + F.lit(z2) / (2 * n)
    spread = z * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    value = (centre + spread if upper else centre - spread) / (1 + F.lit(z2) / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def close(a: Column, b: Column, absolute: float = 0.0, relative: float = 1e-9) -> Column:
    """Within the greater of an absolute and a relative tolerance; null equals null only."""
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def nanoseconds(seconds: Column, latest: Column | None = None) -> Column:
    """Seconds to whole nanoseconds, half to even, at most `latest`."""
    ns = F.bround(seconds * 1e9).cast("long")
    return ns if latest is None else F.least(ns, latest)


def effective_timestamp(header: Column, receipt: Column) -> Column:
    """The header's time unless it is null or 0, then the time of receipt."""
    return F.coalesce(F.nullif(header, F.lit(0)), receipt)


def radical_inverse(index: Column, base: int, digits: int = 40) -> Column:
    """Halton digit: the index's digits in the base mirrored behind the point."""
    step = lambda acc, i: F.struct(F.floor(acc.n / base).alias("n"), (acc.f / base).alias("f"), (acc.x + acc.f / base * (acc.n % base)).alias("x"))
    start = F.struct(index.cast("long").alias("n"), F.lit(1.0).alias("f"), F.lit(0.0).alias("x"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda acc: acc.x)


def measured(literal: Column | None, measurement: Column | None = None, scale: float = 1.0, offset: float = 0.0) -> Column:
    """A literal, or a run's measurement times scale plus offset."""
    return literal if measurement is None else measurement * scale + offset


def last_part(path: Column) -> Column:
    """What stands behind the last slash of a typed id."""
    return F.substring_index(path, "/", -1)


def same_values(a: Column, b: Column, absolute: float = 0.0, relative: float = 1e-9) -> Column:
    """Arrays of numbers, place by place, within tolerance; another length is another value."""
    return F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: close(x, y, absolute, relative)), lambda x: x), F.lit(False))


def same_members(a: Column, b: Column) -> Column:
    """Arrays as collections: the same members as often, in any order."""
    return F.coalesce(F.array_sort(a) == F.array_sort(b), F.lit(False))


def same_rotation(a: Column, b: Column, absolute: float = 1e-9) -> Column:
    """Quaternions place by place within tolerance, where q and -q are the same rotation."""
    return same_values(a, b, absolute, 0.0) | same_values(a, F.transform(b, lambda x: -x), absolute, 0.0)


def holes(columns: list[str]) -> list[Column]:
    """Aggregates per column: values that are not a number, and nulls of a column that has values elsewhere in the group."""
    out = []
    for c in columns:
        out += [F.count_if(F.isnan(c)).alias(f"{c}_nan"), F.when(F.count(c) > 0, F.count("*") - F.count(c)).otherwise(0).alias(f"{c}_holes")]
    return out
