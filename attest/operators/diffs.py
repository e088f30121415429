"""Comparing tables: keyed differences, set equality, the first difference, tolerant comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import close


def keyed_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """keys, change (added, removed, changed) and the changed columns' names; equal rows are absent. Keys are unique per side."""
    a = before.select(*keys, F.struct(*columns).alias("_a"))
    b = after.select(*keys, F.struct(*columns).alias("_b"))
    kinds = dict(before.dtypes)

    def differs(c: str):
        x, y = F.col("_a").getField(c), F.col("_b").getField(c)
        return ~close(x, y, tolerance, 0.0) if tolerance and kinds[c] in ("double", "float") else ~x.eqNullSafe(y)

    names = F.filter(F.array(*[F.when(differs(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    out = a.join(b, list(keys), "full").withColumn("columns", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), names).otherwise(F.array().cast("array<string>")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("columns") > 0, "changed")
    return out.withColumn("change", change).where("change is not null").select(*keys, "change", F.array_join("columns", ",").alias("columns"))


def set_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a not in b, of b not in a (repeats count), and whether both are none."""
    x, y = a.exceptAll(b).agg(F.count("*").alias("only_first")), b.exceptAll(a).agg(F.count("*").alias("only_second"))
    return x.crossJoin(y).withColumn("equal", F.expr("only_first = 0 and only_second = 0"))  # one row each


def first_difference(a: DataFrame, b: DataFrame, path: str, value: str) -> DataFrame:
    """The least path at which two (path, value) tables differ, with both values; no row where they agree."""
    joined = a.select(path, F.col(value).alias("first")).join(b.select(path, F.col(value).alias("second")), path, "full").where("not (first <=> second)")
    return joined.agg(F.min(F.struct(path, "first", "second")).alias("d")).where("d is not null").select("d.*")


def bijection_issues(mapping: DataFrame, domain: DataFrame, codomain: DataFrame, source: str, target: str) -> DataFrame:
    """Why a correspondence is not one to one and onto: (kind, item) rows."""
    of = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("item"))
    twice = lambda c: mapping.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    return (
        of("not_mapped", domain.join(mapping, source, "left_anti"), source)
        .unionByName(of("not_reached", codomain.join(mapping, target, "left_anti"), target))
        .unionByName(of("mapped_twice", twice(source), source))
        .unionByName(of("reached_twice", twice(target), target))
        .unionByName(of("unknown_source", mapping.join(domain, source, "left_anti"), source))
        .unionByName(of("unknown_target", mapping.join(codomain, target, "left_anti"), target))
    )
