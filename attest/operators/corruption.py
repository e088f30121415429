"""Negative controls: eight ways to spoil a stream, each of which the checks must notice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def dropped_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], index: int) -> DataFrame:
    return _indexed(df, keys, order).where(F.col("_i") != index).drop("_i")


def conflicting_duplicate(df: DataFrame, keys: Sequence[str], order: Sequence[str], index: int, value: str, by: float = 0.001) -> DataFrame:
    """Row `index` twice, the second time with another value."""
    marked = _indexed(df, keys, order)
    return marked.unionByName(marked.where(F.col("_i") == index).withColumn(value, F.col(value) + by)).drop("_i")


def missing_channel(df: DataFrame, channel: str, name: str) -> DataFrame:
    return df.where(F.col(channel) != name)


def out_of_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, first: int = 0) -> DataFrame:
    """The times of rows `first` and `first` + 1 exchanged; the order columns stay."""
    w = W.partitionBy(*keys).orderBy(*order)
    marked = _indexed(df, keys, order).withColumn("_next", F.lead(time).over(w)).withColumn("_before", F.lag(time).over(w))
    swapped = F.when((F.col("_i") == first) & F.col("_next").isNotNull(), F.col("_next")).when(F.col("_i") == first + 1, F.col("_before")).otherwise(F.col(time))
    return marked.withColumn(time, swapped).drop("_i", "_next", "_before")


def wrong_id(df: DataFrame, column: str, old: Column, new: Column) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))


def stale_tail(df: DataFrame, time: str, end: Column, max_age: Column) -> DataFrame:
    """All rows of the last stretch before the end gone."""
    return df.where(F.col(time) < end - max_age)


def terminal_tamper(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, new: str) -> DataFrame:
    """The last row's state replaced."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])) == 1
    return df.withColumn("_last", last).withColumn(state, F.when(F.col("_last"), F.lit(new)).otherwise(F.col(state))).drop("_last")


def digest_tamper(df: DataFrame, digest: str) -> DataFrame:
    """The first character of each digest changed."""
    head = F.when(F.substring(digest, 1, 1) == "0", "1").otherwise("0")
    return df.withColumn(digest, F.concat(head, F.col(digest).substr(F.lit(2), F.length(digest))))
