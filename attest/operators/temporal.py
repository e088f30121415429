"""Streams in time: as-of selection, carried-forward state, islands, gaps, order and coverage checks.

A stream has key columns (run, channel, entity ...), a total order of its rows (`order`: sample index or time and id) and
a time. All operators are one shuffle on the keys; none joins on inequality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _over(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tie: str, carry: Sequence[str], max_age: float | None = None, prefix: str = "asof_") -> DataFrame:
    """Each left row with the latest right row of its keys at or before its time.

    Both sides go through one window of their union, so cost is one sort per key however far apart the rows are. Of right
    rows at one time the greatest `tie` wins. Adds prefix + column for `carry`, prefix + "age" and prefix + "status":
    current, stale (older than max_age) or missing. Rows after a left row's time are never used.
    """
    own = left.columns
    a = left.select(F.struct(*own).alias("_own"), *keys, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right.select(F.struct(time, *carry)).schema[0].dataType).alias("_right"))
    b = right.select(F.lit(None).cast(a.schema["_own"].dataType).alias("_own"), *keys, F.col(time).alias("_time"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(time, *carry).alias("_right"))
    w = W.partitionBy(*keys).orderBy("_time", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    age = F.col("_time") - F.col("_last").getField(time)
    status = F.when(F.col("_last").isNull(), "missing")
    if max_age is not None:
        status = status.when(age > max_age, "stale")
    return joined.select("_own.*", *[F.col("_last").getField(c).alias(prefix + c) for c in carry], age.alias(prefix + "age"), status.otherwise("current").alias(prefix + "status"))


def select_at(stream: DataFrame, keys: Sequence[str], time: str, tie: str, at: Column, carry: Sequence[str], max_age: float | None = None) -> DataFrame:
    """One query time for all: per key the latest row at or before it, its age and status, and how many later rows were ignored."""
    best = F.max_by(F.struct(time, *carry), F.when(F.col(time) <= at, F.struct(time, tie)))
    out = stream.groupBy(*keys).agg(best.alias("_b"), F.count_if(F.col(time) > at).alias("future_rows"))
    age = at - F.col("_b").getField(time)
    status = F.when(F.col("_b").isNull(), "missing")
    if max_age is not None:
        status = status.when(age > max_age, "stale")
    return out.select(*keys, *[F.col("_b").getField(c).alias(c) for c in carry], age.alias("age"), status.otherwise("current").alias("status"), "future_rows")


def carry_forward(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, channel: str, value: str, channels: Sequence[str], max_age: float | None = None) -> DataFrame:
    """At each row, the latest value of every channel so far, its age, and the snapshot's status: incomplete, stale or current."""
    w = _over(keys, order).rowsBetween(W.unboundedPreceding, 0)
    out = stream
    for c in channels:
        seen = F.last(F.when(F.col(channel) == c, F.struct(F.col(value).alias("v"), F.col(time).alias("t"))), ignorenulls=True).over(w)
        out = out.withColumn(f"_{c}", seen)
    ages = {c: F.col(time) - F.col(f"_{c}.t") for c in channels}
    oldest = F.greatest(*ages.values()) if len(channels) > 1 else ages[channels[0]]
    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(f"_{c}").isNotNull()
    status = F.when(~complete, "incomplete")
    if max_age is not None:
        status = status.when(oldest > max_age, "stale")
    out = out.withColumn("snapshot_status", status.otherwise("current"))
    for c in channels:
        out = out.withColumn(f"{c}_value", F.col(f"_{c}.v")).withColumn(f"{c}_age", ages[c])
    return out.drop(*[f"_{c}" for c in channels])


def islands(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, ok: Column) -> DataFrame:
    """Every maximal run of consecutive rows where `ok` holds: keys, first and last time, duration, rows, start_index. A null is not ok."""
    w = _over(keys, order)
    marked = stream.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_index", F.row_number().over(w) - 1)
    marked = marked.withColumn("_island", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        marked.where("_ok")
        .groupBy(*keys, "_island")
        .agg(F.min_by(time, "_index").alias("start_time"), F.max_by(time, "_index").alias("end_time"), F.count("*").alias("n_rows"), F.min("_index").alias("start_index"))
        .withColumn("duration", F.col("end_time") - F.col("start_time"))
        .drop("_island")
    )


def longest_island(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, ok: Column) -> DataFrame:
    """Per key the longest island, the latest of equal ones. One sample lasts 0; keys without an island are absent."""
    best = F.max_by(F.struct("start_time", "end_time", "duration", "n_rows", "start_index"), F.struct("duration", "start_index"))
    return islands(stream, keys, order, time, ok).groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def anchored_segment(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, value: str, tolerance: float) -> DataFrame:
    """Longest segment whose values stay within tolerance of its first one; of equal ones the latest. A null value ends every segment.

    Per key, in order: every start's segment is found by halving steps over tables of running extremes, n log n in all.
    """
    import numpy as np
    import pandas as pd

    kinds = ", ".join([f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys] + ["start_index long", "n_rows long", f"duration {stream.schema[time].dataType.simpleString()}"])

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable")
        t, v = pdf[time].to_numpy(), pdf[value].to_numpy(np.float64)
        high, low = np.where(np.isnan(v), np.inf, v), np.where(np.isnan(v), -np.inf, v)
        levels = [(high, low)]
        while 2 << len(levels) <= 2 * len(v):
            w = 1 << len(levels) - 1
            high, low = levels[-1]
            levels.append((np.maximum(high[:-w], high[w:]), np.minimum(low[:-w], low[w:])))
        start, n = np.arange(len(v)), np.zeros(len(v), np.int64)
        for k in range(len(levels) - 1, -1, -1):  # extend every segment by 2**k rows where they all stay near
            high, low = levels[k]
            at = np.minimum(start + n, len(high) - 1)
            fits = (start + n < len(high)) & (high[at] - v <= tolerance) & (v - low[at] <= tolerance)
            n[fits] += 1 << k
        some = np.flatnonzero(n)
        if not len(some):
            return pd.DataFrame([], columns=[*keys, "start_index", "n_rows", "duration"])
        length = t[some + n[some] - 1] - t[some]
        i = int(some[np.flatnonzero(length == length.max())[-1]])
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "start_index": i, "n_rows": int(n[i]), "duration": length.max()}])

    return stream.select(*{*keys, *order, time, value}).groupBy(*keys).applyInPandas(of, kinds)


def order_issues(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, identity: Sequence[str] = (), payload: Sequence[str] = (), max_gap: float | None = None) -> DataFrame:
    """Rows that break a stream's order, of adjacent rows only: out_of_order, conflicting_duplicate or gap, with the time before."""
    w = _over(keys, order)
    before = F.lag(F.struct(time, *identity, *payload)).over(w)
    marked = stream.withColumn("_before", before)
    t = F.col("_before").getField(time)
    same = F.col(time) == t
    for c in identity:
        same = same & F.col(c).eqNullSafe(F.col("_before").getField(c))
    differs = F.lit(False)
    for c in payload:
        differs = differs | ~F.col(c).eqNullSafe(F.col("_before").getField(c))
    issue = F.when(F.col(time) < t, "out_of_order").when(same & differs, "conflicting_duplicate")
    if max_gap is not None:
        issue = issue.when(F.col(time) - t > max_gap, "gap")
    return marked.withColumn("issue", issue).withColumn("before_time", t).where("issue is not null").drop("_before")


def coverage(stream: DataFrame, keys: Sequence[str], time: str, start: Column, end: Column, slack: float) -> DataFrame:
    """Per key whether its first sample comes more than slack after the start, and its last more than slack before the end."""
    out = stream.groupBy(*keys).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_rows"))
    return out.withColumn("incomplete_start", F.col("first_time") > start + slack).withColumn("incomplete_end", F.col("last_time") < end - slack)


def terminal(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, carry: Sequence[str], end: Column, max_age: float) -> DataFrame:
    """Per key its last row by order, its age at the end and whether that is over max_age."""
    last = F.max_by(F.struct(time, *carry), F.struct(*order))
    out = stream.groupBy(*keys).agg(last.alias("_l"))
    return out.select(*keys, F.col("_l").getField(time).alias(time), *[F.col("_l").getField(c).alias(c) for c in carry], (end - F.col("_l").getField(time)).alias("age"), (end - F.col("_l").getField(time) > max_age).alias("stale"))


def sequence_issues(rows: DataFrame, keys: Sequence[str], order: Sequence[str], number: str, first: int = 0) -> DataFrame:
    """Per key: rows, whether the numbers run on from `first` without a hole, and how often they do not."""
    expected = F.row_number().over(_over(keys, order)) - 1 + first
    return rows.withColumn("_bad", ~F.col(number).eqNullSafe(expected)).groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if("_bad").alias("n_breaks")).withColumn("contiguous", F.col("n_breaks") == 0)


def changes(stream: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before (begin and end of contact); the first row is a change from nothing."""
    before = F.lag(value).over(_over(keys, order))
    return stream.withColumn("before", before).where(~F.col(value).eqNullSafe(F.col("before")))
