"""Scoring predictions against references: confusion, precision, recall, F1, intervals, tolerant comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import close, ratio, wilson
from ..functions.status import STATUSES


def confusion(scored: DataFrame, actual: str, predicted: str, labels: Sequence = STATUSES) -> DataFrame:
    """actual x predicted over fixed labels, with zeros."""
    spark = scored.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], f"{actual} {scored.schema[actual].dataType.simpleString()}, {predicted} {scored.schema[predicted].dataType.simpleString()}")
    counts = scored.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, [actual, predicted], "left").select(actual, predicted, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_scores(scored: DataFrame, actual: str, predicted: str, labels: Sequence = STATUSES) -> DataFrame:
    """Per label: true and false positives, false negatives, precision, recall and F1, each null where its denominator is 0."""
    sums = []
    for i, c in enumerate(labels):
        hit, said, was = F.col(predicted).eqNullSafe(c) & F.col(actual).eqNullSafe(c), F.col(predicted).eqNullSafe(c), F.col(actual).eqNullSafe(c)
        sums += [F.count_if(hit).alias(f"tp{i}"), F.count_if(said & ~hit).alias(f"fp{i}"), F.count_if(was & ~hit).alias(f"fn{i}")]
    row = scored.agg(*sums)
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, c in enumerate(labels)])
    out = row.select(F.explode(each).alias("s")).select("s.*")
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_f1(scored: DataFrame, actual: str, predicted: str, labels: Sequence = STATUSES) -> DataFrame:
    """Mean F1 over labels that have one."""
    return label_scores(scored, actual, predicted, labels).agg(F.avg("f1").alias("macro_f1"))


def agreement(scored: DataFrame, correct, keys: Sequence[str] = ()) -> DataFrame:
    """Per group: n, correct, accuracy and its Wilson interval."""
    out = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"))
    return out.withColumn("accuracy", ratio(F.col("n_correct"), F.col("n"))).withColumn("lower", wilson(F.col("n_correct"), F.col("n"), False)).withColumn("upper", wilson(F.col("n_correct"), F.col("n"), True))


def answers(key: DataFrame, given: DataFrame, on: str, expected: str, answer: str, absolute: float = 1e-9, relative: float = 1e-9) -> DataFrame:
    """Every question of the key as correct, wrong or missing, and answers to unknown questions as unexpected."""
    numeric = dict(key.dtypes)[expected] in ("double", "float")
    joined = key.select(on, F.col(expected).alias("_e"), F.lit(True).alias("_k")).join(given.select(on, F.col(answer).alias("_a"), F.lit(True).alias("_g")), on, "full")
    same = close(F.col("_e"), F.col("_a"), absolute, relative) if numeric else F.col("_e").eqNullSafe(F.col("_a"))
    return joined.select(on, F.when(F.col("_k").isNull(), "unexpected").when(F.col("_g").isNull(), "missing").when(same, "correct").otherwise("wrong").alias("result"))


def inventory_equal(scored: DataFrame, unscored: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """One row: whether scored and unscored are disjoint and together are what was predicted."""
    both = scored.select(key).intersect(unscored.select(key)).agg(F.count("*").alias("n_both"))
    all_ = scored.select(key).union(unscored.select(key)).distinct()
    lacking = all_.exceptAll(predicted.select(key).distinct()).agg(F.count("*").alias("n_not_predicted"))
    extra = predicted.select(key).distinct().exceptAll(all_).agg(F.count("*").alias("n_not_listed"))
    return both.crossJoin(lacking).crossJoin(extra).withColumn("equal", F.expr("n_both + n_not_predicted + n_not_listed = 0"))  # one row each
