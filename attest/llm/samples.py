"""Bounded samples of labelled rows for fitting, and the fixed folds by crc32 of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(folds: int, id_column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % folds


def labelled(docs: DataFrame, labels: DataFrame, label: str, k: int, most_bytes: int, seed: int = 11, extra: tuple[str, ...] = (), most_values: int = 256) -> list:
    """At most k rows per value of `label` from labels (doc_id, label), those with the least id hashes, with their texts.

    Only texts of 1 to most_bytes bytes are picked, and equal texts once, so at most k * most_bytes bytes per value come
    to the driver, of at most the most_values commonest values. k is at most 1000, up to which Spark prunes each partition
    before the shuffle.
    """
    assert k <= 1000
    fits = F.octet_length("text").between(1, most_bytes)
    order = W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label).join(docs.where(fits).select("doc_id"), "doc_id", "left_semi")
    common = known.groupBy(label).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), label).limit(most_values).select(label)
    picked = known.join(F.broadcast(common), label, "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    # at most k ids per value: a proven bound
    texts = docs.where(fits).select("doc_id", "text", *extra).join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id")
    seen: dict[str, object] = {}
    for r in sorted(texts.collect(), key=lambda r: (r["doc_id"], r["text"])):
        seen.setdefault(r["text"], r)
    return list(seen.values())
