"""Mixing sources to target weights: hash-random order inside each source, distributed prefix sums, exact cuts.

Every document gets a random key from a hash of its id and the seed. Inside a source the documents stand in key order;
the mix takes a source's whole order as often as its budget holds it, and of the next round a prefix that ends exactly
at the budget: the document at the cut gives only its first words. So each source gives floor(target) words.

Prefix sums are taken in two levels, so that no source, however large, is gathered: the key's range is cut into 4096
equal parts by its first three hex digits (keys are uniform), bucket sums are pre-aggregated before their shuffle, the
prefix sums over at most 4096 sums of a source start each bucket, and a window inside a (source, bucket) does the rest.

Defined results: null texts have size 0 and take 0; a null source is a source of its own, last in order; equal ids get
equal keys and are told apart by size, repeated rows each count; an empty table gives an empty result. Further columns
of the documents, whatever their names, are kept apart and carried along. With no words at all every target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import fresh

DIGITS = 3
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
OWN = "_own"


def word_count(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    A source stops at cap times its size and the excess is shared anew by weight. That is water filling: with sources in
    order of cap * size / weight, the first m are at their cap, where m is the least number for which the level
    (total - caps of the first m) / (weights of the others) does not lift the next source above its cap.
    """
    n = len(weights)
    order = W.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumn("bound", cap * F.col("source_size"))
    ratio = F.col("bound") / F.col("weight")
    before = W.orderBy(ratio, F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(ratio, F.col("source").isNull(), "source").rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    step = ranked.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after)).withColumn("ratio", ratio)
    # the first source in that order whose cap is above its level sets the level of itself and all behind it
    least = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("isnull"), "source", "level"))).over(whole)
    return step.withColumn("least", least).select(
        "source",
        "source_size",
        F.when(F.col("least").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("weight") * F.col("least.level"))).alias("target"),
    )


def mix(docs: DataFrame, seed: int = 7, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies (whole rounds), tail (words of the next) and OWN, the document."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    # a key without nulls, so that the join and the window below share one shuffle
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("s")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(OWN)
    rows = docs.select("doc_id", "source", named, word_count().alias("size"), own).withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS))
    sums = rows.groupBy("s", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, cap, weights)
    goals = goals.select(named, "source_size", "target")
    joined = rows.join(starts.select("s", "bucket", "start").join(goals, "s"), ["s", "bucket"])
    inside = W.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    copies = F.when(F.col("target") >= cap * F.col("source_size"), F.lit(int(cap))).otherwise(F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    rest = F.floor(F.col("target")).cast("long") - F.col("copies") * F.col("source_size")
    return (
        joined.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("copies", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(copies).cast("long"))
        .withColumn("tail", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("tail")).alias("taken"), "copies", "tail", OWN)
    )


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed training set: a row with the documents' columns and _copy (from 1; with more underscores where that is taken) for each time that mix() takes words of a document.

    Whole rounds give the text as it is, and so does the last round up to the cut; the document at the cut gives its
    first words, joined by one space. n_chars follows the text. A document without words gives no row.
    """
    own = lambda c: F.col(OWN).getField(c)
    mixed = mix(docs, **how).where("taken > 0").select(OWN, "size", "copies", "tail", F.explode(F.sequence(F.lit(1), (F.col("copies") + F.when(F.col("tail") > 0, 1).otherwise(0)).cast("int"))).alias("copy"))
    cut = (F.col("copy") > F.col("copies")) & (F.col("tail") < F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all(own("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("tail").cast("int")), " ")
    texts = mixed.withColumn("said", F.when(cut, first).otherwise(own("text")))
    return texts.select(*[(F.col("said") if c == "text" else F.length("said").cast("long") if c == "n_chars" else own(c)).alias(c) for c in docs.columns], F.col("copy").cast("long").alias(fresh(docs.columns, "_copy")))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
