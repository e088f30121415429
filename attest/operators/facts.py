"""Facts as (subject, predicate, object) rows with content ids: building, indexing, retrieving, closed-world answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fact_id(*parts: str) -> Column:
    """Content id: SHA-256 of the parts, each with its length in front, null apart from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.length(F.col(p).cast("string")).cast("string"), F.lit(":"), F.col(p).cast("string")), F.lit("~")) for p in parts]), 256)


def facts_of(df: DataFrame, subject: Column, columns: Sequence[str]) -> DataFrame:
    """One fact per row and column that is not null: subject, predicate, object, fact_id."""
    pairs = F.array(*[F.struct(F.lit(c).alias("predicate"), F.col(c).cast("string").alias("object")) for c in columns])
    out = df.select(subject.alias("subject"), F.explode(pairs).alias("f")).select("subject", "f.predicate", "f.object").where("object is not null")
    return out.withColumn("fact_id", fact_id("subject", "predicate", "object"))


def write_facts(facts: DataFrame, path: str) -> None:
    """Facts by predicate, so that a retrieval by predicate reads one folder."""
    facts.write.partitionBy("predicate").parquet(path)


def retrieve(facts: DataFrame, limit: int, entity: str | None = None, predicate: str | None = None, fact: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `limit` facts by id that pass all filters; and one row with the counts before and after the filters on content.

    truncated compares the count by index (entity or fact) with the limit, before the predicate filter.
    """
    indexed = facts
    if entity is not None:
        indexed = indexed.where(F.col("subject") == entity)
    if fact is not None:
        indexed = indexed.where(F.col("fact_id") == fact)
    matched = indexed if predicate is None else indexed.where(F.col("predicate") == predicate)
    counts = indexed.agg(F.count("*").alias("n_indexed"), F.count_if(F.lit(True) if predicate is None else F.col("predicate") == predicate).alias("n_matched"))
    return matched.orderBy("fact_id").limit(limit), counts.withColumn("truncated", F.col("n_indexed") > limit)


def inverted_index(rows: DataFrame, key: str, item: str) -> DataFrame:
    """Per key the sorted distinct items. A list is one row: keys are meant to be bounded (entities, predicates of one artifact)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))


def closed_world(questions: DataFrame, facts: DataFrame, inventories: DataFrame, on: Sequence[str], scope: str) -> DataFrame:
    """yes where a fact matches; no only where the question's scope has a closed inventory; else unknown."""
    known = facts.select(*on).distinct().withColumn("_yes", F.lit(True))
    closed = inventories.select(scope).distinct().withColumn("_closed", F.lit(True))
    out = questions.join(known, list(on), "left").join(closed, scope, "left")
    return out.withColumn("answer", F.when(F.col("_yes"), "yes").when(F.col("_closed"), "no").otherwise("unknown")).drop("_yes", "_closed")


def evidence_id(source: Column, command: str, method: str, *parameters: Column) -> Column:
    """Id of a query's answer: hash of source, command, parameters and method."""
    return F.sha2(F.concat_ws("|", source, F.lit(command), *[p.cast("string") for p in parameters], F.lit(method)), 256)
