"""The corpus pipeline: from raw documents to a mixed training set, each stage written as Parquet and read by the next.

Stages, each by one operator of attest.llm, each over all rows its predecessor kept:

1. toxicity: a model fitted on the labelled rows scores every text; documents with a score of 0.5 or more go.
2. near_duplicates: word-shingle MinHash (five words, similarity 0.8 or more); of each group the least doc_id stays.
3. substrings: runs of 20 words or more that also start earlier are cut from the texts; a document left without words goes.
4. decontamination: benchmark passages (10 words) are cut; a document with more than half of its words hit goes.
5. mixing: sources mixed to their target weights: the texts themselves, once for each copy, cut where a source ends.

All return the columns of documents (n_chars follows the text), the last also _copy.

Defined results, at every stage: an empty table gives an empty one; a null or empty text is clean and its row stays (the
mixture takes no words of it, so it is not in the mix); a row with a null doc_id is scored and searched for benchmark
passages, is linked with nothing, loses no repeats, and stays; equal rows stay or go alike; different texts should not share
a doc_id: as near duplicates they are one, elsewhere each is judged by itself; long texts are read whole; further columns,
whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import decontam, fmindex, mixing, neardup, toxicity
from attest.llm.store import Scratch, fresh, table

#: A stage's rows depend on trained models and on components: SQL cannot express them; tests/llm holds brute-force versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    name = fresh(docs.columns, "_toxicity")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words, gone = fresh(docs.columns, "_n_words"), fresh(docs.columns, "_n_removed")
    cut = fmindex.remove(docs, counts=(words, gone))
    return cut.where((F.col(gone) < F.col(words)) | (F.col(words) == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_substrings),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
