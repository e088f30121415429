"""Tables of the corpus: inputs, and those between the steps of an operator in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attest.sources.shared import Scratch  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], wanted: str) -> str:
    """`wanted`, with as many underscores behind it as tell it from all names (case counts for nothing)."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
