"""The folder that driver and executors share, and tables written there between steps."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local session (tests); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/attest-shared"
    return found.rstrip("/")


class Scratch:
    """Written tables of one call. put() cuts the lineage: a lost executor costs a read, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_folder(spark)}/attest-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._attest_path = path
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._attest_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.tables = [t for t in self.tables if t is not df]

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but those that the call's result reads."""
        self.drop(*(t for t in self.tables if not any(t is x for x in tables)))

    def sweep(self, *tables: DataFrame) -> None:
        """Drop tables and let Spark's cleaner find the shuffle files that no plan in use needs any more."""
        self.drop(*tables)
        gc.collect()
        self.spark._jvm.System.gc()
