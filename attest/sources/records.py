"""Record sources and sinks: evidence files, scene documents, JSON output, point reads, and adapters by name."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .traces import ADAPTERS, has_label, import_traces

SCENE = """scene_id STRING, world_frame STRING, gravity STRUCT<vector: ARRAY<DOUBLE>>,
frames MAP<STRING, STRUCT<parent: STRING, xyz: ARRAY<DOUBLE>, quaternion: ARRAY<DOUBLE>>>,
objects MAP<STRING, STRUCT<parent: STRING, xyz: ARRAY<DOUBLE>, quaternion: ARRAY<DOUBLE>>>"""
EVIDENCE = "source_id STRING, clock STRING, records ARRAY<STRUCT<record_id: STRING, subject: STRING, predicate: STRING, value: BOOLEAN, observed_at: BIGINT>>"


def read_scenes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scene documents (raw) to frames and objects (scene, name, parent, xyz, quaternion), and rejected ones (raw, why)."""
    parsed = documents.withColumn("s", F.from_json("raw", SCENE))
    why = F.when(has_label(F.col("raw")), "label").when(F.col("s.scene_id").isNull() | F.col("s.world_frame").isNull(), "syntax").when(F.array_contains(F.map_keys(F.coalesce("s.frames", F.create_map().cast("map<string,struct<parent:string,xyz:array<double>,quaternion:array<double>>>"))), F.col("s.world_frame")), "world_declared")
    judged = parsed.withColumn("why", why)
    good = judged.where("why is null")
    part = lambda c, name: good.select(F.col("s.scene_id").alias("scene"), F.explode(f"s.{c}").alias(name, "v")).select("scene", name, "v.parent", "v.xyz", "v.quaternion")
    return part("frames", "frame"), part("objects", "object"), judged.where("why is not null").select("raw", "why")


def read_evidence(documents: DataFrame, declared: DataFrame, root: str, clock: str) -> tuple[DataFrame, DataFrame]:
    """Evidence files (path, raw) to records of the accepted ones, and (path, issue) of all others.

    declared: path, digest. A file must be declared, lie under root, have its declared digest and the clock, and no labels; record
    ids must be unique over all files.
    """
    d = documents.join(declared, "path", "full").withColumn("e", F.from_json("raw", EVIDENCE))
    issue = (
        F.when(F.col("raw").isNull(), "missing").when(F.col("digest").isNull(), "not_declared").when(~F.startswith(F.col("path"), F.lit(root.rstrip("/") + "/")) | F.contains(F.col("path"), F.lit("..")), "path_outside")
        .when(F.sha2("raw", 256) != F.col("digest"), "tampered").when(has_label(F.col("raw")), "label").when(F.col("e.source_id").isNull(), "syntax").when(F.col("e.clock") != clock, "other_clock")
    )
    judged = d.withColumn("issue", issue)
    rows = judged.where("issue is null").select("path", "e.source_id", F.explode("e.records").alias("r")).select("path", "source_id", "r.*")
    twice = rows.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")
    lost = rows.join(twice, "record_id", "left_semi").select("path", F.lit("record_repeated").alias("issue")).distinct()
    return rows.join(twice, "record_id", "left_anti"), judged.where("issue is not null").select("path", "issue").unionByName(lost)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with their keys sorted and nulls kept."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def point_read(spark: SparkSession, path: str, column: str, ids: list) -> DataFrame:
    """Rows of a few ids from a Parquet folder: the filter reaches the scan, whose row groups' bounds skip the rest."""
    return spark.read.parquet(path).where(F.col(column).isin(*ids))


#: Adapters beside those of traces.ADAPTERS: from documents (path, raw) to what import_traces gives.
_MORE: dict[str, Callable[[DataFrame], tuple]] = {}


def register_adapter(name: str, adapt: Callable[[DataFrame], tuple]) -> None:
    """A further adapter by name; a name counts once."""
    if name in ADAPTERS or name in _MORE:
        raise ValueError(f"adapter {name} is there already")
    _MORE[name] = adapt


def adapter_names() -> list[str]:
    return sorted([*ADAPTERS, *_MORE])


def adapter_for(name: str) -> Callable[[DataFrame], tuple]:
    """The adapter of a name, built in or registered."""
    if name in ADAPTERS:
        return lambda documents: import_traces(documents, name)
    if name not in _MORE:
        raise ValueError(f"unknown adapter {name}; there are {adapter_names()}")
    return _MORE[name]


def content_addressed(rows: DataFrame, column: str, files: DataFrame) -> DataFrame:
    """rows with the paths in `column` replaced by sha256:<digest> of files (path, digest); a path without a file stays."""
    f = files.select(F.col("path").alias("_p"), F.col("digest").alias("_d"))
    out = rows.join(f, F.col(column) == F.col("_p"), "left")
    return out.withColumn(column, F.when(F.col("_d").isNotNull(), F.concat(F.lit("sha256:"), "_d")).otherwise(F.col(column))).drop("_p", "_d")


def canonical_xml(text):
    """XML text in canonical form: attributes sorted, blank text dropped, numbers in attributes in one spelling; null if it is no XML."""
    def number(v: str) -> str:
        try:
            return " ".join(repr(float(x)) for x in v.split()) if v.strip() else v
        except ValueError:
            return v

    def write(e) -> str:
        inner = (e.text or "").strip() + "".join(write(c) + (c.tail or "").strip() for c in e)
        return f"<{e.tag}" + "".join(f' {k}="{number(v)}"' for k, v in sorted(e.attrib.items())) + f">{inner}</{e.tag}>"

    @F.pandas_udf("string")
    def of(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            try:
                out.append(None if t is None else write(ET.fromstring(t)))
            except ET.ParseError:
                out.append(None)
        return pd.Series(out, dtype="object")

    return of(text)


