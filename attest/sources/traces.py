"""Episode traces: JSON documents of many runs into channel tables, with the gate against labels and unknown keys.

A trace is one JSON document (a file each) or one line of a JSONL file. Rows keep their place as sample_index; absent
values are null. A document that holds a label under any key, at any depth, is rejected with its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keys that carry labels, compared without case.
LABEL_KEYS = (
    "reward",
    "rewards",
    "success",
    "is_success",
    "official_success",
    "oracle",
    "oracle_result",
    "evaluator",
    "evaluator_result",
    "task_success",
)
LABEL_PATTERN = r'(?i)"(' + "|".join(LABEL_KEYS) + r')"\s*:'

# The trace document's fields.
TRACE = """run_id STRING, simulator STRUCT<name: STRING, version: STRING>, seed BIGINT, timestep_s DOUBLE,
clock STRUCT<clock_id: STRING, domain: STRING>, interval STRUCT<start_s: DOUBLE, end_s: DOUBLE>, task_id STRING,
intervention STRING, robot STRING, world STRUCT<world_id: STRING, world_sha256: STRING, measurements: MAP<STRING, DOUBLE>>,
conventions STRUCT<length_unit: STRING, angle_unit: STRING, quaternion_order: STRING, pose_direction: STRING>,
channel_policies MAP<STRING, STRUCT<max_gap_s: DOUBLE>>,
samples STRUCT<
  joint_state: ARRAY<STRUCT<time_s: DOUBLE, positions: MAP<STRING, DOUBLE>, velocities: MAP<STRING, DOUBLE>, efforts: MAP<STRING, DOUBLE>>>,
  pose: ARRAY<STRUCT<time_s: DOUBLE, entities: MAP<STRING, STRUCT<position_m: ARRAY<DOUBLE>, quaternion_xyzw: ARRAY<DOUBLE>, linear_velocity_mps: ARRAY<DOUBLE>, angular_velocity_radps: ARRAY<DOUBLE>>>>>,
  odometry: ARRAY<STRUCT<time_s: DOUBLE, entity: STRING, position_m: ARRAY<DOUBLE>, quaternion_xyzw: ARRAY<DOUBLE>, linear_velocity_mps: ARRAY<DOUBLE>, angular_velocity_radps: ARRAY<DOUBLE>>>,
  contact: ARRAY<STRUCT<time_s: DOUBLE, body_a: STRING, body_b: STRING, active: BOOLEAN, normal_force_n: DOUBLE, force_n: ARRAY<DOUBLE>>>,
  collision: ARRAY<STRUCT<time_s: DOUBLE, body_a: STRING, body_b: STRING, active: BOOLEAN>>,
  force_torque: ARRAY<STRUCT<time_s: DOUBLE, sensor: STRING, force_n: ARRAY<DOUBLE>, torque_nm: ARRAY<DOUBLE>>>,
  deformable: ARRAY<STRUCT<time_s: DOUBLE, entity: STRING, keypoints_m: ARRAY<ARRAY<DOUBLE>>>>>,
events ARRAY<STRING>"""


def has_label(text: Column) -> Column:
    """Whether JSON text holds a key of LABEL_KEYS at any depth."""
    return F.coalesce(text.rlike(LABEL_PATTERN), F.lit(False))


def read_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, raw): one row per file, or per line."""
    return spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def parse(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (raw) to accepted traces and rejected ones (raw, why)."""
    parsed = documents.withColumn("t", F.from_json("raw", TRACE))
    why = (
        F.when(has_label(F.col("raw")), "label")
        .when(F.col("t").isNull() | F.col("t.run_id").isNull() | F.col("t.samples").isNull(), "syntax")
        .when((F.coalesce(F.col("t.timestep_s"), F.lit(0.0)) <= 0), "timestep")
        .when((F.coalesce(F.col("t.conventions.quaternion_order"), F.lit("xyzw")) != "xyzw") | (F.coalesce(F.col("t.conventions.pose_direction"), F.lit("world_from_entity")) != "world_from_entity"), "conventions")
    )
    judged = parsed.withColumn("why", why)
    return judged.where("why is null").select("t.*"), judged.where("why is not null").select("raw", "why")


def accepts(simulator: Column, tokens: list[str]) -> Column:
    """Whether the declared simulator's name contains one of an adapter's tokens."""
    return F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(F.lower(simulator), t))


#: Adapters by name: what a declared simulator's name must contain; none means any.
ADAPTERS = {"generic": [], "maniskill": ["maniskill", "sapien"], "mujoco": ["mujoco"], "gazebo": ["gazebo"], "deformable": ["deformable", "soft"]}


def import_traces(documents: DataFrame, adapter: str = "generic") -> tuple[DataFrame, dict[str, DataFrame], DataFrame, DataFrame]:
    """runs, channel tables, events and rejected documents of an adapter's traces.

    Quaternions are normalised; a run without a declared interval spans all its sample times.
    """
    traces, rejected = parse(documents)
    tokens = ADAPTERS[adapter]
    if tokens:
        ok = accepts(F.col("simulator.name"), tokens)
        rejected = rejected.unionByName(traces.where(~F.coalesce(ok, F.lit(False))).select(F.to_json(F.struct("run_id", "simulator")).alias("raw"), F.lit("simulator").alias("why")))
        traces = traces.where(ok)

    def rows(channel: str) -> DataFrame:
        return traces.select("run_id", F.posexplode(f"samples.{channel}").alias("sample_index", "s"))

    def unit(q: Column) -> Column:
        n = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(n > 1e-12, F.transform(q, lambda x: x / n)).otherwise(q)

    joint = rows("joint_state").withColumn("joint_id", F.explode(F.array_distinct(F.concat(*[F.coalesce(F.map_keys(F.col(f"s.{c}")), F.array().cast("array<string>")) for c in ("positions", "velocities", "efforts")]))))
    pair = ["s.time_s", "s.body_a", "s.body_b", "s.active"]
    moving = lambda e: [F.col(f"{e}.position_m").alias("position"), unit(F.col(f"{e}.quaternion_xyzw")).alias("quaternion"), F.col(f"{e}.linear_velocity_mps").alias("linear_velocity"), F.col(f"{e}.angular_velocity_radps").alias("angular_velocity")]
    tables = {
        "joint_state": joint.select("run_id", "sample_index", "s.time_s", "joint_id", *[F.col(f"s.{a}")[F.col("joint_id")].alias(b) for a, b in (("positions", "position"), ("velocities", "velocity"), ("efforts", "effort"))]),
        "pose": rows("pose").select("run_id", "sample_index", "s.time_s", F.explode("s.entities").alias("entity_id", "e")).select("run_id", "sample_index", "time_s", "entity_id", *moving("e")),
        "odometry": rows("odometry").select("run_id", "sample_index", "s.time_s", F.col("s.entity").alias("entity_id"), *moving("s")),
        "contact": rows("contact").select("run_id", "sample_index", *pair, "s.normal_force_n", "s.force_n"),
        "collision": rows("collision").select("run_id", "sample_index", *pair),
        "force_torque": rows("force_torque").select("run_id", "sample_index", "s.time_s", F.col("s.sensor").alias("sensor_id"), "s.force_n", "s.torque_nm"),
        "deformable": rows("deformable").select("run_id", "sample_index", "s.time_s", F.col("s.entity").alias("entity_id"), F.col("s.keypoints_m").alias("keypoints")),
    }
    times = F.flatten(F.array(*[F.coalesce(F.transform(F.col(f"samples.{c}"), lambda s: s.time_s), F.array().cast("array<double>")) for c in tables]))
    runs = traces.select(
        "run_id", "task_id", "seed", "timestep_s", F.col("simulator.name").alias("simulator"),
        F.coalesce("interval.start_s", F.array_min(times)).alias("start_s"), F.coalesce("interval.end_s", F.array_max(times)).alias("end_s"),
        F.transform_values("channel_policies", lambda _, v: v.max_gap_s).alias("max_gap"), F.col("world.measurements").alias("measurements"), "intervention",
        F.filter(F.array(*[F.when(F.size(f"samples.{c}") >= 0, F.lit(c)) for c in tables]), lambda c: c.isNotNull()).alias("channels"),
    )
    events = traces.select("run_id", F.posexplode("events").alias("event_index", "raw")).select("run_id", "event_index", F.get_json_object("raw", "$.time_s").cast("double").alias("time_s"), F.get_json_object("raw", "$.type").alias("type"), F.get_json_object("raw", "$.status").alias("status"), "raw")
    return runs, tables, events, rejected


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSONL event logs to events (path, time_s, type, status, raw) and rejected lines (path, raw, why)."""
    lines = read_documents(spark, path, lines=True).where("raw <> ''")
    time = F.get_json_object("raw", "$.time_s").cast("double")
    kind = F.get_json_object("raw", "$.type")
    why = F.when(has_label(F.col("raw")), "label").when(F.try_parse_json("raw").isNull(), "syntax").when(time.isNull() | (time < 0) | F.isnan(time), "time").when(kind.isNull(), "type")
    judged = lines.withColumn("why", why)
    return judged.where("why is null").select("path", time.alias("time_s"), kind.alias("type"), F.get_json_object("raw", "$.status").alias("status"), "raw"), judged.where("why is not null").select("path", "raw", "why")


def write_channels(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per channel, rows of a run together, so that later reads prune channels and columns."""
    for name, rows in tables.items():
        rows.repartition("run_id").sortWithinPartitions("run_id", "sample_index").write.mode("overwrite").parquet(f"{path}/{name}")


def read_channel(spark: SparkSession, path: str, channel: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{channel}")


def content_digest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the digest of its rows' canonical text in order: content, not bytes of files."""
    line = F.to_json(F.struct(*sorted(set(rows.columns) - set(keys))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda x: x._line), "\n"), 256).alias("digest"))


def verify(manifest: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Declared digests against recomputed ones: keys, and intact, tampered, missing or unexpected."""
    a, b = manifest.select(*keys, F.col("digest").alias("_m")), actual.select(*keys, F.col("digest").alias("_a"))
    out = a.join(b, keys, "full")
    return out.select(*keys, F.when(F.col("_m").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(F.col("_m") == F.col("_a"), "intact").otherwise("tampered").alias("state"))
