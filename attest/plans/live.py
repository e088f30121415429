"""Queries of the streaming operators: events read as a file stream, drained once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import checks as L
from .registry import EV, query, table
from .streams import DAY, HOUR, ORACLES as _BATCH


def _stream(spark, d):
    batch = table(spark, d, "events")
    folder = batch.inputFiles()[0].rsplit("/", 1)[0]
    one = not folder.endswith("events.parquet")  # a single file of the data folder, or a folder of its own
    reader = spark.readStream.schema(batch.schema)
    raw = reader.option("pathGlobFilter", "events.parquet").parquet(d) if one else reader.parquet(folder)
    return raw.withColumn("t", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"))


_ARRIVAL = EV + ", b AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS bt FROM ev) "


@query(_ARRIVAL + "SELECT user_id, event_id, CASE WHEN t < bt THEN 'out_of_order' ELSE 'gap' END AS issue, t-bt AS gap FROM b WHERE t < bt OR t-bt > 86400000000")
def stream_gap_state(spark, d):
    """event_id is the order of arrival: rows that come late, and gaps."""
    return L.drain(L.order_issues(_stream(spark, d), "user_id", "event_id", "t", DAY))


@query(_BATCH["carry_forward_snapshot"])
def stream_snapshot_state(spark, d):
    out = L.drain(L.snapshots(_stream(spark, d), "user_id", "event_id", "t", "event_type", "value", ["view", "click"], 12 * HOUR))
    return out.drop("user_id")


@query(EV + """, b AS (SELECT user_id, t, CASE WHEN t-lag(t) OVER w < 21600000000 THEN 0 ELSE 1 END AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t) AS g FROM b),
c AS (SELECT user_id, min(t) AS start_time, max(t) + 21600000000 AS end_time, count(*) AS n FROM g GROUP BY user_id, g) SELECT user_id, start_time, n FROM c WHERE end_time <= (SELECT max(t) // 1000 * 1000 - 3600000000 FROM ev)""")
def stream_session(spark, d):
    s = _stream(spark, d).withColumn("ts", F.timestamp_micros("t"))
    return L.drain(L.sessions(s, "user_id", "ts", "6 hours", "1 hour")).select("user_id", F.unix_micros("start").alias("start_time"), "n")
