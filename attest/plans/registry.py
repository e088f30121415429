"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Prelude of the checking SQL: events with their time in microseconds.
EV = "WITH RECURSIVE ev AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS t FROM events)"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with t, their time in whole microseconds, independent of the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", t.alias("t"))


def micro(x):
    """Six decimals by floor, the same in both engines at ties."""
    return F.floor(x * 1e6 + 0.5) / 1e6
