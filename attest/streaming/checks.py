"""Order checks, carried-forward state and sessions over unbounded streams, with the same results as their batch forms.

State is one small record per key, and is given up `keep_ms` after a key's last row where that is set: for streams that run
on, as a run that only drains what is there would wait for the last timeout. The order check
takes a key's rows in order of arrival (an increasing number that the source gives), so that a late row is reported, never
repaired, and the result does not depend on how rows are cut into batches as long as these keep that order. Snapshots put
the rows of a batch in (time, id) order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_folder


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and gives its output as a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/attest-stream-{uuid.uuid4().hex}"
    schema = stream.schema
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def _timeout(keep_ms: int | None) -> GroupStateTimeout:
    return GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def order_issues(stream: DataFrame, key: str, arrival: str, time: str, max_gap: int, keep_ms: int | None = None) -> DataFrame:
    """Rows older than the one before them, or after a gap: key, arrival, issue, gap (time since the row before)."""

    def of(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame([], columns=[key, arrival, "issue", "gap"])
        if state.hasTimedOut:
            state.remove()
            yield none
            return
        rows = pd.concat(list(frames)).sort_values(arrival, kind="stable")
        at, t = rows[arrival].to_numpy(), rows[time].to_numpy()
        step = t - np.append(state.get[0] if state.exists else t[0], t[:-1])
        found = np.flatnonzero((step < 0) | (step > max_gap))
        state.update((int(t[-1]),))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({key: k[0], arrival: at[found], "issue": np.where(step[found] < 0, "out_of_order", "gap"), "gap": step[found]}) if len(found) else none

    return stream.select(key, arrival, time).groupBy(key).applyInPandasWithState(of, f"{key} long, {arrival} long, issue string, gap long", "last long", "append", _timeout(keep_ms))


def snapshots(stream: DataFrame, key: str, tie: str, time: str, channel: str, value: str, channels: Sequence[str], max_age: int, keep_ms: int | None = None) -> DataFrame:
    """Each row with the latest value of every channel so far, its age and the snapshot's status."""
    names = [c for ch in channels for c in (f"{ch}_value", f"{ch}_age")]

    def of(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values([time, tie])
        held = list(state.get) if state.exists else [None] * (2 * len(channels))
        out = []
        for t, i, c, v in zip(*(rows[x].tolist() for x in (time, tie, channel, value)), strict=True):
            if c in channels:
                at = 2 * list(channels).index(c)
                held[at : at + 2] = [float(v), int(t)]
            ages = [None if held[2 * n + 1] is None else t - held[2 * n + 1] for n in range(len(channels))]
            status = "incomplete" if None in ages else "stale" if max(ages) > max_age else "current"
            out.append((k[0], i, *[x for n in range(len(channels)) for x in (held[2 * n], ages[n])], status))
        state.update(tuple(held))
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        done = pd.DataFrame(out, columns=[key, tie, *names, "snapshot_status"])
        for n in names:
            done[n] = done[n].astype("Int64" if n.endswith("_age") else "Float64")
        yield done

    kinds = ", ".join(f"{n} {'long' if n.endswith('_age') else 'double'}" for n in names)
    held = ", ".join(f"v{n} double, t{n} long" for n in range(len(channels)))
    return stream.select(key, tie, time, channel, value).groupBy(key).applyInPandasWithState(of, f"{key} long, {tie} long, {kinds}, snapshot_status string", held, "append", _timeout(keep_ms))


def sessions(stream: DataFrame, key: str, time: str, gap: str, delay: str) -> DataFrame:
    """Closed sessions: key, start, end, n. A session is out once the watermark has passed its end."""
    return stream.withWatermark(time, delay).groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
