"""Summaries of point sets and loads: boxes, centroids, landmarks, principal axes, shape classes, gravity, reach."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import vec as V
from .walks import each, order, totals


def summary(points: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Per key: number of points, box, centre of the box, extents and centroid."""
    x = F.col(p)
    out = points.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), *[f(x[i]).alias(f"{a}_{'xyz'[i]}") for a, f in (("min", F.min), ("max", F.max), ("centroid", F.avg)) for i in range(3)])
    for c in "xyz":
        out = out.withColumn(f"centre_{c}", (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2).withColumn(f"extent_{c}", F.col(f"max_{c}") - F.col(f"min_{c}"))
    return out


def landmarks(points: DataFrame, keys: Sequence[str], p: str, index: str) -> DataFrame:
    """Per key the index of the least and greatest point along each axis; of equal ones the first."""
    x = F.col(p)
    parts = []
    for i, c in enumerate("xyz"):
        parts += [F.min_by(index, F.struct(x[i], F.col(index))).alias(f"least_{c}"), F.min_by(index, F.struct(-x[i], F.col(index))).alias(f"greatest_{c}")]
    return points.groupBy(*keys).agg(*parts)


def principal_axes(points: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Per key the variances along the principal axes, greatest first, and the first axis with its largest part positive.

    Covariances are aggregates; only a 3 x 3 matrix per key goes to Python.
    """
    x = F.col(p)
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cov = points.groupBy(*keys).agg(F.array(*[F.covar_pop(x[i], x[j]) for i, j in pairs]).alias("_c"))

    @F.pandas_udf("struct<variances: array<double>, axis: array<double>>")
    def eigen(c: pd.Series) -> pd.DataFrame:
        m = np.zeros((len(c), 3, 3))
        for k, (i, j) in enumerate(pairs):
            m[:, i, j] = m[:, j, i] = [v[k] for v in c]
        w, v = np.linalg.eigh(m)
        axis = v[:, :, 2]
        sign = np.sign(np.take_along_axis(axis, np.abs(axis).argmax(1)[:, None], 1))
        return pd.DataFrame({"variances": list(np.maximum(w[:, ::-1], 0)), "axis": list(axis * np.where(sign == 0, 1, sign))})

    return cov.select(*keys, eigen("_c").alias("e")).select(*keys, "e.variances", "e.axis")


def shape_class(extents: Column, flat: float = 0.2, near: float = 0.8) -> Column:
    """By sorted extents a <= b <= c: compact (a/c >= near), rod (b/c < flat), plate (a/b < flat), else block; point without extent."""
    e = F.array_sort(extents)
    a, b, c = e[0], e[1], e[2]
    return F.when(c <= 0, "point").when(a / c >= near, "compact").when(b / c < flat, "rod").when(a / b < flat, "plate").otherwise("block")


def gravity_loads(inertials: DataFrame, frames: DataFrame, joints: DataFrame, paths: DataFrame, gravity: Sequence[float]) -> DataFrame:
    """Generalised force that holds each driver against gravity (a vector in the root): of each joint, the masses at and below its link.

    A driver with no mass there has no row.

    joints: robot, child, type, axis, driver, multiplier; frames: robot, link, world; paths: robot, link, path from the root,
    of which only the last two links are read.
    """
    values = ["n", "m", "s0", "s1", "s2"]
    m = inertials.join(frames, ["robot", "link"])
    t = V.matmul4(F.col("world"), V.rpy_matrix(F.col("xyz"), F.col("rpy")))
    masses = m.select("robot", "link", "mass", t.alias("_t")).groupBy("robot", "link").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(n) for n, c in (("m", F.col("mass")), *((f"s{k}", F.col("mass") * F.col("_t")[4 * k + 3]) for k in range(3)))])
    tree = paths.select("robot", "link", F.when(F.size("path") > 1, F.element_at("path", -2)).alias("prefix")).join(masses, ["robot", "link"], "left").fillna(0.0, values)

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        links = t["link"].to_pylist()
        rows, above = order(links, t["prefix"].to_pylist())
        own = np.stack([t[c].to_numpy() for c in values], 1)[rows]
        sums = totals(own, above)
        yield pa.record_batch([pa.array([t["robot"][0].as_py()] * len(rows), pa.string()), pa.array([links[r] for r in rows], pa.string()), *map(pa.array, sums.T.copy())], names=["robot", "child", *values])

    below = each(tree, ["robot"], of, "robot string, child string, " + ", ".join(f"{v} double" for v in values))
    rows = joints.join(below.where("n > 0"), ["robot", "child"]).join(frames.select("robot", F.col("link").alias("child"), "world"), ["robot", "child"])
    w, a = F.col("world"), F.col("axis")
    axis = F.array(*[w[4 * i] * a[0] + w[4 * i + 1] * a[1] + w[4 * i + 2] * a[2] for i in range(3)])
    turn = F.col("type").isin("revolute", "continuous")
    arm = F.array(*[F.col(f"s{k}") - F.col("m") * w[4 * k + 3] for k in range(3)])
    motion = F.when(turn, V.cross(axis, arm)).otherwise(V.scaled(axis, F.col("m")))
    force = -V.dot(V.vec(*gravity), motion) * F.col("multiplier")
    return rows.where(turn | (F.col("type") == "prismatic")).groupBy("robot", "driver").agg(F.sum(force).alias("load"))


def halton_poses(drivers: DataFrame, n: int, bases: Sequence[int] = (2, 3, 5, 7, 11, 13, 17)) -> DataFrame:
    """drivers (robot, driver, number, lower, upper) to (robot, sample, driver, value): low-discrepancy poses within the limits."""
    spark = drivers.sparkSession
    samples = spark.range(1, n + 1).withColumnRenamed("id", "sample")
    digit = F.coalesce(*[F.when(F.col("number") % len(bases) == i, N.radical_inverse(F.col("sample"), b)) for i, b in enumerate(bases)])
    return samples.crossJoin(drivers).select("robot", "sample", "driver", (F.col("lower") + digit * (F.col("upper") - F.col("lower"))).alias("value"))  # n poses of each driver


def envelope(places: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Box and greatest distance from the origin of sampled places."""
    return summary(places, keys, p).join(places.groupBy(*keys).agg(F.max(V.norm(F.col(p))).alias("radius")), list(keys))
