"""Constraint solving over drivers, per row in Arrow batches: damped Gauss-Newton with halving, ranks by singular values.

A mechanism is one small problem; many of them (seeds, samples, charts) are rows and are solved in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vec import configuration_distance

ITERATIONS, HALVINGS, STEP, TOLERANCE = 80, 16, 1e-6, 1e-10


def jacobian(residual: Callable[[np.ndarray], np.ndarray], x: np.ndarray, step: float = STEP) -> np.ndarray:
    """Central differences."""
    eye = np.eye(len(x)) * step
    return np.stack([(residual(x + e) - residual(x - e)) / (2 * step) for e in eye], 1) if len(x) else np.zeros((len(residual(x)), 0))


def solve(residual: Callable[[np.ndarray], np.ndarray], start: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Point inside the limits, its residual norm and the iterations taken."""
    x = np.clip(start, lower, upper)
    r = residual(x)
    best = float(np.linalg.norm(r))
    for k in range(ITERATIONS):
        if best <= TOLERANCE:
            return x, best, k
        j = jacobian(residual, x)
        damp = 1e-9 * max(1.0, float((j * j).sum()))
        d = np.linalg.solve(j.T @ j + damp * np.eye(len(x)), -j.T @ r)
        for h in range(HALVINGS):
            y = np.clip(x + d * 0.5**h, lower, upper)
            s = residual(y)
            if float(np.linalg.norm(s)) < best:
                x, r, best = y, s, float(np.linalg.norm(s))
                break
        else:
            return x, best, k + 1
    return x, best, ITERATIONS


def rank(j: np.ndarray, threshold: float = 1e-8) -> tuple[int, float]:
    """Numerical rank, and condition (infinite below full rank)."""
    s = np.linalg.svd(j, compute_uv=False) if j.size else np.zeros(0)
    if not len(s) or s[0] <= 0:
        return 0, float("inf")
    k = int((s > threshold * s[0]).sum())
    return k, float(s[0] / s[-1]) if k == len(s) else float("inf")


def solve_rows(seeds: DataFrame, key: str, residual: Callable[[np.ndarray, dict], np.ndarray], lower: list[float], upper: list[float], parameters: tuple[str, ...] = ()) -> DataFrame:
    """seeds (key, start ARRAY<DOUBLE>, parameters...) to key, solution, residual, iterations, solved, rank and condition."""
    lo, hi = np.array(lower, float), np.array(upper, float)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                f = lambda x, p=r: np.asarray(residual(x, p), float)
                x, norm, n = solve(f, np.asarray(r["start"], float), lo, hi)
                k, condition = rank(jacobian(f, x))
                rows.append((r[key], x.tolist(), norm, n, norm <= 1e-8, k, condition))
            yield pd.DataFrame(rows, columns=[key, "solution", "residual", "iterations", "solved", "rank", "condition"])

    return seeds.select(key, "start", *parameters).mapInPandas(of, f"{key} {seeds.schema[key].dataType.simpleString()}, solution array<double>, residual double, iterations int, solved boolean, rank int, condition double")


def greedy_clusters(points: DataFrame, groups: list[str], order: str, position: str, tolerance: float) -> DataFrame:
    """Per group, in `order`, each point joins the first cluster whose first point is within tolerance, or starts one."""
    kinds = ", ".join([*[f"{g} {points.schema[g].dataType.simpleString()}" for g in groups], f"{order} {points.schema[order].dataType.simpleString()}", "cluster int"])

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        heads: list[np.ndarray] = []
        out = []
        for p in pdf[position]:
            p = np.asarray(p, float)
            k = next((i for i, h in enumerate(heads) if np.linalg.norm(h - p) <= tolerance), len(heads))
            if k == len(heads):
                heads.append(p)
            out.append(k)
        return pdf[[*groups, order]].assign(cluster=np.array(out, np.int32))

    return points.select(*groups, order, position).groupBy(*groups).applyInPandas(of, kinds)


def convex_hull(points: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Corners of each group's hull in the plane, counter-clockwise from the least point (monotone chain)."""
    kinds = ", ".join([*[f"{g} {points.schema[g].dataType.simpleString()}" for g in groups], "corner int", "x double", "y double"])

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(pdf[x].astype(float), pdf[y].astype(float), strict=True)))

        def half(seq):
            out: list = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        hull = pts if len(pts) < 3 else half(pts)[:-1] + half(reversed(pts))[:-1]
        return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in groups}, "corner": i, "x": p[0], "y": p[1]} for i, p in enumerate(hull)])

    return points.select(*groups, x, y).groupBy(*groups).applyInPandas(of, kinds)


def configuration_atlas(charts: DataFrame, residual: Callable[[np.ndarray, dict], np.ndarray], lower: list[float], upper: list[float], parameter: int, scales: list[float], merge: float, parameters: tuple[str, ...] = ()) -> DataFrame:
    """Solutions along each chart: chart, sample, node, parameter, position, residual, rank, passive_rank, sources.

    charts: chart, samples (values of the coordinate `parameter`), seeds (start points), parameters. Samples go in order: each
    starts from the seeds and from the solutions of the sample before, at its own value, with that coordinate held. Solutions
    no further apart than `merge` (scaled) are one node. A chart is one task; charts are solved in parallel.
    """
    lo, hi, weight = np.array(lower, float), np.array(upper, float), np.array(scales, float)
    free = np.arange(len(lo)) != parameter
    kind = charts.schema["chart"].dataType.simpleString()

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in pdf.to_dict("records"):
            before: list[np.ndarray] = []
            for k, value in enumerate(r["samples"]):
                nodes: list = []
                for source, start in [*((f"seed/{i}", np.asarray(s, float)) for i, s in enumerate(r["seeds"])), *((f"node/{i}", s) for i, s in enumerate(before))]:
                    whole = start.copy()
                    whole[parameter] = value

                    def inner(y, whole=whole):
                        x = whole.copy()
                        x[free] = y
                        return np.asarray(residual(x, r), float)

                    y, norm, _ = solve(inner, whole[free], lo[free], hi[free])
                    if norm > 1e-8:
                        continue
                    x = whole.copy()
                    x[free] = y
                    same = next((n for n in nodes if np.linalg.norm((n[0] - x) / weight) <= merge), None)
                    if same is not None:
                        same[2].append(source)
                    else:
                        nodes.append((x, norm, [source], rank(jacobian(lambda z: np.asarray(residual(z, r), float), x), 1e-6)[0], rank(jacobian(inner, y), 1e-6)[0]))
                nodes.sort(key=lambda n: n[0].tolist())
                rows += [(r["chart"], k, i, float(value), n[0].tolist(), n[1], n[3], n[4], n[2]) for i, n in enumerate(nodes)]
                before = [n[0] for n in nodes]
        return pd.DataFrame(rows, columns=["chart", "sample", "node", "parameter", "position", "residual", "rank", "passive_rank", "sources"])

    own = charts.select("chart", "samples", "seeds", *parameters)
    return own.groupBy("chart").applyInPandas(of, f"chart {kind}, sample int, node int, parameter double, position array<double>, residual double, rank int, passive_rank int, sources array<string>")


def rank_drops(nodes: DataFrame) -> DataFrame:
    """nodes with the greatest ranks of their chart and whether a node's are below them."""
    w = W.partitionBy("chart")
    top = nodes.withColumn("top_rank", F.max("rank").over(w)).withColumn("top_passive", F.max("passive_rank").over(w))
    return top.withColumn("mechanism_drop", F.col("rank") < F.col("top_rank")).withColumn("chart_drop", F.col("passive_rank") < F.col("top_passive"))


def atlas_edges(nodes: DataFrame, scales: list[float], periodic: list[bool], reach: float) -> DataFrame:
    """chart, sample, a, b, distance: nodes of neighbouring samples of a chart that are near."""
    a = nodes.select("chart", "sample", F.col("node").alias("a"), F.col("position").alias("_p"))
    b = nodes.select("chart", (F.col("sample") - 1).alias("sample"), F.col("node").alias("b"), F.col("position").alias("_q"))
    out = a.join(b, ["chart", "sample"]).withColumn("distance", configuration_distance(F.col("_p"), F.col("_q"), scales, periodic))
    return out.where(F.col("distance") <= reach).select("chart", "sample", "a", "b", "distance")
