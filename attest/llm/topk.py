"""Exact top-k by inner product: ball-tree branch and bound per shard, with the kth score shared from shard to shard.

Vectors are taken as integers, floor(1024 * component). Queries come in blocks of at most BLOCK vectors and about
BLOCK_VALUES components (the bound of each broadcast); for each block the vectors are read once, in place and without a shuffle. Each task cuts its rows into
shards of SHARD vectors, builds a ball tree of each (median split along the widest axis) and searches it for the whole
block at once: nodes are taken in order of their largest upper bound, q.c + |q| r, and a query leaves a node when its
bound is under the query's current kth score. That score starts from a bounded sample of SEEDS vectors, the same for
all tasks, and is carried on through all shards of a task. A task sends on only what can still be in the result.

Scores are exact: sums below 2**53 in doubles, larger ones in Python integers (kept within a long at the end). Ties go to
the smaller vec_id. Defined results: vectors that are null or hold null or non-finite components, and rows without id,
take no part; only vectors of equal length are compared; rows that share a vec_id count as one query (its least vector)
and are no candidates of it, but each is a candidate of others; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import Scratch

SCALE, SHARD, LEAF, BLOCK, SEEDS = 1024, 8192, 96, 32_768, 2048
#: Components of a block's queries: 32 MB of numbers, whatever their length.
BLOCK_VALUES = 1 << 22
_NONE = np.int64(-(2**63))
_LONG = 2**63 - 1


def _vectors(ids: pa.Array, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids and integer vectors (as doubles) of the rows that take part."""
    lists = lists.cast(pa.list_(pa.float64()))
    ok = pc.and_(pc.is_valid(ids), pc.is_valid(lists))
    ids, lists = ids.filter(ok), lists.filter(ok)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if not len(ids):
        return out
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components are NaN
    firsts = np.concatenate([[0], np.cumsum(lengths)])
    names = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        x = values[firsts[rows][:, None] + np.arange(n)[None, :]]
        good = np.isfinite(x).all(1)
        with np.errstate(over="ignore"):
            x = np.floor(x[good] * SCALE)
        fits = np.isfinite(x).all(1)  # 1024 x itself may leave the doubles
        out[n] = (names[rows][good][fits], x[fits])
    return out


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, all rows of q with all of v, as longs."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q @ v.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], dtype=object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v], dtype=object).reshape(v.shape).T
    return np.array([[max(-_LONG, min(_LONG, int(x))) for x in r] for r in big], np.int64).reshape(len(q), len(v))


class Tree:
    """Nodes as (centre, radius, rows or None, left, right), the root last."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.nodes: list[tuple] = []
        self.x = x
        self._build(np.arange(len(x)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        part = self.x[rows]
        centre = part.mean(0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(1).max()))
        axis = int(np.argmax(part.max(0) - part.min(0))) if part.shape[1] else 0
        if len(rows) <= leaf or not radius:  # equal vectors stay together, in parts
            self.nodes.append((centre, radius, rows, -1, -1))
            return len(self.nodes) - 1
        order = np.argsort(part[:, axis], kind="stable")
        half = len(rows) // 2
        left, right = self._build(rows[order[:half]], leaf), self._build(rows[order[half:]], leaf)
        self.nodes.append((centre, radius, None, left, right))
        return len(self.nodes) - 1


class Search:
    """A block of queries with their best so far: scores, ids and the kth score to beat (or equal)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.x, self.k, self.floor = ids, x, k, floor
        self.norm = np.sqrt((x**2).sum(1))
        self.scores = np.full((len(ids), k), _NONE)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def least(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[at], self.scores[at, -1])

    def bound(self, at: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        reach = self.norm[at] * (radius + float(np.sqrt((centre**2).sum())))
        return self.x[at] @ centre + self.norm[at] * radius + 1e-12 * reach + 1

    def shard(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not len(self.ids):
            return
        tree = Tree(x)
        every = np.arange(len(self.ids))
        centre, radius, *_ = tree.nodes[-1]
        up = self.bound(every, centre, radius)
        queue = [(-float(up.max()), len(tree.nodes) - 1, every, up)]
        while queue:
            _, node, at, up = heapq.heappop(queue)
            keep = up >= self.least(at)
            at = at[keep]
            if not len(at):
                continue
            _, _, rows, left, right = tree.nodes[node]
            if rows is not None:
                for s in range(0, len(rows), 4 * LEAF):
                    self._merge(at, ids[rows[s : s + 4 * LEAF]], x[rows[s : s + 4 * LEAF]])
                continue
            for child in (left, right):
                up = self.bound(at, *tree.nodes[child][:2])
                heapq.heappush(queue, (-float(up.max()), child, at, up))

    def _merge(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        score = _products(self.x[at], x)
        score[ids[None, :] == self.ids[at][:, None]] = _NONE
        better = score.max(1) >= self.least(at)
        at, score = at[better], score[better]
        if not len(at):
            return
        s = np.concatenate([self.scores[at], score], 1)
        i = np.concatenate([self.found[at], np.broadcast_to(ids, score.shape)], 1)
        order = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, without overflow
        self.scores[at], self.found[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero((self.scores > _NONE) & (self.scores >= self.floor[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, r]), pa.array(self.scores[q, r])], names=["query_id", "vec_id", "score"])


_FOUND = "query_id long, vec_id long, score long"


def _floors(seeds: bytes, k: int):
    """Queries with a score that k candidates of the sample reach (the least long where it has fewer)."""

    def of(batches):
        sample = pickle.loads(seeds)
        for batch in batches:
            for n, (ids, x) in _vectors(batch.column("vec_id"), batch.column("embedding")).items():
                names, v = sample.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
                floor = np.full(len(ids), _NONE)
                if len(names) > k:
                    for s in range(0, len(ids), 1024):
                        score = _products(x[s : s + 1024], v)
                        score[names[None, :] == ids[s : s + 1024, None]] = _NONE
                        floor[s : s + 1024] = np.partition(score, -k, axis=1)[:, -k]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(x), pa.list_(pa.float64())), pa.array(floor)], names=["vec_id", "vector", "floor"])

    return of


def _scan(frozen, k: int):
    def of(batches):
        blocks = {n: Search(*part, k) for n, part in pickle.loads(frozen.value).items()}
        held: dict[int, list] = {}
        for batch in batches:
            for n, (ids, x) in _vectors(batch.column("vec_id"), batch.column("embedding")).items():
                if n not in blocks:
                    continue
                held.setdefault(n, []).append((ids, x))
                if sum(len(i) for i, _ in held[n]) >= SHARD:
                    _flush(blocks[n], held.pop(n))
        for n, parts in held.items():
            _flush(blocks[n], parts)
        for search in blocks.values():
            yield search.rows()

    return of


def _flush(search: Search, parts: list) -> None:
    ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    for s in range(0, len(ids), SHARD):
        search.shard(ids[s : s + SHARD], x[s : s + SHARD])


def top_k(vectors: DataFrame, queries: Column, k: int = 10, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score for the rows of vectors (vec_id, embedding) where `queries` holds."""
    spark = vectors.sparkSession
    vectors = vectors.select("vec_id", "embedding")
    # a bounded sample: the rows with the least hashes
    picked = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).toArrow().combine_chunks()
    seeds = pickle.dumps(_vectors(picked.column("vec_id").combine_chunks(), picked.column("embedding").combine_chunks()))
    asked = vectors.where(queries & F.col("embedding").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = asked.mapInArrow(_floors(seeds, k), "vec_id long, vector array<double>, floor long").toLocalIterator()
    scratch, parts = Scratch(spark), []

    def run(held: list) -> None:
        by: dict[int, list] = {}
        for r in held:
            by.setdefault(len(r[1]), []).append(r)
        packed = {n: (np.array([r[0] for r in rs], np.int64), np.stack([r[1] for r in rs]).reshape(len(rs), n), np.array([r[2] for r in rs], np.int64)) for n, rs in by.items()}
        frozen = spark.sparkContext.broadcast(pickle.dumps(packed))
        best = vectors.mapInArrow(_scan(frozen, k), _FOUND)
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(scratch.put(ranked, "block"))
        frozen.destroy()

    held: list = []
    size = 0
    for r in rows:
        held.append((r["vec_id"], np.array(r["vector"], np.float64), r["floor"]))
        size += len(r["vector"])
        if len(held) == block or size >= BLOCK_VALUES:
            run(held)
            held, size = [], 0
    if held or not parts:
        run(held)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
