"""Trees walked whole: what a robot's links get from the links above or below them, one robot a task.

A robot is one object, as a mesh is: its rows go to one task, which holds one value for each link (a matrix, a set of
drivers in bits, a sum) and gives its rows in parts. Nothing is written between levels, and no path is written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Values of lists, or rows, in one part of the output.
PART = 1 << 18


def each(rows: DataFrame, keys: list[str], of: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """All rows of a key to one call of `of`."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from of(pa.Table.from_batches(list(batches)))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).groupBy(*keys).applyInArrow(whole, schema)


def order(nodes: list, ups: list) -> tuple[list[int], list[int]]:
    """(row, place of the row above or -1) of all rows that a root (a row whose up is null) reaches, parents first.

    A node with several rows comes once for each path; a path ends where it would meet a node again.
    """
    below: dict = {}
    for row, up in enumerate(ups):
        below.setdefault(up, []).append(row)
    several = len(set(nodes)) < len(nodes)
    rows, above = [], []
    waiting = [(row, -1) for row in reversed(below.get(None, []))]
    while waiting:
        row, at = waiting.pop()
        if several:
            back = at
            while back >= 0 and nodes[rows[back]] != nodes[row]:
                back = above[back]
            if back >= 0:
                continue
        rows.append(row)
        above.append(at)
        if nodes[row] is not None:
            waiting += [(kid, len(rows) - 1) for kid in reversed(below.get(nodes[row], []))]
    return rows, above


def matrices(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of 16 numbers to n x 4 x 4; a null list is all NaN."""
    lists = column.combine_chunks()
    out = np.full((len(lists), 16), np.nan)
    there = np.asarray(lists.is_valid())
    out[there] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, 16)
    return out.reshape(-1, 4, 4)


def matrix_lists(m: np.ndarray) -> pa.Array:
    """n x 4 x 4 to lists of 16 numbers; a matrix with a NaN is null."""
    flat = np.ascontiguousarray(m).reshape(-1, 16)
    lost = np.isnan(flat).any(1)
    if not lost.any():
        return pa.ListArray.from_arrays(np.arange(0, 16 * len(flat) + 1, 16, dtype=np.int32), flat.ravel())
    return pa.array([None if x else v for x, v in zip(lost, flat.tolist(), strict=True)], pa.list_(pa.float64()))


def products(local: np.ndarray, above: list[int]) -> np.ndarray:
    """Each place's product of the local matrices from its root down."""
    out = local.copy()
    for i, up in enumerate(above):
        if up >= 0:
            np.matmul(out[up], local[i], out=out[i])
    return out


def motions(axis: np.ndarray, at: np.ndarray, turns: bool) -> np.ndarray:
    """Matrices of a turn about an axis, or of a slide along it, at positions."""
    out = np.repeat(np.eye(4)[None], len(at), 0)
    if not turns:
        out[:, :3, 3] = at[:, None] * axis
        return out
    x, y, z = axis
    c, s = np.cos(at), np.sin(at)
    k = 1 - c
    for i, row in enumerate(((c + x * x * k, x * y * k - z * s, x * z * k + y * s), (y * x * k + z * s, c + y * y * k, y * z * k - x * s), (z * x * k - y * s, z * y * k + x * s, c + z * z * k))):
        for j, v in enumerate(row):
            out[:, i, j] = v
    return out


def numbered(names: list) -> tuple[pa.Array, list[int]]:
    """The names there are, sorted, and each entry's number among them (-1 for null)."""
    known = sorted({n for n in names if n is not None})
    number = {n: i for i, n in enumerate(known)}
    return pa.array(known, pa.string()), [number.get(n, -1) for n in names]


def unions(numbers: list[int], above: list[int]) -> list[int]:
    """Each place's set of numbers from its root down, as bits."""
    out: list[int] = []
    for x, up in zip(numbers, above, strict=True):
        out.append((out[up] if up >= 0 else 0) | (1 << x if x >= 0 else 0))
    return out


def members(bits: int) -> np.ndarray:
    """The numbers in a set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little"))


def set_parts(bits: Iterator[int]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Sets in parts of some PART members: which of them, offsets, and members one after the other."""
    start, n, part = 0, 0, []
    for at, b in enumerate(bits):
        part.append(members(b))
        n += len(part[-1]) + 1
        if n >= PART:
            yield slice(start, at + 1), np.cumsum([0, *map(len, part)], dtype=np.int32), np.concatenate(part)
            start, n, part = at + 1, 0, []
    if part:
        yield slice(start, start + len(part)), np.cumsum([0, *map(len, part)], dtype=np.int32), np.concatenate(part)


def totals(own: np.ndarray, above: list[int]) -> np.ndarray:
    """Each place's sum of the rows of own at and below it."""
    out = own.copy()
    for i in range(len(above) - 1, -1, -1):
        if above[i] >= 0:
            out[above[i]] += out[i]
    return out
