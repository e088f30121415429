"""Whole Arrow text columns as flat numpy bytes: words, hashes and windows without a Python object per word.

Every helper works on runs of rows of a few MB, so memory is bounded by the longest single text, not by the batch.
A null text counts as an empty one. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership of the 256 byte values in the given closed ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words between ASCII white space, and of letters, digits and everything beyond ASCII.
NON_SPACE = ~table((0x20, 0x20), (0x09, 0x0D))
ALNUM = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(batch: pa.RecordBatch, column: str = "text", most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` bytes of text each; a longer text is a run of its own.

    After the last run Arrow's pool gives back what it holds free: a worker that waits for its next task keeps little.
    """
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


def blocks(column: pa.Array, most: int = 1 << 17) -> Iterator[pa.Array]:
    """A column in runs of rows with at most `most` bytes of text each: for samples on the driver."""
    for run in runs(pa.RecordBatch.from_arrays([column], names=["text"]), "text", most):
        yield run.column("text")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the n + 1 offsets of the texts in them."""
    column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes within each text, and the n + 1 offsets of texts' words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) <= n:
        size = max(n + 1, 1 << 16)
        base = int(_MULT)
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value times power; with span_hash they give the hash of any span in constant time."""
    up, _ = _powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal spans have equal hashes wherever they stand."""
    _, down = _powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix(_BYTE[data]), starts, ends)


def window_hashes(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (index into hashes) and hash of every window of n values inside one text."""
    starts = window_starts(offsets, n)
    return starts, span_hash(prefix(hashes), starts, starts + n)


def window_starts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Indexes at which a window of n values lies inside one text."""
    total = int(offsets[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.ones(total, bool)
    for back in range(1, n):  # the last n - 1 places of a text start no window
        at = offsets[1:] - back
        ok[at[at >= offsets[:-1]]] = False
    return np.flatnonzero(ok)


def owner(offsets: np.ndarray) -> np.ndarray:
    """For each value, the text it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def join_spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs of mask within each text, and the text of each run."""
    starts, ends, at = words(mask.view(np.uint8), offsets, table((1, 1)))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(at))


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where any span covers the place."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0
