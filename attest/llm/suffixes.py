"""Suffix-array dedup: maximal repeat groups from the common-prefix interval tree of an enhanced suffix array.

Each byte of a string of `window` bytes that also starts anywhere else, in any document, is removed; strings are judged
on the input and matches never cross documents. repeats.py routes contents that may share strings to the same shard.

A shard's pieces are sorted as suffixes by prefix doubling, from packed runs of seven bytes on; the ranks of all rounds
give the common prefix of neighbours in suffix order by descent, without comparing texts. A scan with a stack over these
lengths visits the intervals of the tree from the leaves up. An interval whose occurrences differ in the byte before
them (or stand at a text's beginning) is a maximal repeat; all its occurrences, not only neighbours, are the group. Every
repeated string lies in a maximal repeat with all its own occurrences, so the groups cover exactly what is removed. A
piece that stands for several equal stretches has their number as its weight: alone it is a group of that many.

Defined results: null text is empty and keeps the digest of nothing; texts under `window` bytes stay whole; an empty table
gives an empty result; rows without doc_id stay as they are; equal rows of one doc_id are two starts of their strings
and both lose them; different texts that share a doc_id are told apart by their checksums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import text as T
from .repeats import findings, marked, marks, repeated_spans, with_spans
from .store import Scratch

WINDOW, GRAMS, PACK = 400, (48, 160, 280), 7
#: Bytes of pieces in one shard; a gram with up to repeats.BLOCK distinct contents stays in one.
SHARD_BYTES = 1 << 20


class SuffixArray:
    """Suffixes of many byte strings in order, with common prefixes of neighbours; no suffix leaves its string.

    Prefixes are known up to `depth` bytes, and those under `least` bytes only as such (as 0). About 60 bytes of memory a byte.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int, least: int = 1):
        n = len(data)
        count = len(offsets) - 1
        # values 1 .. 256, and 0 behind each string
        sequence = np.zeros(n + count + PACK, np.uint16)
        self.place = np.arange(n, dtype=np.int32) + np.repeat(np.arange(count, dtype=np.int32), np.diff(offsets))
        sequence[self.place] = data.astype(np.uint16) + np.uint16(1)
        self.ends = (offsets[1:] + np.arange(count)).astype(np.int32)  # place of the 0 behind each string
        size = self.size = n + count
        self.sequence = sequence
        key = np.zeros(size, np.int64)
        for i in range(PACK):
            key <<= 9
            key |= sequence[i : i + size]
        self.ranks: list[tuple[int, np.ndarray]] = []
        # a rank is the first place in order of the suffixes that are equal so far; only those not alone are sorted again
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        rank, at, width = np.zeros(size, np.int32), np.arange(size, dtype=np.int32), PACK
        while True:
            new = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[order[at]] = np.maximum.accumulate(np.where(new, at, 0))
            self.ranks.append((width, rank))
            at = at[~(new & np.append(new[1:], True))]
            if width >= depth or not len(at):
                break
            own = order[at]
            after = own + np.int64(width)
            key = rank[own].astype(np.int64) * (size + 1) + np.where(after < size, rank[np.minimum(after, size - 1)], -1) + 1
            sort = np.argsort(key)
            order[at], key = own[sort], key[sort]
            width *= 2
        self.order = order
        self.common = self._common(depth, least)

    def _common(self, depth: int, least: int) -> np.ndarray:
        """common[i]: shared prefix of suffixes i - 1 and i in order, at most what either has left."""
        a, b = self.order[:-1], self.order[1:]
        # pairs that differ within the widest known width up to `least` are out at once
        small = [r for w, r in self.ranks if w <= least]
        at = np.flatnonzero(small[-1][a] == small[-1][b]) if small else np.arange(len(a))
        a, b = a[at].astype(np.int64), b[at].astype(np.int64)
        left = lambda x: self.ends[np.searchsorted(self.ends, x)] - x
        most = np.minimum(np.minimum(left(a), left(b)), depth)
        keep = most >= least
        at, a, b, most = at[keep], a[keep], b[keep], most[keep]
        out = np.zeros(len(a), np.int64)
        for width, rank in [(w, r) for w, r in reversed(self.ranks) for _ in range(2 if w == self.ranks[-1][0] else 1)]:
            x, y = np.minimum(a + out, self.size - 1), np.minimum(b + out, self.size - 1)
            out += np.where((rank[x] == rank[y]) & (out + width <= most), width, 0)
        for _ in range(PACK):
            x, y = np.minimum(a + out, self.size - 1), np.minimum(b + out, self.size - 1)
            out += (self.sequence[x] == self.sequence[y]) & (out < most)
        common = np.zeros(self.size + 1, np.int32)
        common[at + 1] = np.where(out >= least, out, 0)
        return common

    def maximal_repeats(self, least: int, weights: np.ndarray | None = None):
        """Intervals (first, last, length) of at least `least` bytes in suffix order whose left extensions differ, from the leaves up.

        weights: how many equal strings each string stands for; the beginning of one that stands for several is such a leaf.
        """
        before = np.where(self.order > 0, self.sequence[np.maximum(self.order - 1, 0)], 0)
        change = np.zeros(len(self.order), np.int32)
        change[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)  # a beginning differs from everything, also from another
        change = np.cumsum(change, dtype=np.int32)
        common = self.common
        long = np.flatnonzero(common >= least)
        out: list[tuple[int, int, int]] = []
        if weights is not None:
            begin = np.append(0, self.ends[:-1] + 1)
            leaf = np.flatnonzero((weights > 1) & (self.ends - begin >= least))
            at = np.zeros(len(self.order), np.int32)
            at[self.order] = np.arange(len(self.order), dtype=np.int32)
            out = [(int(i), int(i), int(n)) for i, n in zip(at[begin[leaf]].tolist(), (self.ends - begin)[leaf].tolist(), strict=True)]
        if not len(long):
            return out
        cut = np.flatnonzero(np.diff(long) > 1)
        for a, b in zip(np.append(0, cut + 1).tolist(), np.append(cut, len(long) - 1).tolist(), strict=True):
            lo, hi = int(long[a]), int(long[b])  # suffixes lo - 1 .. hi share at least `least` bytes
            values = common[lo : hi + 1].tolist() + [0]
            stack: list[tuple[int, int]] = []
            for i, v in enumerate(values):
                left = lo + i - 1
                while stack and stack[-1][1] > v:
                    left, length = stack.pop()
                    right = lo + i - 1
                    if change[right] > change[left]:
                        out.append((left, right, length))
                if v and (not stack or stack[-1][1] < v):
                    stack.append((left, v))
        return out


def index_shard(window: int):
    """The index of repeats.repeated_spans: all bytes under maximal repeats of the shard."""

    def of(shard: pa.Table) -> pa.Table:
        data, offsets = T.flat(shard.column("piece").combine_chunks())
        weights = shard.column("weight").to_numpy()
        array = SuffixArray(data, offsets, int(np.diff(offsets).max(initial=0)), window)
        edge = np.zeros(array.size + 1, np.int32)
        groups = np.array(array.maximal_repeats(window, weights), np.int64).reshape(-1, 3)
        many = groups[:, 1] - groups[:, 0] + 1
        at = array.order[np.repeat(groups[:, 0] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + np.repeat(groups[:, 2], many), -1)
        covered = (np.cumsum(edge[:-1]) > 0)[array.place]
        a, b, piece = T.join_spans(covered, offsets)
        shift = shard.column("first").to_numpy().astype(np.int64)[piece] - offsets[piece]
        full = np.zeros(len(weights), bool)
        full[piece[b - a == np.diff(offsets)[piece]]] = True
        return findings(shard, piece, a + shift, b + shift, np.flatnonzero(full & (weights > 1)))

    return of


def repeat_groups(texts: pa.Array, least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of a bounded set of texts: (length, all occurrences as (text, first byte))."""
    data, offsets = T.flat(texts)
    array = SuffixArray(data, offsets, int(np.diff(offsets).max(initial=0)), least)
    begins = offsets[:-1] + np.arange(len(offsets) - 1)
    out = []
    for first, last, length in array.maximal_repeats(least):
        at = np.sort(array.order[first : last + 1])
        text = np.searchsorted(begins, at, side="right") - 1
        out.append((length, list(zip(text.tolist(), (at - begins[text]).tolist(), strict=True))))
    return out


def _cut(names: list[str], digest: bool):
    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                data, offsets = T.flat(run.column("text"))
                n = len(offsets) - 1
                gone = marks(run, offsets)
                lost = np.bincount(T.owner(offsets)[gone], minlength=n) if gone.any() else np.zeros(n, np.int64)
                _, _, of_span = T.join_spans(gone, offsets)
                out: list = []
                for i in range(n):
                    if not digest and not lost[i]:
                        out.append(None)
                        continue
                    own = data[offsets[i] : offsets[i + 1]]
                    kept = own[~gone[offsets[i] : offsets[i + 1]]].tobytes()
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode(errors="ignore"))
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in names), pa.array(np.diff(offsets), pa.int64()), pa.array(lost.astype(np.int64)), pa.array(np.bincount(of_span, minlength=n).astype(np.int64)), pa.array(out, pa.string())], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return of


def suffix_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, **bounds) -> DataFrame:
    """Of docs with _mark (repeats.marked)."""
    return repeated_spans(docs, "bytes", window, grams, False, index_shard(window), scratch, **{"shard_bytes": SHARD_BYTES, **bounds})


def remove(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """docs with every repeated string cut from their texts; characters that a cut leaves incomplete go too, n_chars follows."""
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    inner = marked(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), "doc_id", "text"))
    rows = with_spans(inner, suffix_spans(inner, scratch, window, grams), scratch)
    kinds = StructType([inner.schema["own"], StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", StringType())])
    text = F.coalesce("kept", F.col("own").getField("text"))
    cut = rows.mapInArrow(_cut(["own"], False), kinds)
    return cut.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col("own").getField(c)).alias(c) for c in names])


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scratch = Scratch(spark)
    rows = with_spans(docs, suffix_spans(docs, scratch), scratch)
    return rows.mapInArrow(_cut(["doc_id"], True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string").withColumnRenamed("kept", "kept_sha256")
