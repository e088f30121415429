"""Substring removal by FM-index: backward search over a wavelet matrix gives each window's occurrences in its shard.

A window of `window` words is removed where its word sequence also starts earlier, at a lesser doc_id or earlier in the
same document; each of its words goes. Windows are judged on the input.

repeats.py routes contents that may share windows to the same shard. A shard is indexed as one sequence of words: words
that occur once in it cannot be part of a repeat and are one symbol that no pattern may hold. Its suffixes are sorted by
their first 2**k >= window words (doubling), the Burrows-Wheeler transform goes into a wavelet matrix of packed bits with
block counts (about 1.5 bits per word and level), and every window is streamed through it from its last word to its
first. A window whose interval shrinks to its own occurrence is dropped; the others have a matching statistic of at least
`window`, and those with a lesser occurrence in their interval are reported as spans. A piece that stands for several
equal stretches counts as so many occurrences; if its gram has no other content, it is searched for as one pattern.

Defined results: null text has no words; shorter texts than a window stay whole; an empty table gives an empty result;
equal rows of one doc_id are one document; rows without doc_id stay as they are; different texts that share a doc_id are
told apart, and ordered, by their checksums.
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

WINDOW, GRAMS = 20, (6, 11, 16)


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, from the highest, packed bits with the ones before each block of 64."""

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        for d in range(self.depth - 1, -1, -1):
            bits = (symbols >> d) & 1
            padded = np.zeros((self.size // 64 + 1) * 64, np.uint8)
            padded[: self.size] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            zeros = self.size - int(before[-1])
            self.levels.append((words, before, zeros))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

        # where each symbol's places begin in the last level
        self.starts = self._down(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & mask)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Places i of the sequence carried down to the last level on the way of each symbol."""
        for d, (words, before, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = self._ones(words, before, i)
            i = np.where((symbol >> d) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol stands before places lo and hi."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        start = self.starts[symbol]
        return both[: len(lo)] - start, both[len(lo) :] - start


class FMIndex:
    """Of a sequence of small non-negative integers, with suffixes told apart by their first `depth` symbols at least."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        rank, width = sequence.astype(np.int64), 1
        order = np.argsort(rank)
        while width < depth:
            after = np.full(n, -1, np.int64)
            after[: max(0, n - width)] = rank[width:]
            key = rank * (n + int(rank.max(initial=0)) + 2) + after + 1
            order = np.argsort(key)
            new = np.ones(n, np.int64)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            width *= 2
        self.suffixes = order
        self.transform = Wavelet(sequence[order - 1])
        counts = np.bincount(sequence, minlength=int(sequence.max(initial=0)) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol at their front."""
        a, b = self.transform.rank(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + b

    def search(self, sequence: np.ndarray, starts: np.ndarray, length: int | np.ndarray, least: int = 2, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns sequence[start : start + length]: which have `least` occurrences (their numbers), and their intervals.

        weights: of each place of the sequence, as how many occurrences it counts.
        """
        before = np.arange(len(sequence) + 1) if weights is None else np.append(0, np.cumsum(weights[self.suffixes]))
        length = np.broadcast_to(length, len(starts))
        which, at = np.arange(len(starts)), starts + length - 1
        symbol = sequence[at]
        lo, hi = self.first[symbol], self.first[symbol + 1]
        out = []
        while len(which):
            keep = before[hi] - before[lo] >= least
            done = keep & (at == starts[which])
            out.append((which[done], lo[done], hi[done]))
            keep &= ~done
            which, at, lo, hi = which[keep], at[keep] - 1, lo[keep], hi[keep]
            lo, hi = self.step(sequence[at], lo, hi)
        which, lo, hi = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        order = np.argsort(which)
        return which[order], lo[order], hi[order]


def index_shard(window: int):
    """The index of repeats.repeated_spans: spans whose windows stand earlier in the shard."""

    def of(shard: pa.Table) -> pa.Table:
        z = np.zeros(0, np.int64)
        none = findings(shard, z, z, z, z)
        data, offsets = T.flat(shard.column("piece").combine_chunks())
        starts, ends, at = T.words(data, offsets, T.NON_SPACE)
        doc, mark, first, weight, lone = (shard.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark", "first", "weight", "lone"))
        if not len(starts):
            return none
        of_word = T.owner(at)
        _, symbol = np.unique(T.word_hashes(data, starts, ends), return_inverse=True)
        count = np.bincount(symbol, weights=weight[of_word])
        # 0: the end of a piece; 1: a word that occurs once
        names = np.where(count > 1, np.cumsum(count > 1) + 1, 1)
        n = len(starts) + len(at) - 1
        sequence, weights = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = np.arange(len(starts)) + of_word
        sequence[place] = names[symbol]
        weights[place] = weight[of_word]
        here = T.window_starts(at, window)
        # a piece whose gram has no other content is one pattern as a whole; of the others each window is one
        here = here[lone[of_word[here]] == 0]
        alone = np.concatenate([[0], np.cumsum(names[symbol] == 1)])
        here = here[alone[here + window] == alone[here]]
        single = np.flatnonzero((lone > 0) & (weight > 1))
        pattern = np.concatenate([here + of_word[here], at[single] + single])
        length = np.concatenate([np.full(len(here), window), np.diff(at)[single]])
        if not len(pattern):
            return none
        index = FMIndex(sequence, int(length.max()))
        found, lo, _ = index.search(sequence, pattern, length, weights=weights)
        # whole: single patterns, and pieces of which all windows are met again
        alone = found[found >= len(here)] - len(here)
        found, lo = found[: len(found) - len(alone)], lo[: len(found) - len(alone)]
        owner, found = of_word[here[found]], pattern[found]
        full = np.bincount(owner, minlength=len(weight)) == np.maximum(np.diff(at) - window + 1, 1)
        whole = np.concatenate([single[alone], np.flatnonzero((weight > 1) & full & (lone == 0))])
        # the least (doc_id, mark, start) of each interval
        start = first[owner] + found - at[owner] - owner
        order = np.lexsort((start, mark[owner], doc[owner], lo))
        lo, o, s = lo[order], owner[order], start[order]
        if not len(lo):
            return findings(shard, z, z, z, whole)
        heads = np.ones(len(lo), bool)
        heads[1:] = lo[1:] != lo[:-1]
        least = np.flatnonzero(heads)[np.cumsum(heads) - 1]
        later = (doc[o] != doc[o[least]]) | (mark[o] != mark[o[least]]) | (s != s[least])
        o, s = o[later], s[later]
        # neighbouring windows of a piece are one span
        order = np.lexsort((s, o))
        o, s = o[order], s[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (s[1:] > s[:-1] + window)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(o)).astype(np.int64) - 1
        return findings(shard, o[head], s[head], s[tail[: len(head)]] + window, whole)

    return of


def _cut(names: list[str], digest: bool):
    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                data, offsets = T.flat(run.column("text"))
                starts, ends, at = T.words(data, offsets, T.NON_SPACE)
                gone = marks(run, at)
                lost = np.bincount(T.owner(at)[gone], minlength=len(at) - 1) if len(gone) else np.zeros(len(at) - 1, np.int64)
                raw = data.tobytes()
                out: list = []
                for i in range(len(at) - 1):
                    if not digest and not lost[i]:
                        out.append(None)
                        continue
                    keep = np.flatnonzero(~gone[at[i] : at[i + 1]]) + at[i]
                    kept = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                    out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in names), pa.array(np.diff(at), pa.int64()), pa.array(lost.astype(np.int64)), pa.array(out, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return of


def substring_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, **bounds) -> DataFrame:
    """Of docs with _mark (repeats.marked)."""
    return repeated_spans(docs, "words", window, grams, True, index_shard(window), scratch, **bounds)


def remove(docs: DataFrame, window: int = WINDOW, grams: tuple[int, ...] = GRAMS, counts: tuple[str, str] = ("_n_words", "_n_removed")) -> DataFrame:
    """docs with later repeats cut from their texts: kept words joined by one space where any went, else the text as it was; and two counts."""
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    inner = marked(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), "doc_id", "text"))
    rows = with_spans(inner, substring_spans(inner, scratch, window, grams), scratch)
    kinds = StructType([inner.schema["own"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    cut = rows.mapInArrow(_cut(["own"], False), kinds)
    text = F.coalesce("kept", F.col("own").getField("text"))
    return cut.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col("own").getField(c)).alias(c) for c in names], F.col("n_words").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scratch = Scratch(spark)
    rows = with_spans(docs, substring_spans(docs, scratch), scratch)
    return rows.mapInArrow(_cut(["doc_id"], True), "doc_id long, n_words long, n_removed long, kept string").withColumnRenamed("kept", "kept_sha256")
