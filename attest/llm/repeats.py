"""Where texts share windows: the search that routes equal windows to one shard, for substring operators.

A window is `window` consecutive units (bytes or words) of a text. In each window one run of `gram` units is chosen by
content, that with the least hash (the leftmost of equals), so equal windows choose equal grams at the same place. The
windows of a text that choose the same gram form a stretch; its units are a content. Stretches of one gram are the only
places where a window of that stretch can be met again, so:

1. Stretches whose gram stands in no other stretch hold no repeat and go.
2. Equal contents (by 64-bit hash of content beside the gram's) are pre-aggregated: the first stretch of each distinct
   content stands for all, with their number as its weight.
3. Contents that occur more than once, and those whose gram has another content, are dealt to shards by gram, with their
   text. A shard's index decides: it names the spans of each content's first stretch that are met again, and the
   contents that are repeats as a whole, which then go for all their stretches. An index that is given no second
   stretch and no weight finds nothing.
4. The contents of a gram with more than BLOCK of them go to one shard each by their own hash, and among each other
   through the same steps again with a longer gram, up to the window itself. So no shard holds an unbounded group,
   and no size leaves the method.

Long texts are cut into overlapping pieces, so memory does not grow with the longest text's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import Scratch

PIECE, BLOCK, SHARD_BYTES = 1 << 22, 4096, 2 << 20
_LOW = np.uint64((1 << 24) - 1)
_OTHER = np.uint64(0x9FB21C651E98DF25)


class Units:
    """How a text is cut into units. by: 'bytes' or 'words' (between ASCII white space)."""

    def __init__(self, by: str):
        self.by = by

    def cut(self, data: np.ndarray, offsets: np.ndarray):
        """Unit values, offsets of texts' units, and starts and ends of units in data (None for bytes)."""
        if self.by == "bytes":
            return T.byte_values(data), offsets, None, None
        starts, ends, at = T.words(data, offsets, T.NON_SPACE)
        return (T.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), at, starts, ends


def stretches(values: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Text, first and last window start (within the text), gram hash and content hash of every stretch."""
    texts, firsts, lasts, grams, contents = [], [], [], [], []
    if len(offsets) == 2 and len(values) > PIECE:
        cuts = [(a, min(len(values), a + PIECE + window - 1)) for a in range(0, len(values) - window + 1, PIECE)]
    else:
        cuts = [(0, len(values))]
    for lo, hi in cuts:
        own = np.clip(offsets, lo, hi) - lo
        part = values[lo:hi]
        starts = T.window_starts(own, window)
        if not len(starts):
            continue
        sums = T.prefix(part)
        n = len(part) - gram + 1
        h = T.span_hash(sums, np.arange(n), np.arange(gram, gram + n))
        key = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
        # the least key over each run of grams of a window, by doubling
        span, width = window - gram + 1, 1
        while 2 * width <= span:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < span:
            key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
        chosen = (key[starts] & _LOW).astype(np.int64)
        of = np.searchsorted(own, starts, side="right") - 1
        new = np.ones(len(starts), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(starts)) - 1
        a, b = starts[head], starts[tail]
        texts.append(of[head])
        firsts.append(a + lo - offsets[of[head]])
        lasts.append(b + lo - offsets[of[head]])
        grams.append(h[chosen[head]])
        # the place of the gram is part of a content's hash
        contents.append(T.mix(T.span_hash(sums, a, b + window) ^ T.mix((chosen[head] - a).astype(np.uint64) * _OTHER)))
    if not texts:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in (texts, firsts, lasts, grams, contents))


def _grams(units: Units, window: int, gram: int):
    """The chosen grams of all stretches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in T.runs(batch):
                values, at, _, _ = units.cut(*T.flat(run.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(stretches(values, at, window, gram)[3].view(np.int64))], names=["gram"])

    return of


def _find(units: Units, window: int, gram: int):
    """All stretches with their grams and contents."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in T.runs(batch):
                data, offsets = T.flat(run.column("text"))
                values, at, _, _ = units.cut(data, offsets)
                text, first, last, g, c = stretches(values, at, window, gram)
                base = run.column("base").to_numpy().astype(np.int64)[text]
                yield pa.RecordBatch.from_arrays([*(run.column(x).take(pa.array(text)) for x in ("doc_id", "mark", "base")), pa.array((base + first).astype(np.int32)), pa.array((base + last).astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=["doc_id", "mark", "base", "first", "last", "gram", "content"])

    return of


def _slices(units: Units, window: int):
    """The bytes of the stretches that go to a shard."""

    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                data, offsets = T.flat(run.column("text"))
                _, at, starts, ends = units.cut(data, offsets)
                raw = data.tobytes()
                base = run.column("base").to_numpy().astype(np.int64)
                spans = run.column("spans")
                text = np.repeat(np.arange(run.num_rows), np.diff(spans.offsets.to_numpy()))
                flat = spans.flatten()
                first = flat.field("first")
                a = at[text] + first.to_numpy() - base[text]
                b = at[text] + flat.field("last").to_numpy() - base[text] + window
                if starts is not None:
                    a, b = starts[a], ends[b - 1]
                pieces = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(run.column(x).take(pa.array(text)) for x in ("doc_id", "mark")), first, *(flat.field(x) for x in ("gram", "content", "weight", "hot", "lone")), pieces], names=["doc_id", "mark", "first", "gram", "content", "weight", "hot", "lone", "piece"])

    return of


def marked(docs: DataFrame) -> DataFrame:
    """docs with the column _mark that, with doc_id, names a text: 0, or a checksum of the text where rows share a doc_id."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return docs.withColumn("_mark", F.lit(0).cast("long") if again else F.crc32("text"))


#: What an index gives: spans of first stretches (gram and content null), and contents that are repeats as a whole (doc_id null).
FOUND = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("gram", pa.int64()), ("content", pa.int64())])


def findings(shard: pa.Table, piece: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> pa.Table:
    """FOUND of spans (piece, start and end in the text) and of the pieces that are repeats as a whole."""
    n, m = len(piece), len(whole)
    own = [pa.concat_arrays([shard.column(c).combine_chunks().take(pa.array(piece, pa.int64())), pa.nulls(m, pa.int64())]) for c in ("doc_id", "mark")]
    span = [pa.concat_arrays([pa.array(np.asarray(x, np.int32), pa.int32()), pa.nulls(m, pa.int32())]) for x in (starts, ends)]
    kind = [pa.concat_arrays([pa.nulls(n, pa.int64()), shard.column(c).combine_chunks().take(pa.array(whole, pa.int64()))]) for c in ("gram", "content")]
    return pa.Table.from_arrays([*own, *span, *kind], schema=FOUND)


def repeated_spans(docs: DataFrame, by: str, window: int, grams: tuple[int, ...], earlier: bool, index: Callable, scratch: Scratch, block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, mark, start, end) in units: spans covered by windows that also start elsewhere (earlier: only at a lesser (doc_id, start)).

    docs: of marked(). grams: the gram's length, and the longer ones for grams with many contents.
    index(table of doc_id, mark, first, gram, content, weight, lone, piece) gives FOUND of one shard; it must know only the
    windows inside each piece. lone: no other content of the shard can share a window with this one.
    """
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("_mark").alias("mark"), F.lit(0).alias("base"), "text")
    out = None
    for gram in (*(g for g in grams if g < window), window):
        spans, texts = _level(texts, Units(by), window, gram, earlier, index, scratch, block, shard_bytes)
        for s in spans:
            out = s if out is None else out.unionByName(s)
        if texts is None:
            break
    return out


def _level(texts: DataFrame, units: Units, window: int, gram: int, earlier: bool, index: Callable, scratch: Scratch, block: int, shard_bytes: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Spans found with one gram length, and the contents of grams with more than `block` of them (or None)."""
    found = texts.mapInArrow(_find(units, window, gram), "doc_id long, mark long, base int, first int, last int, gram long, content long")
    grams = texts.select("text").mapInArrow(_grams(units, window, gram), "gram long")
    twice = scratch.put(grams.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "twice")
    shared = scratch.put(found.join(twice, "gram"), "shared")
    scratch.sweep(twice)
    distinct = scratch.put(shared.groupBy("gram", "content").agg(F.min(F.struct("doc_id", "mark", "first", "last", "base")).alias("at"), F.count("*").alias("weight")), "distinct")
    kinds = distinct.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("weight").alias("most")).where("kinds > 1 or most > 1").select("gram", (F.col("kinds") > block).alias("hot"), (F.col("kinds") == 1).alias("lone"))
    wanted = distinct.join(scratch.put(kinds, "kinds"), "gram").select("at.*", "gram", "content", "weight", "hot", "lone")
    by_text = wanted.groupBy("doc_id", "mark", "base").agg(F.collect_list(F.struct("first", "last", "gram", "content", "weight", "hot", "lone")).alias("spans"))
    pieces = texts.join(scratch.put(by_text, "wanted"), ["doc_id", "mark", "base"])
    pieces = scratch.put(pieces.mapInArrow(_slices(units, window), "doc_id long, mark long, first int, gram long, content long, weight long, hot boolean, lone boolean, piece binary"), "pieces")
    scratch.sweep(*(t for t in scratch.tables if t._attest_path.endswith(("-kinds", "-wanted"))))
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    if not size:
        return [], None
    group = F.when(F.col("hot"), F.xxhash64("gram", "content")).otherwise(F.xxhash64("gram"))
    shard = F.pmod(group, F.lit(max(1, -(-size // shard_bytes)))).cast("int")
    # a hot content meets the others of its gram with the longer gram; here it is alone
    dealt = pieces.where("not hot or weight > 1").select(shard.alias("shard"), "doc_id", "mark", "first", "gram", "content", "weight", (F.col("lone") | F.col("hot")).alias("lone"), "piece")
    indexed = scratch.put(dealt.groupBy("shard").applyInArrow(index, "doc_id long, mark long, start int, end int, gram long, content long"), "indexed")
    whole = indexed.where("gram is not null").select("gram", "content").distinct()
    if earlier:
        # all stretches of such a content but its first
        firsts = scratch.put(whole.join(distinct.select("gram", "content", "at"), ["gram", "content"]), "firsts")
        again = shared.join(firsts, ["gram", "content"]).where("not (doc_id = at.doc_id and mark = at.mark and first = at.first)")
    else:
        again = shared.join(whole, ["gram", "content"])
    again = scratch.put(again.select("doc_id", "mark", F.col("first").alias("start"), (F.col("last") + window).alias("end")), "again")
    scratch.drop(shared, distinct)
    hot = pieces.where("hot").select("doc_id", "mark", F.col("first").alias("base"), F.col("piece").alias("text"))
    spans = [indexed.where("gram is null").select("doc_id", "mark", "start", "end"), again]
    if gram >= window or hot.isEmpty():
        scratch.drop(pieces)
        return spans, None
    return spans, hot


def with_spans(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (of marked()) with the array column _spans of their (start, end), empty where there are none; without _mark."""
    merged = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("_spans")) if spans is not None else None
    if merged is None:
        return docs.drop("_mark").withColumn("_spans", F.lit(None).cast("array<struct<start:int,end:int>>"))
    merged = scratch.put(merged.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_of"), "_spans"), "spans")
    scratch.keep(merged)
    return docs.join(merged, (F.col("doc_id") == F.col("_id")) & (F.col("_mark") == F.col("_of")), "left").drop("_id", "_of", "_mark")


def marks(run: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """True for the units of the run's texts that its _spans cover."""
    spans = run.column("_spans")
    spans = spans.slice(0)  # offsets from the run's first row on
    lengths = np.array([0 if not x.is_valid else len(x) for x in spans], np.int64)
    flat = spans.flatten()
    if not len(flat):
        return np.zeros(int(at[-1]), bool)
    text = np.repeat(np.arange(len(lengths)), lengths)
    start, end = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
    lo, hi = at[text], at[text + 1]
    return T.cover(int(at[-1]), np.minimum(lo + start, hi), np.minimum(lo + end, hi))
