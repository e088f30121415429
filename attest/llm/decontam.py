"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned against every training token window.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A window is n consecutive words of an
item; an item with fewer words, but at least one, is a window as a whole. The set holds 64-bit hashes; each hit is then
verified against the window's bytes, so a hash collision removes nothing.

Size bound: the benchmark's distinct windows, each with its words and its items, are written in blocks of at most BLOCK_WINDOWS
windows and BLOCK_BYTES bytes of text; one block at a time is broadcast. The documents pass once for each block, and what
a pass found is written before the next, so one block's set is all that a worker or the driver holds. Usual benchmarks
are one block, and any number is exact. Measured: 100,000 windows of ten words are 10.7 MB of broadcast, so a full block is
about 55 MB in a worker and, while it is built, about three times that in the driver.

Defined results: null or empty texts and items have no words and are clean; repeated rows are judged alike; an item
whose id is null can remove words but is not listed; an empty benchmark leaves all documents clean. Further columns of
the documents, whatever their names, are kept apart and carried along.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import text as T
from .store import Scratch, fresh

BLOCK_WINDOWS, BLOCK_BYTES = 500_000, 64 << 20
FIELDS = StructType().add("n_words", "long").add("n_hit", "long").add("item_ids", ArrayType(StringType())).add("spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))).add("kept_text", "string")
FOUND = "_decontamination"


def _windows(n: int):
    """Benchmark rows (item, text) to their windows: number of words, hash, the words joined by a space, and the item."""

    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                data, offsets = T.flat(run.column("text"))
                data = T.LOWER[data]
                starts, ends, at = T.words(data, offsets, T.ALNUM)
                size = np.minimum(np.diff(at), n)
                first = np.concatenate([T.window_starts(at, n), at[:-1][(size > 0) & (size < n)]])
                of_item = np.searchsorted(at, first, side="right") - 1
                m = size[of_item]
                sums = T.prefix(T.word_hashes(data, starts, ends)) if len(starts) else np.zeros(1, np.uint64)
                raw = data.tobytes()
                words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                grams = [b" ".join(words[i : i + k]) for i, k in zip(first.tolist(), m.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array(T.span_hash(sums, first, first + m).view(np.int64)), pa.array(grams, pa.binary()), run.column("item").take(pa.array(of_item))], names=["m", "h", "gram", "item"])

    return of


def _set(block: pa.Table) -> dict:
    """One block's set: by window length, sorted hashes, a filter that answers most windows with one look-up, bytes and items."""
    out = {}
    names, lengths = block.column("item").combine_chunks(), block.column("m").to_numpy()
    for m in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == m)
        h = block.column("h").to_numpy()[own].view(np.uint64)
        order = np.argsort(h, kind="stable")
        flat, offsets = T.flat(block.column("gram").combine_chunks().take(pa.array(own[order])))
        bits = np.zeros(1 << 20, bool)
        bits[h >> np.uint64(44)] = True
        out[m] = (h[order], bits, flat.tobytes(), offsets, names.take(pa.array(own[order])))
    return out


def _scan(sets, n: int, names: list[str], last: bool):
    """A mapInArrow function: looks for the windows of one block and adds to what earlier blocks found."""

    def of(batches):
        grams = pickle.loads(sets.value)
        for batch in batches:
            for run in T.runs(batch):
                yield _judge(run, grams, names, last)

    return of


def _judge(run: pa.RecordBatch, grams: dict, names: list[str], last: bool) -> pa.RecordBatch:
    original, offsets = T.flat(run.column("text"))
    data = T.LOWER[original]
    starts, ends, at = T.words(data, offsets, T.ALNUM)
    hashes = T.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    rows = len(offsets) - 1
    hit = np.zeros(len(starts), bool)
    items: list[set] = [set() for _ in range(rows)]
    if "item_ids" in run.schema.names:  # of earlier blocks
        for i, (old, spans) in enumerate(zip(run.column("item_ids").to_pylist(), run.column("spans").to_pylist(), strict=True)):
            items[i].update(old)
            for s in spans:
                hit[at[i] + s["start"] : at[i] + s["end"]] = True
    of = T.owner(at)
    raw = data.tobytes()
    for m, (keys, bits, flat, edges, names_of) in grams.items():
        first, h = T.window_hashes(hashes, at, m)
        near = np.flatnonzero(bits[h >> np.uint64(44)])
        if not len(near):
            continue
        lo, hi = np.searchsorted(keys, h[near]), np.searchsorted(keys, h[near], side="right")
        for w, a, b in zip(first[near[lo < hi]].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
            here = b" ".join([raw[x:y] for x, y in zip(starts[w : w + m].tolist(), ends[w : w + m].tolist(), strict=True)])
            for x in range(a, b):  # windows of one hash
                if here == flat[edges[x] : edges[x + 1]]:
                    hit[w : w + m] = True
                    items[int(of[w])].update(names_of[x].as_py())
    n_hit = np.bincount(of[hit], minlength=rows)
    s, e, whose = T.join_spans(hit, at)
    spans: list[list] = [[] for _ in range(rows)]
    kept: list[str | None] = [None] * rows
    cuts: dict[int, list] = {}
    for a, b, i in zip(s.tolist(), e.tolist(), whose.tolist(), strict=True):
        spans[i].append({"start": a - int(at[i]), "end": b - int(at[i])})
        cuts.setdefault(i, []).append((int(starts[a]), int(ends[b - 1])))
    if last:
        whole = original.tobytes()
        for i, c in cuts.items():
            pieces, p = [], int(offsets[i])
            for a, b in c:
                pieces.append(whole[p:a])
                p = b
            kept[i] = b"".join([*pieces, whole[p : int(offsets[i + 1])]]).decode()
    own = [run.column(c) for c in names]
    return pa.RecordBatch.from_arrays(
        [*own, pa.array(np.diff(at), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
        names=[*names, "n_words", "n_hit", "item_ids", "spans", "kept_text"],
    )


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_windows: int = BLOCK_WINDOWS, name: str = FOUND) -> DataFrame:
    """The documents' columns and, as `name`, struct(n_words, n_hit, item_ids, spans (word indexes), kept_text (null if clean)).

    kept_text is the text without the hit spans.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), "text")
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(_windows(n), "m int, h long, gram binary, item string")
    windows = scratch.put(rows.groupBy("m", "h", "gram").agg(F.collect_set("item").alias("item")), "windows")
    count, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0))).first()
    blocks = max(1, -(-count // block_windows), -(-size // BLOCK_BYTES))
    out, schema = inner, StructType([inner.schema["own"], StructField("text", StringType()), *FIELDS.fields])
    before = None
    for k in range(blocks):
        block = windows.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k) if blocks > 1 else windows
        sets = spark.sparkContext.broadcast(pickle.dumps(_set(block.toArrow())))
        out = out.mapInArrow(_scan(sets, n, ["own", "text"], k == blocks - 1), schema)
        if k < blocks - 1:  # what this pass found is written, so that the next holds its own set only
            out = scratch.put(out, "found")
            sets.destroy()
            if before is not None:
                scratch.drop(before)
            before = out
    scratch.drop(windows)
    return out.select(*[F.col("own").getField(c).alias(c) for c in names], F.struct("n_words", "n_hit", "item_ids", "spans", "kept_text").alias(name))


def remove(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: float = 0.5) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out; a document with more than `most` of its words hit goes."""
    name = fresh(docs.columns, FOUND)
    found = scan(docs, benchmark, n, name=name)
    text = F.coalesce(F.col(name).kept_text, F.col("text"))
    kept = found.where(F.col(name).n_hit <= most * F.col(name).n_words)
    return kept.select(*[(text if c == "text" else F.length(text).cast("long") if c == "n_chars" else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    from .store import table

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    f = F.col(FOUND)
    return found.select(
        "doc_id",
        f.n_words.alias("n_words"),
        f.n_hit.alias("n_hit"),
        F.size(f.item_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f.item_ids), ","), 256).alias("items_sha256"),
        (f.n_hit > 0).alias("contaminated"),
    )
