"""Near duplicates by b-bit MinHash: packed signatures, band candidates, links confirmed on whole shingle sets.

A document's set holds the hashes of its distinct runs of `width` words (A-Z lower-cased, words between ASCII white
space); with fewer words the whole sequence is its one element; without words it is empty and linked with nothing.

1. Documents with equal sets are one node, named by the least doc_id; only nodes go on.
2. A band is a few minima of each node, hashed; nodes with the same hash share a bucket. bands_of() takes as many bands as
   leave a pair at the threshold in no common bucket with probability below MISS.
   Nodes that share a bucket get a signature: the lowest BITS bits of SLOTS minima, packed.
3. Twice (some bands, then all) each bucket whose nodes are not yet one component gives a spanning forest of its likely
   links: similarities are estimated from the signatures by bit counts, corrected for chance collisions (2**-BITS), and
   the highest estimates within SIGMAS standard errors of the threshold join first. These pairs, fewer than the
   bucket's rows, are confirmed on the whole sets.
4. What is still undecided is decided in place: nodes with a likely link out of their component meet, with their whole
   sets, in the first band that they share; a unit counts common shingles over its inverted index and gives a forest
   of the links that it has confirmed. So every likely pair is judged, and no step gives more rows than it read.
Links merge components (alternating stars).

A link is missed only if its pair meets in no band (MISS at the threshold, far less above it) or is estimated SIGMAS standard
errors too low (about 2e-8).

Buckets over 2 * BLOCK (counted in nodes, a long text as several) are dealt into blocks of about BLOCK: for the forests by
random salts, at the end so that all nodes outside the bucket's largest component meet all its nodes, block by block. So
no task holds a whole bucket, and no pair is left out.

Defined results: null and empty texts have empty sets; rows with a null doc_id are counted but linked with nothing and
kept; rows that repeat a doc_id are one node; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators.graphs import linked_components

from . import text as T
from .store import Scratch

SLOTS, BITS, SIGMAS, BLOCK, MISS = 1024, 4, 5.5, 256, 1e-6
#: Most rows of a band and most bands; shingles that count as one more node; bands of the first forests.
ROWS, MOST_BANDS, HEAVY, FIRST = 5, 64, 2048, 3
#: Estimates that one unit of groups makes, and bytes of sets that one unit confirms.
UNIT, UNIT_BYTES = 1 << 15, 1 << 21
_SEEDS = T.mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def bands_of(percent: int) -> tuple[int, int]:
    """Number of bands and minima in each: the most minima, up to ROWS, with which MOST_BANDS bands can do."""
    j = min(percent, 100) / 100
    for rows in range(ROWS, 0, -1):
        bands = 1 if j == 1 else math.ceil(math.log(MISS) / math.log(1 - j**rows))
        if bands <= MOST_BANDS:
            return bands, rows
    raise ValueError(f"similarities as low as {percent} % need more bands than {MOST_BANDS}")


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and their n + 1 offsets."""
    data, offsets = T.flat(column)
    data = T.LOWER[data]
    starts, ends, at = T.words(data, offsets, T.NON_SPACE)
    n = len(at) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    hashes = T.word_hashes(data, starts, ends)
    first, h = T.window_hashes(hashes, at, width)
    of = T.owner(at)[first]
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < width))
    if len(few):
        h = np.concatenate([h, T.span_hash(T.prefix(hashes), at[few], at[few + 1])])
        of = np.concatenate([of, few])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    h, of = h[new], of[new]
    return h, np.searchsorted(of, np.arange(n + 1))


def _minimum(h: np.ndarray, heads: np.ndarray, j: int) -> np.ndarray:
    """Minima of hash function j over each set."""
    return np.minimum.reduceat((((h ^ _SEEDS[2 * j]) * (_SEEDS[2 * j + 1] | np.uint64(1))) >> np.uint64(32)).astype(np.uint32), heads)


def _band_keys(h: np.ndarray, heads: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Sets x bands."""
    keys = np.zeros((len(heads), bands), np.uint64)
    for b in range(bands):
        x = np.full(len(heads), np.uint64(b + 1))
        for r in range(rows):
            x = T.mix(x * np.uint64(0x9E3779B97F4A7C15) + _minimum(h, heads, b * rows + r))
        keys[:, b] = x
    return keys


def _signatures(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sets x bytes: the low bits of all minima."""
    per = 8 // BITS
    out = np.zeros((len(heads), SLOTS // per), np.uint8)
    for j in range(SLOTS):
        out[:, j // per] |= (_minimum(h, heads, j) & np.uint32(2**BITS - 1)).astype(np.uint8) << np.uint8(BITS * (j % per))
    return out


def _describe(width: int, n_bands: int, n_rows: int):
    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                h, at = shingle_sets(run.column("text"), width)
                n, full = len(at) - 1, np.flatnonzero(at[:-1] < at[1:])
                keys = _band_keys(h, at[full], n_bands, n_rows) if len(full) else np.zeros((0, n_bands), np.uint64)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(full):
                    one[full] = np.add.reduceat(T.mix(h), at[full])
                    two[full] = np.add.reduceat(T.mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), at[full])
                some = np.zeros(n, bool)
                some[full] = True
                where = np.where(some, np.cumsum(some) - 1, 0)
                empty = ~some
                bands = [None] * n
                for i in full.tolist():
                    bands[i] = keys[where[i]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(one.view(np.int64), mask=empty), pa.array(two.view(np.int64), mask=empty), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "one", "two", "bands"],
                )

    return of


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from signatures (as 64-bit words): equal slots by bit counts, corrected for chance."""
    low = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS)))
    x = a ^ b
    differ = x.copy()
    for s in range(1, BITS):
        differ |= x >> np.uint64(s)
    equal = SLOTS - np.bitwise_count(differ & low).sum(-1)
    return (equal / SLOTS - 2.0**-BITS) / (1 - 2.0**-BITS)


def _groups(table: pa.Table):
    """The unit's rows in order of their (band, block, part), and first row and number of rows of each."""
    table = table.sort_by([("band", "ascending"), ("block", "ascending"), ("part", "ascending"), ("node", "ascending"), ("base", "ascending")])
    key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("band", "block", "part")], 1)
    heads = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    return table, heads, np.diff(np.append(heads, len(key)))


def _signatures_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(table.num_rows, -1)


def _likely_trees(comp: np.ndarray, signatures: np.ndarray, least: float) -> list[tuple[int, int]]:
    """A greatest spanning forest over the components by estimates of at least `least`: pairs of rows."""
    n = len(comp)
    best, link, out = np.full(n, -1.0), np.zeros(n, np.int64), []
    for _ in range(n):
        i = int(best.argmax())
        if least <= best[i] <= 1:
            out.append((int(link[i]), i))
        estimate = np.where(comp == comp[i], 2.0, np.minimum(_estimate(signatures, signatures[i]), 1.0))
        best[i] = -3.0  # in the tree
        nearer = (estimate > best) & (best > -2)
        best[nearer], link[nearer] = estimate[nearer], i
    return out


def _forest(least: float):
    """Pairs to confirm of a unit of (band, block) groups."""

    def of(table: pa.Table) -> pa.Table:
        table, heads, sizes = _groups(table)
        node, comp = table.column("node").to_numpy(), table.column("component").to_numpy()
        signatures = _signatures_of(table)
        two = heads[sizes == 2]
        two = two[comp[two] != comp[two + 1]]
        two = two[_estimate(signatures[two], signatures[two + 1]) >= least]
        pairs = {(int(x), int(y)) for x, y in zip(node[two].tolist(), node[two + 1].tolist(), strict=True)}
        for at, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            for i, j in _likely_trees(comp[at : at + n], signatures[at : at + n], least):
                x, y = int(node[at + i]), int(node[at + j])
                pairs.add((min(x, y), max(x, y)))
        found = sorted(pairs)
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return of


def _undecided(least: float):
    """Of a unit, the rows with a likely link to another component that no earlier band shares: all that must be judged on whole sets."""

    def of(table: pa.Table) -> pa.Table:
        table, heads, sizes = _groups(table)
        comp, base, number = table.column("component").to_numpy(), table.column("base").to_numpy(zero_copy_only=False), table.column("number").to_numpy()
        signatures = _signatures_of(table)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        want = np.zeros(table.num_rows, bool)
        two = heads[sizes == 2]
        two = two[(comp[two] != comp[two + 1]) & ~(base[two] & base[two + 1])]
        two = two[_estimate(signatures[two], signatures[two + 1]) >= least]
        two = two[(bands[two] == bands[two + 1]).argmax(1) == number[two]]
        want[two] = want[two + 1] = True
        for at, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            rows = slice(at, at + n)
            for i in (at + np.flatnonzero(~base[rows])).tolist():
                near = at + np.flatnonzero((comp[rows] != comp[i]) & (_estimate(signatures[rows], signatures[i]) >= least))
                near = near[(bands[near] == bands[i]).argmax(1) == number[i]]
                if len(near):
                    want[i] = True
                    want[near] = True
        return table.filter(pa.array(want)).select(["band", "block", "part", "node", "component", "base"])

    return of


def _linked(percent: int):
    """Links between components of a unit's groups, by whole sets: a forest of them."""

    def of(table: pa.Table) -> pa.Table:
        table, heads, sizes = _groups(table)
        node, comp, base = table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("base").to_numpy(zero_copy_only=False)
        items, found = table.column("items"), []
        for at, n in zip(heads.tolist(), sizes.tolist(), strict=True):
            if n < 2:
                continue
            sets = [np.frombuffer(items[k].as_py(), np.uint64) for k in range(at, at + n)]
            length = np.array([len(x) for x in sets])
            _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
            edges = np.append(0, np.cumsum(length))
            # rows of each shingle
            order = np.argsort(shingle, kind="stable")
            rows, first = np.repeat(np.arange(n), length)[order], np.append(0, np.cumsum(np.bincount(shingle)))
            _, label = np.unique(comp[at : at + n], return_inverse=True)
            for i in np.flatnonzero(~base[at : at + n]).tolist():
                other = label != label[i]
                if not other.any():
                    continue
                own = shingle[edges[i] : edges[i + 1]]
                lo, many = first[own], first[own + 1] - first[own]
                places = np.repeat(lo - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(int(many.sum()))
                both = np.bincount(rows[places], minlength=n)
                for j in np.flatnonzero(other & (100 * both >= percent * (length + length[i] - both))).tolist():
                    if label[i] != label[j]:
                        label[label == label[j]] = label[i]
                        found.append((int(node[at + i]), int(node[at + j])))
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return of


def _confirm(percent: int):
    def of(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return of


def _sets(width: int):
    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                h, at = shingle_sets(run.column("text"), width)
                full = np.flatnonzero(at[:-1] < at[1:])
                signatures = _signatures(h, at[full]) if len(full) else np.zeros((0, 8), np.uint8)
                yield pa.RecordBatch.from_arrays([run.column("node").take(pa.array(full)), pa.array([h[at[i] : at[i + 1]].tobytes() for i in full.tolist()], pa.binary()), pa.array([x.tobytes() for x in signatures], pa.binary())], names=["node", "items", "signature"])

    return of


def _deal(groups: DataFrame, units: int) -> DataFrame:
    return groups.withColumn("unit", F.pmod(F.xxhash64("band", "block", "part"), F.lit(max(1, units))).cast("int"))


def _blocks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows of buckets in groups (band, block, part) in which every node outside a bucket's largest component meets all its nodes."""
    own = [F.col(c) for c in ("number", "node", "component", "signature", "bands", "weight")]
    small = rows.where(F.col("load") <= 2 * BLOCK).select("band", F.lit(0).alias("block"), F.lit(0).alias("part"), *own, F.col("load").cast("long").alias("work"), F.lit(False).alias("base"))
    large = rows.where(F.col("load") > 2 * BLOCK)
    if large.isEmpty():
        return small
    sizes = large.groupBy("band", "component").agg(F.sum("weight").alias("size"))
    giant = scratch.put(sizes.groupBy("band").agg(F.max_by("component", F.struct("size", "component")).alias("giant"), F.sum("size").alias("all"), F.max("size").alias("most")), "giant")
    large = large.join(giant, "band").withColumn("blocks", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("all") / (8 * BLOCK)).cast("int"))
    block, part = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(2), "node"), F.col("parts")).cast("int")
    seek = large.where("component <> giant").select("band", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *own, F.lit(8 * BLOCK).cast("long").alias("work"), F.lit(False).alias("base"))
    meet = large.select("band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), *own, F.lit(0).cast("long").alias("work"), F.lit(True).alias("base"))
    return small.unionByName(seek).unionByName(meet)


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id it is joined with) and kept (it is that one)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select("doc_id", "text")
    j = percent / 100
    least = j - SIGMAS * (j * (1 - j) / SLOTS) ** 0.5 / (1 - 2.0**-BITS)
    n_bands, n_rows = bands_of(percent)
    described = scratch.put(docs.mapInArrow(_describe(width, n_bands, n_rows), "doc_id long, n long, one long, two long, bands array<long>"), "described")
    named = described.where("doc_id is not null and one is not null")
    nodes = scratch.put(named.groupBy("one", "two", "n").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    entries = nodes.select(F.posexplode("bands").alias("number", "band"), "node", (1 + F.col("n") / HEAVY).alias("weight"))
    shared = scratch.put(entries.groupBy("band").agg(F.count("*").alias("m"), F.sum("weight").alias("load")).where("m > 1").drop("m"), "shared")
    buckets = scratch.put(entries.join(shared, "band"), "buckets")
    members = scratch.put(buckets.select("node").distinct(), "members")
    own = docs.join(members.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = scratch.put(own.mapInArrow(_sets(width), "node long, items binary, signature binary").dropDuplicates(["node"]), "sets")
    labels = scratch.put(members.withColumn("component", F.col("node")), "labels")
    links = None

    def undecided(bands: int, *more: str) -> DataFrame:
        """Rows of the buckets that are not one component yet."""
        here = buckets.where(F.col("number") < bands).join(labels, "node")
        open_ = scratch.put(here.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band"), "open")
        out = here.join(open_, "band").join(sets.select("node", "signature"), "node")
        return scratch.put(out.join(nodes.select("node", "bands").dropDuplicates(["node"]), "node") if more else out, "rows")

    def join_up(found: DataFrame) -> None:
        nonlocal links, labels
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = scratch.put(members.join(linked_components(links, scratch), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")

    for bands in (FIRST, n_bands):
        rows = undecided(bands)
        salt = F.when(F.col("load") > 2 * BLOCK, F.pmod(F.xxhash64("band", "node"), F.ceil(F.col("load") / BLOCK))).otherwise(0)
        groups = rows.select("band", salt.cast("int").alias("block"), F.lit(0).alias("part"), "node", "component", "signature", F.lit(False).alias("base"))
        work = rows.agg(F.sum(F.least("load", F.lit(2.0 * BLOCK)) + 16)).first()[0] or 0
        pairs = scratch.put(_deal(groups, int(work / UNIT) + 1).groupBy("unit").applyInArrow(_forest(least), "a long, b long").distinct(), "pairs")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
        judged = scratch.put(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").select("a", "b"), "judged")
        scratch.drop(rows, pairs)
        join_up(judged)
    rows = undecided(n_bands, "bands")
    groups = _blocks(rows, scratch)
    work = groups.agg(F.sum(F.col("work") + 16)).first()[0] or 0
    kinds = "band long, block int, part int, node long, component long, base boolean"
    wanted = scratch.put(_deal(groups.drop("weight", "work"), int(work / UNIT) + 1).groupBy("unit").applyInArrow(_undecided(least), kinds), "wanted")
    scratch.drop(rows)
    full = wanted.join(sets.select("node", "items"), "node")
    size = full.agg(F.sum(F.octet_length("items"))).first()[0] or 0
    if size:
        join_up(scratch.put(_deal(full, int(size / UNIT_BYTES) + 1).groupBy("unit").applyInArrow(_linked(percent), "a long, b long").distinct(), "links"))
    named_sets = scratch.put(nodes.select("one", "two", "n", "node").join(labels, "node", "left").select("one", "two", "n", F.coalesce("component", "node").alias("component_id")), "named")
    scratch.keep(described, named_sets)
    out = described.join(named_sets, ["one", "two", "n"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from .store import table

    return near_duplicates(table(spark, sf_dir, "documents"))
