"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (letters, digits and characters beyond ASCII; A-Z folded) is the sum of the embeddings of three hashes, of the
whole word and of its first 4 and 6 bytes, so inflected forms of a word share most of it. Hashes not met often enough in
training have a zero embedding; a stored 64-bit key tells an unknown word from a known one in the same slot. FILTERS
filters of each width slide over each text's words (unknown words stand before and behind them); ReLU, the maximum over the whole text, and a logistic output with
weights of at least 0 follow: evidence adds, nothing excuses. Embeddings, filters and output all start at random and are
trained by Adam in batches of texts, with a part of the pooled values dropped; a maximum passes its gradient to its own
place only.

Thresholds are calibrated by language: the language is guessed from the text's own common words (naive Bayes fitted with
the sample's lang values; lang is never read when scoring). Every text of the sample gets a logit from a network that has
not seen it (FOLDS networks, each trained on the other parts), so all of them count, and per language the threshold is put
where recall less CLEAN_COST times the false positive rate is best. The network that scores is trained on the whole
sample. The score is the logistic of the distance to the threshold, so 0.5 is the cut in each language.

Fitted on a bounded sample: at most SAMPLE labelled texts of at most SAMPLE_BYTES bytes per label. Defined results: null
and empty texts score as texts without words; repeated rows alike; without both labels in the sample every score is
the share of label 1 (0 if there is none); whole texts are read however long; further columns are carried along.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import text as T
from .samples import fold, labelled

SAMPLE, SAMPLE_BYTES, STEMS, SLOTS, PROFILE = 1000, 30_000, (4, 6), 1 << 18, 400
#: A clean text lost costs this many times a toxic one missed; a language with fewer texts of a label has the common threshold.
CLEAN_COST, LEAST_TEXTS, FOLDS = 5.0, 12, 3
WIDTHS, FILTERS, DIM, LEAST_DF, EPOCHS, BATCH, RATE, DROP = (1, 2, 3), 16, 16, 3, 14, 32, 0.01, 0.3
PAD, CHUNK = max(WIDTHS) - 1, 1 << 15


def _tokens(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of words and of their stems, and the offsets of texts' words."""
    data, offsets = T.flat(column)
    data = T.LOWER[data]
    starts, ends, at = T.words(data, offsets, T.ALNUM)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (1 + len(STEMS)), at
    sums = T.prefix(T.byte_values(data))
    return [T.span_hash(sums, starts, ends), *(T.span_hash(sums, starts, np.minimum(ends, starts + n)) ^ np.uint64(n << 40 | 1) for n in STEMS)], at


class Network:
    """Convolutions over word embeddings: parameters, training, and the logits of texts."""

    def __init__(self, words: int, widths: tuple[int, ...], rng: np.random.Generator):
        self.widths = widths
        self.emb = rng.normal(0, 0.1, (words, DIM)).astype(np.float32)
        self.emb[0] = 0
        # filters of all widths and places beside each other: one product gives all their terms
        self.kernel = rng.normal(0, 0.3, (DIM, sum(widths) * FILTERS)).astype(np.float32)
        self.bias = np.zeros(len(widths) * FILTERS, np.float32)
        self.out = np.abs(rng.normal(0, 0.3, len(widths) * FILTERS)).astype(np.float32)
        self.rest = np.full(1, -1.0, np.float32)

    def responses(self, e: np.ndarray) -> Iterator[np.ndarray]:
        """Of each width the responses at every place of padded texts, but for the last PAD ones."""
        terms, column, n = e @ self.kernel, 0, len(e) - PAD
        for b, w in enumerate(self.widths):
            z = terms[:n, column : column + FILTERS] + self.bias[b * FILTERS : (b + 1) * FILTERS]
            for j in range(1, w):
                z += terms[j : j + n, column + j * FILTERS : column + (j + 1) * FILTERS]
            yield z
            column += w * FILTERS

    def embed(self, ids: list[np.ndarray]) -> np.ndarray:
        e = self.emb[ids[0]]
        for x in ids[1:]:
            e += self.emb[x]
        return e

    def logits(self, ids: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Of padded texts. Places go in chunks, so memory does not grow with a text: a maximum is the greatest of its parts."""
        pooled = np.zeros((len(at) - 1, len(self.bias)), np.float32)
        for a in range(0, int(at[-1]), CHUNK):
            b = min(a + CHUNK, int(at[-1]))
            lo, hi = int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, b))
            heads = np.maximum(at[lo:hi], a) - a
            for k, z in enumerate(self.responses(self.embed([x[a : b + PAD] for x in ids]))):
                own = pooled[lo:hi, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, np.maximum.reduceat(z, heads, axis=0), out=own)
        return pooled @ self.out + self.rest[0]

    def train(self, ids: list[np.ndarray], at: np.ndarray, y: np.ndarray, chosen: np.ndarray, rng: np.random.Generator) -> None:
        dense = [self.kernel, self.bias, self.out, self.rest]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (*dense, self.emb)]
        step = 0
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // BATCH)):
                if len(part):
                    step += 1
                    own = [np.concatenate([*(x[at[i] : at[i + 1]] for i in part.tolist()), np.zeros(PAD, x.dtype)]) for x in ids]
                    self._step(own, np.append(0, np.cumsum(at[part + 1] - at[part])), y[part], dense, moments, step, rng)

    def _step(self, ids, at, y, dense, moments, step, rng) -> None:
        n, e = len(y), self.embed(ids)
        pooled, where = np.zeros((n, len(self.bias)), np.float32), np.zeros((n, len(self.bias)), np.int64)
        for b, z in enumerate(self.responses(e)):
            for i in range(n):
                own = z[at[i] : at[i + 1]]
                best = own.argmax(0)
                pooled[i, b * FILTERS : (b + 1) * FILTERS] = np.maximum(own[best, np.arange(FILTERS)], 0)
                where[i, b * FILTERS : (b + 1) * FILTERS] = best + at[i]
        keep = (rng.random(pooled.shape) >= DROP) / np.float32(1 - DROP)
        used = pooled * keep
        d = (1 / (1 + np.exp(-np.clip(used @ self.out + self.rest[0], -30, 30))) - y) / n
        grads = [np.zeros_like(self.kernel), None, used.T @ d, np.array([d.sum()])]
        g = (d[:, None] * self.out) * keep * (pooled > 0)
        grads[1] = g.sum(0)
        rows, changes, column = [], [], 0
        for b, w in enumerate(self.widths):
            of, places = g[:, b * FILTERS : (b + 1) * FILTERS], where[:, b * FILTERS : (b + 1) * FILTERS]
            i, f = np.nonzero(of)
            for j in range(w):
                at_words, c = places[i, f] + j, column + j * FILTERS + f
                np.add.at(grads[0].T, c, of[i, f][:, None] * e[at_words])
                change = of[i, f][:, None] * self.kernel.T[c]
                for x in ids:
                    rows.append(x[at_words])
                    changes.append(change)
            column += w * FILTERS
        rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        for p, grad, (m, s) in zip(dense, grads, moments, strict=False):
            m += 0.1 * (grad + 1e-4 * p - m)
            s += 0.01 * ((grad + 1e-4 * p) ** 2 - s)
            p -= (rate * m / (np.sqrt(s) + 1e-7)).astype(np.float32)
        np.maximum(self.out, 0, out=self.out)  # evidence only ever adds: a text without words has the least logit
        touched, back = np.unique(np.concatenate(rows), return_inverse=True)
        if len(touched):
            grad = np.zeros((len(touched), DIM), np.float32)
            np.add.at(grad, back, np.concatenate(changes))
            m, s = moments[-1]
            m[touched] += 0.1 * (grad - m[touched])
            s[touched] += 0.01 * (grad**2 - s[touched])
            self.emb[touched] -= (rate * m[touched] / (np.sqrt(s[touched]) + 1e-7)).astype(np.float32)
            self.emb[0] = 0


class Model:
    def __init__(self, rows: list[tuple[str, int, str | None]], seed: int = 3, widths: tuple[int, ...] = WIDTHS):
        """rows: text, label and language (or None)."""
        y = np.array([r[1] for r in rows], np.float64)
        self.prior = float(y.mean()) if len(y) else 0.0
        self.ready = len(rows) >= 2 * FOLDS and 0 < self.prior < 1
        if not self.ready:
            return
        rng = np.random.default_rng(seed)
        parts = [_tokens(b) for b in T.blocks(pa.array([r[0] for r in rows], pa.string()))]  # the driver's memory is small
        kinds = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        doc = T.owner(at)
        # features by document frequency, those for the language profile first
        pairs = _pairs(np.concatenate(kinds), np.concatenate([doc] * len(kinds)))
        keys, df = np.unique(pairs[0], return_counts=True)
        good = np.flatnonzero(df >= LEAST_DF)
        good = good[np.argsort(-df[good], kind="stable")][: SLOTS // 4]
        slot = (keys[good] & np.uint64(SLOTS - 1)).astype(np.int64)
        _, lone = np.unique(slot, return_index=True)  # the commonest keeps a shared slot
        good = good[np.sort(lone)]
        self.keys = np.concatenate([np.zeros(1, np.uint64), keys[good]])
        self.slots = np.zeros(SLOTS, np.int32)
        self.slots[(keys[good] & np.uint64(SLOTS - 1)).astype(np.int64)] = np.arange(1, len(good) + 1)
        ids = [self.ids(h) for h in kinds]
        # the language of a text from its common words
        self.languages = sorted({r[2] for r in rows if r[2] is not None})
        P = self.profile = min(PROFILE, len(self.keys))
        self.words_of = np.zeros((P, max(1, len(self.languages))))
        if self.languages:
            of = np.array([self.languages.index(r[2]) if r[2] is not None else -1 for r in rows])[doc]
            ok = (of >= 0) & (ids[0] > 0) & (ids[0] < P)
            counts = np.zeros((P, len(self.languages)))
            np.add.at(counts, (ids[0][ok], of[ok]), 1)
            self.words_of = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * P))
            self.words_of[0] = 0
        lang = np.concatenate([self._language(ids[0][at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in _ranges(len(rows))])
        ids, at = _padded(ids, at)
        part = lambda a, b: ([x[at[a] : at[b] + PAD] for x in ids], at[a : b + 1] - at[a])
        # logits of texts by networks that have not seen them, then a threshold for each language
        logits, fold = np.zeros(len(rows)), rng.permutation(len(rows)) % FOLDS
        for k in range(FOLDS):
            other = Network(len(self.keys), widths, rng)
            other.train(ids, at, y, np.flatnonzero(fold != k), rng)
            seen = np.concatenate([other.logits(*part(a, b)) for a, b in _ranges(len(rows))])
            logits[fold == k] = seen[fold == k]
        self.network = Network(len(self.keys), widths, rng)
        self.network.train(ids, at, y, np.arange(len(rows)), rng)
        self.scale = 4.0 / max(0.5, float(np.abs(logits).mean()))
        # without enough texts, the threshold is where the training loss has it
        common = _threshold(logits, y, 0.0)
        cuts = [_threshold(logits[lang == j], y[lang == j], common) for j in range(max(1, len(self.languages)))]
        nothing = self.network.logits([np.zeros(2 * PAD, np.int32)] * len(ids), np.array([0, PAD]))[0]
        self.threshold = np.maximum(cuts, nothing + 0.05)  # above a text without words

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        i = self.slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        return np.where(self.keys[i] == hashes, i, 0)

    def _language(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        lang, full = np.zeros(len(at) - 1, np.int64), at[:-1] < at[1:]
        if len(self.languages) > 1 and full.any():
            known = words * (words < self.profile)
            lang[full] = np.stack([np.add.reduceat(self.words_of[known, j], at[:-1][full]) for j in range(len(self.languages))], 1).argmax(1)
        return lang

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.ready:
            return np.full(len(column), self.prior)
        hashes, at = _tokens(column)
        ids = [self.ids(h) for h in hashes]
        logits, lang = self.network.logits(*_padded(ids, at)), self._language(ids[0], at)
        return 1 / (1 + np.exp(-np.clip(self.scale * (logits - self.threshold[lang]), -50, 50)))


def _padded(ids: list[np.ndarray], at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Texts with PAD unknown words before each and after the last, so that every filter reaches every word from every place."""
    n, shift = int(at[-1]) + PAD * len(at), PAD * np.arange(len(at))
    place = np.arange(int(at[-1])) + (T.owner(at) + 1) * PAD
    out = []
    for x in ids:
        y = np.zeros(n, x.dtype)
        y[place] = x
        out.append(y)
    return out, at + shift


def _ranges(n: int, step: int = 50) -> list[tuple[int, int]]:
    return [(i, min(i + step, n)) for i in range(0, n, step)]


def _pairs(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by key."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], docs[new]


def _threshold(logits: np.ndarray, y: np.ndarray, other: float) -> float:
    """Midway in the widest of the best gaps by recall less CLEAN_COST times the false positive rate; `other` where a label has too few texts."""
    if (y == 1).sum() < LEAST_TEXTS or (y == 0).sum() < LEAST_TEXTS:
        return other
    order = np.argsort(logits, kind="stable")
    x, t = logits[order], y[order]
    gain = np.cumsum(np.where(t == 0, CLEAN_COST / (t == 0).sum(), -1 / (t == 1).sum()))[:-1]
    gain[np.diff(x) <= 0] = -np.inf
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    widest = best[np.argmax(np.diff(x)[best])]
    return float((x[widest] + x[widest + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of labels (doc_id, toxic) over docs (doc_id, text and, if there, lang)."""
    extra = ("lang",) if "lang" in docs.columns else ()
    rows = labelled(docs, labels, "toxic", per_label, most_bytes, extra=extra)
    return Model([(r["text"], int(r["toxic"]), r["lang"] if extra else None) for r in rows])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the score."""
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), "text")

    def of(batches):
        known = pickle.loads(frozen.value)
        for batch in batches:
            for run in T.runs(batch):
                yield pa.RecordBatch.from_arrays([run.column("own"), pa.array(known.score(run.column("text")), pa.float64())], names=["own", "_score"])

    out = inner.mapInArrow(of, StructType([inner.schema["own"], StructField("_score", DoubleType())]))
    return out.select(*[F.col("own").getField(c).alias(c) for c in names], F.col("_score").alias(name))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "toxic"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
