"""Language identification by prediction by partial matching: exact code lengths under frozen byte-context statistics.

Each language has a context tree of orders 0 to 3 over bytes (A-Z folded, digits and white space merged, rare bytes one
symbol). A symbol not seen in a context escapes to the next shorter one with method C's probability, with exclusion: the
shorter context's probabilities are taken over the symbols not seen in the longer one, so each context's distribution
sums to 1 and -log2 is an exact code length. The statistics are frozen after training, so the code length of every
(context, symbol) is a table entry; one automaton state per longest known context serves all languages at once, and
scoring a text is two look-ups per byte. The language with the shortest code wins (ties: least name).

Fitted on a bounded sample: at most SAMPLE texts of at most SAMPLE_BYTES bytes per language. Tables have at most
TABLE_BYTES bytes; the rarest contexts are left out beyond that.

Defined results: null text, or text without any letter, gives `und` and score 0, as does an empty training set; long
texts are scored whole; repeated rows alike. The score is the posterior of the winner under equal priors.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .samples import fold, labelled

SAMPLE, SAMPLE_BYTES, ORDER, TABLE_BYTES, SYMBOLS = 300, 20_000, 3, 48_000_000, 120
_LETTER = T.table((0x41, 0x5A), (0x61, 0x7A))


def _fold_bytes() -> np.ndarray:
    out = T.LOWER.copy()
    out[0x30:0x3A] = 0x30
    out[[9, 10, 11, 12, 13]] = 0x20
    return out


_FOLD = _fold_bytes()


def _shifted(symbols: np.ndarray, heads: np.ndarray, edge: int, order: int) -> list[np.ndarray]:
    """For 1 .. order, the symbol so many places before; `edge` before a text's start."""
    out, last = [], symbols
    for _ in range(order):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[:1] = edge
        before[heads] = edge
        out.append(before)
        last = before
    return out


class Model:
    """symbol (256), state (S ** order: longest known context), cost ((states * S) x languages, bits)."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, table_bytes: int = TABLE_BYTES):
        self.languages, self.order = sorted(texts), order
        if not texts:
            return
        data = {k: [np.frombuffer(t.encode(), np.uint8) for t in texts[k]] for k in self.languages}
        counts = np.zeros(256, np.int64)
        for parts in data.values():
            for p in parts:
                counts += np.bincount(_FOLD[p], minlength=256)
        counts[0x20] += 1
        known = [b for b in np.argsort(-counts, kind="stable")[:SYMBOLS].tolist() if counts[b]]
        S = self.size = len(known) + 1  # the last one is any other byte
        names = np.full(256, S - 1, np.int32)
        names[known] = np.arange(len(known))
        self.symbol = names[_FOLD]
        self.edge = int(names[0x20])
        L = len(self.languages)
        # context * S + symbol and their counts, for each order and language
        seen: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order + 1)]
        for k in self.languages:
            flat = np.concatenate(data[k]) if data[k] else np.zeros(0, np.uint8)
            lengths = np.array([len(p) for p in data[k]], np.int64)
            heads = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
            symbols = self.symbol[flat].astype(np.int64)
            code, power = symbols.copy(), S
            seen[0].append(np.unique(code, return_counts=True))
            for o, before in enumerate(_shifted(symbols, heads[heads < len(flat)], self.edge, order), 1):
                code = code + before * power
                power *= S
                seen[o].append(np.unique(code, return_counts=True))
        # the contexts of all languages, the commonest first where there are too many
        contexts = [np.zeros(1, np.int64)]
        totals = [np.zeros(1, np.int64)]
        for o in range(1, order + 1):
            c = np.concatenate([x // S for x, _ in seen[o]])
            u, at = np.unique(c, return_inverse=True)
            contexts.append(u)
            totals.append(np.bincount(at, weights=np.concatenate([n for _, n in seen[o]])).astype(np.int64))
        most = max(1 + S, table_bytes // (S * L * 4))
        every = np.sort(np.concatenate(totals[1:]))[::-1]
        least = int(every[most]) + 1 if len(every) > most else 1  # a suffix is at least as common as the whole, so it stays too
        kept = [contexts[0]] + [c[n >= least] for c, n in zip(contexts[1:], totals[1:], strict=True)]
        first = np.cumsum([0] + [len(c) for c in kept])
        cost = np.zeros((int(first[-1]) * S, L), np.float32)
        self.state = np.zeros(S**order, np.int32)
        for j in range(L):
            lower = None
            for o in range(order + 1):
                codes, n = seen[o][j]
                at = np.searchsorted(kept[o], codes // S)
                at[at == len(kept[o])] = 0
                ok = kept[o][at] == codes // S if len(kept[o]) else np.zeros(len(codes), bool)
                table = np.zeros((len(kept[o]), S))
                table[at[ok], codes[ok] % S] = n[ok]
                if o == 0:
                    below = np.full((1, S), 1 / S)
                else:
                    below = lower[np.searchsorted(kept[o - 1], kept[o] % S ** (o - 1))]
                total, kinds, have = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True), table > 0
                free = np.maximum(1 - (below * have).sum(1, keepdims=True), 1e-300)
                escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
                p = np.where(have, table / np.maximum(total + np.where(kinds == S, 0, kinds), 1), escape * below / free)
                lower = p
                cost[int(first[o]) * S : int(first[o + 1]) * S, j] = -np.log2(np.maximum(p, 1e-30)).ravel()
        self.cost = cost
        # longest known suffix of each context of full order
        full = np.arange(S**order, dtype=np.int64)
        for o in range(1, order + 1):
            if len(kept[o]):
                tail = full % S**o
                at = np.searchsorted(kept[o], tail)
                at[at == len(kept[o])] = 0
                ok = kept[o][at] == tail
                self.state[ok] = first[o] + at[ok]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text in each language."""
        S, out = self.size, np.zeros((len(offsets) - 1, len(self.languages)))
        if not len(data):
            return out
        symbols = self.symbol[data]
        full = offsets[:-1] < offsets[1:]
        heads = offsets[:-1][full]
        code, power = np.zeros(len(data), np.int32), 1
        for before in _shifted(symbols, heads, self.edge, self.order):
            code += before * np.int32(power)
            power *= S
        at = self.state[code] * np.int32(S) + symbols
        for j in range(len(self.languages)):
            out[full, j] = np.add.reduceat(self.cost[:, j][at] if len(self.languages) > 8 else np.take(self.columns()[j], at), heads, dtype=np.float64)
        return out

    def columns(self) -> list[np.ndarray]:
        if not hasattr(self, "_columns"):
            self._columns = [np.ascontiguousarray(self.cost[:, j]) for j in range(self.cost.shape[1])]
        return self._columns

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = T.flat(column)
        n = len(offsets) - 1
        letters = np.zeros(n, bool)
        full = offsets[:-1] < offsets[1:]
        if full.any():
            heads = offsets[:-1][full]
            letters[full] = np.logical_or.reduceat(_LETTER[data], heads)
            for i in np.flatnonzero(full & ~letters).tolist():
                letters[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace"))
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        bits = self.lengths(data, offsets)
        best = bits.argmin(1)
        score = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0)


def fit(docs: DataFrame, learn, per_language: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the rows of docs (doc_id, text, lang) where the condition `learn` holds and lang is not null."""
    texts: dict[str, list[str]] = {}
    for r in labelled(docs, docs.where(learn).select("doc_id", F.col("lang").alias("label")), "label", per_language, most_bytes):
        texts.setdefault(r["label"], []).append(r["text"])
    return Model(texts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text's language (lang_pred) and score for every row of docs."""
    frozen = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def of(batches):
        known = pickle.loads(frozen.value)
        for batch in batches:
            for run in T.runs(batch):
                names, score = known.predict(run.column("text"))
                yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold(4) != 2)
    return identify(docs, model).select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
