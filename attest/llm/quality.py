"""Quality: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Statistics of each whole text are counted once (shares of byte classes, word and line shapes, repetition). Shallow
trees are grown on random subsets of a labelled sample; every path from a root becomes a conjunctive rule of threshold
tests; logistic weights with an L1 penalty (proximal gradient) keep a few of them. Scoring is one column expression:
the logistic of a sum of weights of the rules that hold.

Fitted on a bounded sample: at most SAMPLE labelled texts of at most SAMPLE_BYTES bytes per label. Defined results: null
and empty texts have statistics 0 and get the score of those; repeated rows alike; without both labels in the sample
every score is the share of label 1 (0.5 if there is none); further columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import text as T
from .samples import fold, labelled

SAMPLE, SAMPLE_BYTES, TREES, DEPTH, BINS, PENALTY = 1000, 60_000, 40, 3, 24, 0.003
STATISTICS = ("log_words", "word_bytes", "short_words", "same_as_before", "distinct_words", "repeated_triples", "upper", "lower", "digit", "line_breaks", "common_marks", "end_marks", "other_marks", "beyond_ascii", "words_by_line", "marked_words")
_CLASSES = ("upper", "lower", "digit", "line_breaks", "common_marks", "end_marks", "other_marks", "beyond_ascii", "space")


def _class_table() -> np.ndarray:
    """Of each byte value, the number of its class."""
    out = np.full(256, _CLASSES.index("other_marks"), np.uint8)
    for name, values in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("line_breaks", (10, 13)), ("common_marks", b",;:'\"()-"), ("end_marks", b".!?"), ("beyond_ascii", range(128, 256)), ("space", (32, 9, 11, 12))):
        out[list(values)] = _CLASSES.index(name)
    return out


_CLASS = _class_table()
_MARK = np.isin(_CLASS, [_CLASSES.index("other_marks")]) | (np.arange(256) == 33)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = T.flat(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    size = np.maximum(np.diff(offsets), 1)
    k = len(_CLASSES)
    counts = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * k, np.diff(offsets)) + _CLASS[data], minlength=n * k).reshape(n, k)
    starts, ends, at = T.words(data, offsets, T.NON_SPACE)
    many = np.diff(at)
    some = np.maximum(many, 1)
    put = lambda name, x: out.__setitem__((slice(None), STATISTICS.index(name)), x)
    for name in _CLASSES[:-1]:
        put(name, counts[:, _CLASSES.index(name)] / size)
    put("log_words", np.log1p(many))
    put("words_by_line", np.log1p(many / (counts[:, _CLASSES.index("line_breaks")] + 1)))
    if len(starts):
        of = T.owner(at)
        length = ends - starts
        per = lambda mask: np.bincount(of, weights=mask, minlength=n) / some
        put("word_bytes", per(length))
        put("short_words", per(length <= 3))
        put("marked_words", per(_MARK[data[ends - 1]]))
        hashes = T.word_hashes(data, starts, ends)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        put("same_as_before", per(same))
        put("distinct_words", _distinct(hashes, of, n) / some)
        first, triples = T.window_hashes(hashes, at, 3)
        put("repeated_triples", 1 - np.where(many >= 3, _distinct(triples, of[first], n) / np.maximum(many - 2, 1), 1))
    return out


def _distinct(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(hashes, kind="stable")  # equal hashes stay in text order
    h, d = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def _grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng, depth: int) -> list[tuple]:
    """Paths of one tree as conjunctions ((statistic, above, threshold), ...)."""
    rules: list[tuple] = []

    def node(rows: np.ndarray, path: tuple) -> None:
        if path:
            rules.append(path)
        t = y[rows]
        if len(path) == depth or len(rows) < 20 or t.min() == t.max():
            return
        best = (1e-9, None)
        impurity = t.mean() * (1 - t.mean()) * len(t)
        for j in rng.choice(x.shape[1], 6, replace=False).tolist():
            for c in cuts[j].tolist():
                above = x[rows, j] > c
                a = int(above.sum())
                if a < 8 or len(rows) - a < 8:
                    continue
                p, q = t[above].mean(), t[~above].mean()
                gain = impurity - p * (1 - p) * a - q * (1 - q) * (len(rows) - a)
                if gain > best[0]:
                    best = (gain, (j, c))
        if best[1] is None:
            return
        j, c = best[1]
        above = x[rows, j] > c
        node(rows[above], (*path, (j, True, c)))
        node(rows[~above], (*path, (j, False, c)))

    node(np.arange(len(y)), ())
    return rules


def _holds(x: np.ndarray, rule: tuple) -> np.ndarray:
    return np.logical_and.reduce([(x[:, j] > c) == above for j, above, c in rule])


class Model:
    """weights: rule -> weight; bias."""

    def __init__(self, x: np.ndarray, y: np.ndarray, prior: float, trees: int = TREES, penalty: float = PENALTY, seed: int = 5):
        self.rules: list[tuple[tuple, float]] = []
        rate = min(max(prior, 1e-3), 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate))) if len(y) else 0.0
        if len(y) < 40 or y.min() == y.max():
            return
        rng = np.random.default_rng(seed)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        found: dict[tuple, None] = {}
        for _ in range(trees):
            rows = rng.choice(len(y), max(40, len(y) // 2), replace=False)
            found.update(dict.fromkeys(tuple(sorted(r)) for r in _grow(x[rows], y[rows], cuts, rng, DEPTH)))
        by_column: dict[bytes, tuple] = {}
        for rule in sorted(found, key=len):  # of rules that hold for the same rows the shortest is kept
            by_column.setdefault(_holds(x, rule).tobytes(), rule)
        rules = list(by_column.values())
        R = np.stack([_holds(x, r) for r in rules], 1).astype(np.float64)
        spread = np.maximum(R.std(0), 0.05)
        R = R / spread
        # both labels weigh as in the corpus, not as in the sample
        weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean())) / len(y)
        w, b, z, s, t = np.zeros(R.shape[1]), self.bias, np.zeros(R.shape[1]), self.bias, 1.0
        step = 4 / np.linalg.eigvalsh((R * weight[:, None]).T @ R + 1e-9 * np.eye(R.shape[1]))[-1]
        for _ in range(800):  # FISTA
            g = weight * (1 / (1 + np.exp(-np.clip(R @ z + s, -30, 30))) - y)
            new = z - step * (R.T @ g)
            new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
            nb, nt = s - step * g.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
            z, s = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = new, nb, nt
        self.bias = float(b)
        self.rules = [(r, float(v / d)) for r, v, d in zip(rules, w, spread, strict=True) if abs(v) > 1e-6]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((v * _holds(x, r) for r, v in self.rules), np.zeros(len(x))))))

    def column(self, stats: str = "stats") -> Column:
        """The score as an expression over the array column of statistics."""
        total = F.lit(self.bias)
        for rule, v in self.rules:
            tests = [F.col(stats)[j] > F.lit(float(c)) if above else F.col(stats)[j] <= F.lit(float(c)) for j, above, c in rule]
            every = tests[0]
            for t in tests[1:]:
                every = every & t
            total = total + F.when(every, F.lit(v)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of labels (doc_id, quality) over docs (doc_id, text)."""
    rows = labelled(docs, labels, "quality", per_label, most_bytes)
    share = labels.where(F.col("quality").isNotNull()).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    parts = [statistics(b) for b in T.blocks(pa.array([r["text"] for r in rows], pa.string()))]
    x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
    return Model(x, np.array([float(r["quality"]) for r in rows]), 0.5 if share is None else float(share))


def measure(docs: DataFrame, name: str = "stats") -> DataFrame:
    """docs with one more column, the array of STATISTICS of each text."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), "text")

    def of(batches):
        for batch in batches:
            for run in T.runs(batch):
                x = statistics(run.column("text"))
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([run.column("own"), values], names=["own", "_stats"])

    out = inner.mapInArrow(of, StructType([inner.schema["own"], StructField("_stats", ArrayType(DoubleType()))]))
    return out.select(*[F.col("own").getField(c).alias(c) for c in names], F.col("_stats").alias(name))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with one more column, the score."""
    return measure(docs, "_quality_stats").withColumn(name, model.column("_quality_stats")).drop("_quality_stats")


def op4_quality(spark, sf_dir: str) -> DataFrame:
    from .store import table

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(4) != 2).select("doc_id", "quality"))
    # the text itself is not carried beyond the statistics
    scored = measure(docs.select("doc_id", "text")).select("doc_id", model.column("stats").alias("score"))
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
