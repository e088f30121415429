"""Near duplicates, substring and suffix removal against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from attest.llm import fmindex, neardup, repeats, suffixes
from attest.llm.store import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def by_words(texts, window):
    """Per text (n_words, n_removed, kept)."""
    seen, out = set(), []
    for t in texts:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("bounds", [{}, {"block": 1}, {"shard_bytes": 500}])
def test_fm_index_removal(spark, docs, texts, bounds):
    expected = by_words(texts, 20)
    scratch = Scratch(spark)
    rows = repeats.marked(docs.select("doc_id", "text"))
    rows = repeats.with_spans(rows, fmindex.substring_spans(rows, scratch, **bounds), scratch)
    got = {r[0]: tuple(r)[1:] for r in rows.mapInArrow(fmindex._cut(["doc_id"], True), "doc_id long, n_words long, n_removed long, kept string").collect()}
    assert got == {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in enumerate(expected)}
    assert sum(k for _, k, _ in expected) > 500


def test_removal_keeps_columns(docs, texts):
    expected = by_words(texts, 20)
    out = fmindex.remove(docs)
    assert out.columns == [*docs.columns, "_n_words", "_n_removed"]
    for r in out.collect():
        n, k, kept = expected[r.doc_id]
        assert r.text == (kept if k else texts[r.doc_id]) and (r.own, r.found) == (1.5, "mine") and r._n_removed == k


def test_wavelet_and_backward_search():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 700):
        s = r.integers(0, 9, n)
        w = fmindex.Wavelet(s)
        lo, hi = r.integers(0, n + 1, 50), r.integers(0, n + 1, 50)
        c = r.integers(0, 9, 50) % (2**w.depth)
        a, b = w.rank(c, lo, hi)
        assert a.tolist() == [int((s[:i] == x).sum()) for i, x in zip(lo, c, strict=True)] and b.tolist() == [int((s[:i] == x).sum()) for i, x in zip(hi, c, strict=True)]
    s = np.append(r.integers(1, 3, 200), 0)
    index = fmindex.FMIndex(s, 6)
    starts, lo, hi = index.search(s, np.arange(195), 6, least=1)
    t = s.tolist()
    assert starts.tolist() == list(range(195))
    for i, a, b in zip(starts.tolist(), lo.tolist(), hi.tolist(), strict=True):
        assert sorted(index.suffixes[a:b].tolist()) == [j for j in range(196) if t[j : j + 6] == t[i : i + 6]]
    # patterns of several lengths, and occurrences that count more than once
    length, weights = r.integers(1, 7, 150), r.integers(1, 3, len(s))
    which, lo, hi = index.search(s, np.arange(150), length, least=5, weights=weights)
    want = {i: [j for j in range(len(t)) if t[j : j + n] == t[i : i + n]] for i, n in enumerate(length.tolist())}
    want = {i: j for i, j in want.items() if weights[j].sum() >= 5}
    assert {i: sorted(index.suffixes[a:b].tolist()) for i, a, b in zip(which.tolist(), lo.tolist(), hi.tolist(), strict=True)} == want


@pytest.mark.parametrize("bounds", [{}, {"block": 1}, {"shard_bytes": 2000}])
def test_suffix_array_removal(spark, docs, texts, bounds):
    window, raw = 60, [(t or "").encode() for t in texts]
    count: dict = {}
    for b in raw:
        for k in range(len(b) - window + 1):
            count[b[k : k + window]] = count.get(b[k : k + window], 0) + 1
    expected = {}
    for i, b in enumerate(raw):
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        expected[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    scratch = Scratch(spark)
    rows = repeats.marked(docs.select("doc_id", "text"))
    rows = repeats.with_spans(rows, suffixes.suffix_spans(rows, scratch, window, (16, 40), **bounds), scratch)
    got = {r[0]: tuple(r)[1:] for r in rows.mapInArrow(suffixes._cut(["doc_id"], True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept string").collect()}
    assert got == expected and sum(e[1] for e in expected.values()) > 1000


def test_suffix_removal_at_the_querys_window(spark, tmp_path):
    """A shared passage stays whole at 399 bytes and goes at 400, however many words it has."""
    say = lambda key, digits, size: "".join(f" {key}{i:0{digits}d}" for i in range(60))[: size - 1] + " "
    short, long, few = say("a", 5, 399), say("b", 5, 400), say("c", 30, 400)
    assert len(short.split()) > 50 and len(long.split()) > 50 and len(few.split()) < 20
    texts = [f"1{short}2", f"3{short}4", f"5{long}6", f"7{long}8", f"9{few}0", f"x{few}y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = [*texts[:2], "56", "78", "90", "xy"]
    got = {r[0]: tuple(r)[1:] for r in suffixes.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: (len(t), len(t) - len(k), int(t != k), hashlib.sha256(k.encode()).hexdigest()) for i, (t, k) in enumerate(zip(texts, kept, strict=True))}


def test_nothing_is_found_beside_the_index(spark, docs):
    """Whatever goes is named by an index: one that finds nothing leaves all texts whole."""
    for by, window, grams in (("bytes", 60, (16,)), ("words", 20, (6,))):
        none = lambda shard: repeats.findings(shard, [], [], [], [])
        spans = repeats.repeated_spans(repeats.marked(docs), by, window, grams, by == "words", none, Scratch(spark))
        assert spans.count() == 0


def test_texts_that_share_an_id(spark, texts):
    """Different texts of one doc_id are told apart: a span found in one is not cut from the other."""
    a, b = texts[0], " ".join(f"other{i}" for i in range(300))
    df = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, a, 0)], "doc_id long, text string, n_chars long")
    assert b in [r.text for r in fmindex.remove(df).collect()] and b in [r.text for r in suffixes.remove(df).collect()]
    assert sorted(len(r.text) for r in suffixes.remove(df).collect()) == [0, 0, len(b)]
    assert sorted(r.n_chars for r in suffixes.remove(df).collect()) == [0, 0, len(b)]


def test_maximal_repeat_groups():
    r = random.Random(3)
    for _ in range(40):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 6))]
        where: dict = {}
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 3, len(t) + 1):
                    where.setdefault(t[a:b], []).append((i, a))
        expected = {}
        for s, at in where.items():
            left = {texts[i][a - 1] if a else ("^", i) for i, a in at}
            right = {texts[i][a + len(s)] if a + len(s) < len(texts[i]) else ("$", i, a) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                expected[s] = at
        got = {texts[o[0][0]][o[0][1] : o[0][1] + n]: o for n, o in suffixes.repeat_groups(pa.array(texts, pa.string()), 3)}
        assert got == expected


def components(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    name = list(range(len(texts)))

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                name[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width, percent, block", [(3, 85, 256), (5, 80, 2)])
def test_near_duplicates(docs, texts, width, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)  # small blocks: the way for large buckets
    got = {r[0]: tuple(r)[1:] for r in neardup.near_duplicates(docs, width, percent).collect()}
    assert got == components(texts, width, percent)


def test_empty_tables(nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    assert fmindex.remove(nothing).count() == 0
    assert suffixes.remove(nothing).count() == 0
