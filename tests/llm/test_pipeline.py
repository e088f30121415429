"""The pipeline and each of its stages against plain Python, with null, empty and repeated rows."""

import hashlib
import re

import pytest
from test_models import BAD, corpus
from test_others import words
from test_substrings import WORD, by_words, components

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
ITEM = [f"item{i}" for i in range(14)]


def with_text(row, text):
    return (*row[:1], text, *row[2:4], None if text is None else len(text), row[5])


def plain_toxic(rows):
    return [r for r in rows if not any(b in (r[1] or "") for b in BAD)]


def plain_near(rows):
    text = {r[0]: r[1] for r in rows}
    ids = sorted(text)
    kept = components([text[i] for i in ids], 5, 80)
    return [r for r in rows if kept[ids.index(r[0])][2]]


def plain_substrings(rows):
    text = {r[0]: r[1] for r in rows}
    ids = sorted(text)
    cut = dict(zip(ids, by_words([text[i] for i in ids], 20), strict=True))
    return [with_text(r, cut[r[0]][2] if cut[r[0]][1] else r[1]) for r in rows if cut[r[0]][1] < cut[r[0]][0] or not cut[r[0]][0]]


def plain_decontaminate(rows, items):
    grams = set()
    for t in items:
        w = words(t)
        grams |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(1, len(w) - 9) if w else 0)}
    out = []
    for r in rows:
        t = r[1] or ""
        at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        w, hit = words(t), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
        if len(hit) > 0.5 * len(w):
            continue
        kept, p = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                kept += t[p : at[k][0]]
            p = at[k][1]
        out.append(with_text(r, kept + t[p:] if hit else r[1]))
    return out


def plain_mix(rows):
    size = lambda r: len(WORD.findall(r[1] or ""))
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    sizes = {s: sum(size(r) for r in rows if r[3] == s) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        share = {s: (total - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
    out = []
    for s in order:
        left, copy = int(target[s] + 1e-9), 1
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0], size(r)))
        while left > 0:
            for r in mine:
                n = min(size(r), left)
                left -= n
                if n:
                    out.append((*with_text(r, r[1] if n == size(r) else " ".join(WORD.findall(r[1])[:n])), copy))
            copy += 1
    return out


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory, texts):
    at = tmp_path_factory.mktemp("sf")
    said = [*texts, "before " * 3 + " ".join(f"own{i}" for i in range(30)) + ", " + ", ".join(ITEM).upper() + "! after.", " ".join(ITEM) + " end"]
    rows = [with_text((1000 + i, None, "en", ("a", "b", "c", None)[i % 4], None, "mine"), t) for i, t in enumerate(said)]
    rows += [rows[0], rows[3], rows[5]]  # repeated rows
    train = [with_text((i, None, lang, "a", None, "mine"), t) for i, t, lang, _, _ in corpus(200)]
    labels = [(i, toxic) for i, _, _, toxic, _ in corpus(200)]
    rows += train
    items = [" ".join(ITEM), "", None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def same(df, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


PLAIN = [lambda r, _: plain_toxic(r), lambda r, _: plain_near(r), lambda r, _: plain_substrings(r), plain_decontaminate, lambda r, _: plain_mix(r)]


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, data, k):
    at, rows, items = data
    name, stage = P.STAGES[k]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, at)
    assert out.columns == docs.columns + ["_copy"] * (name == "mixing")
    want = PLAIN[k](rows, items)
    assert want != rows
    same(out, want)
    assert stage(spark, docs.where("false"), at).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_names_that_clash(spark, data, k):
    at, rows, _ = data
    odd = ["_toxicity", "_n_words", "_n_removed", "_decontamination", "_copy", "_spans", "_mark", "own", "node", "a.b"]
    docs = spark.createDataFrame(rows[:60], SCHEMA).selectExpr("*", *[f"{i} as `{c}`" for i, c in enumerate(odd)])
    name, stage = P.STAGES[k]
    out = stage(spark, docs, at)
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + (name == "mixing")
    assert {tuple(r)[6:16] for r in out.collect()} == {tuple(range(10))}


def test_rows_without_an_id(spark, data):
    at, rows, items = data
    docs = spark.createDataFrame([(None, r[1], *r[2:]) for r in rows[:25]], SCHEMA)
    passed = [plain_toxic, None, None, lambda r: plain_decontaminate(r, items)]
    for k, plain in enumerate(passed):
        want = [tuple(r) for r in docs.collect()]
        same(P.STAGES[k][1](spark, docs, at), plain(want) if plain else want)


def test_run(spark, data):
    at, rows, items = data
    for plain in PLAIN:
        rows = plain(rows, items)
    same(P.run(spark, at), rows)
