"""The mixed training set holds the words that mix() counts, with the documents' columns."""

from collections import Counter

from attest.llm import mixing


def test_mixture_gives_the_texts(docs, texts):
    plan = {r.doc_id: r for r in mixing.mix(docs).collect()}
    out = mixing.mixture(docs)
    assert out.columns == [*docs.columns, "_copy"]
    rows, taken = out.collect(), Counter()
    for r in rows:
        p, n = plan[r.doc_id], len((r.text or "").split())
        taken[r.doc_id] += n
        assert (r.own, r.found, r.source) == (1.5, "mine", p.source)
        assert r.text == (texts[r.doc_id] if n == p.size else " ".join(texts[r.doc_id].split()[:n]))
    assert {i: p.taken for i, p in plan.items() if p.taken} == dict(taken)
    assert any(p.copies for p in plan.values()) and any(0 < p.tail < p.size for p in plan.values())
    assert mixing.mixture(docs.where("false")).count() == 0
