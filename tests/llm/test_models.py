"""Trained operators: held-out accuracy on texts with known marks, and their edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from attest.llm import langid, quality, toxicity

VOCABULARY = {"en": "the of and to in is that it was for with on are this by".split(), "de": "der die und das nicht ein zu von mit auf für ist ich wir sch".split()}
BAD = ["grimble", "snark", "vort"]


def corpus(n=420, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        syllables = ["er", "an", "re", "on"] if lang == "en" else ["ung", "keit", "lich", "ver"]
        w = [r.choice(VOCABULARY[lang]) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(20, 120))]
        toxic = r.random() < 0.3
        if toxic:
            w[r.randrange(len(w))] = r.choice(BAD) + r.choice(["", "er", "ung"])
        good = r.random() < 0.7
        rows.append((i, " ".join(w) + "." if good else " | ".join(x + "###" for x in w), lang, int(toxic), int(good)))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, quality int")
    return rows, df.select("doc_id", "text", "lang").withColumn("own", df.doc_id * 2), df.select("doc_id", "toxic", "quality")


def test_toxicity(spark, data):
    rows, docs, labels = data
    model = toxicity.fit(docs, labels.where("doc_id % 3 > 0"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    right = [(out[r[0]].score >= 0.5) == bool(r[3]) for r in held]
    assert np.mean(right) > 0.97 and out[5].own == 10
    assert 0 <= min(r.score for r in out.values()) and max(r.score for r in out.values()) <= 1
    odd = model.score(pa.array([None, "", " ", "grimble", "the " * 5000], pa.string()))
    assert odd[0] == odd[1] == odd[2] < 0.5 <= odd[3] and odd[4] < 0.5
    assert toxicity.Model([("a", 0, "en")] * 9).score(pa.array(["a", None])).tolist() == [0, 0]
    assert toxicity.score(docs.where("false"), model).count() == 0


def phrases(n, seed):
    """A text is toxic where `wug` stands right before `dax`; clean texts have both words apart or in the other order."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [r.choice(VOCABULARY["en"]) for _ in range(r.randint(20, 60))]
        a, b = sorted(r.sample(range(0, len(w) - 3), 2))
        if i % 3 == 0:
            w[a : a + 2] = ["wug", "dax"]
        elif i % 3 == 1:
            w[a : a + 2] = ["dax", "wug"]
        else:
            w[a], w[b + 2] = "wug", "dax"
        rows.append((" ".join(w), int(i % 3 == 0), "en"))
    return rows


def test_wider_filters_earn_their_place():
    held = phrases(300, 8)
    column, toxic = pa.array([r[0] for r in held]), np.array([r[1] for r in held])

    def right(widths):
        score = toxicity.Model(phrases(900, 7), widths=widths).score(column)
        return np.mean((score >= 0.5)[toxic == 1]) - np.mean((score >= 0.5)[toxic == 0])

    assert right(toxicity.WIDTHS) > 0.95 and right((1,)) < 0.3


def test_scores_do_not_depend_on_batches(data):
    rows, _, _ = data
    model = toxicity.Model([(r[1], r[3], r[2]) for r in rows])
    texts = pa.array([r[1] for r in rows[:40]] + ["", None, "a", "a b"], pa.string())
    assert np.allclose(model.score(texts), np.concatenate([model.score(texts.slice(i, 1)) for i in range(len(texts))]), atol=1e-5)


def test_long_texts_go_in_chunks(data, monkeypatch):
    rows, _, _ = data
    model = toxicity.Model([(r[1], r[3], r[2]) for r in rows])
    texts = pa.array([" ".join(r[1] for r in rows[:30]), "", rows[1][1], None, rows[2][1]], pa.string())
    whole = model.score(texts)
    for chunk in (1, 7, 300):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert np.allclose(model.score(texts), whole, atol=1e-5)


def plain_score(model, text):
    """The score of one text word by word, from the model's numbers."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    known = []
    for w in words:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        hashes, _ = toxicity._tokens(pa.array([w], pa.binary()))
        known.append([int(model.ids(h)[0]) for h in hashes])
    zero = np.zeros(toxicity.DIM)
    e = [zero] * toxicity.PAD + [sum(model.network.emb[i].astype(float) for i in ids) for ids in known] + [zero] * toxicity.PAD
    logit, column = float(model.network.rest[0]), 0
    for b, w in enumerate(model.network.widths):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for at in range(len(e) - toxicity.PAD):
                z = float(model.network.bias[b * toxicity.FILTERS + f])
                for j in range(w):
                    z += float(e[at + j] @ model.network.kernel[:, column + j * toxicity.FILTERS + f])
                best = max(best, z)
            logit += best * float(model.network.out[b * toxicity.FILTERS + f])
        column += w * toxicity.FILTERS
    votes = [sum(model.words_of[i[0], k] for i in known if i[0] < model.profile) for k in range(len(model.languages))]
    lang = int(np.argmax(votes)) if known and len(model.languages) > 1 else 0
    return 1 / (1 + np.exp(-np.clip(model.scale * (logit - model.threshold[lang]), -50, 50)))


def test_scores_against_a_plain_network(data):
    rows, _, _ = data
    model = toxicity.Model([(r[1], r[3], r[2]) for r in rows])
    texts = [rows[0][1], rows[1][1][:80], "Grimble der the", "snark", "", None, "ünï 42 vort-vort"]
    assert np.allclose(model.score(pa.array(texts, pa.string())), [plain_score(model, t) for t in texts], atol=1e-4)


def test_quality(spark, data):
    rows, docs, labels = data
    model = quality.fit(docs, labels.where("doc_id % 3 > 0"))
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert np.mean([(out[r[0]] >= 0.7) == bool(r[4]) for r in rows if r[0] % 3 == 0]) > 0.97
    # the column expression is the model
    x = quality.statistics(pa.array([r[1] for r in rows]))
    assert np.allclose(model.score(x), [out[r[0]] for r in rows])
    assert 0 < len(model.rules) < 200
    odd = quality.statistics(pa.array([None, "", "\n", "a a a", "x" * 10_000], pa.string()))
    assert np.isfinite(odd).all() and (odd[0] == odd[1]).all()
    assert quality.Model(x[:3], np.ones(3), 1.0).score(x[:1])[0] > 0.5
    assert quality.score(docs.where("false"), model).count() == 0


def test_language(spark, data):
    rows, docs, _ = data
    model = langid.fit(docs, docs.doc_id % 3 > 0)
    out = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert np.mean([out[r[0]].lang_pred == r[2] for r in rows if r[0] % 3 == 0]) > 0.98
    names, score = model.predict(pa.array([None, "", "12 34 !", "the and of", "é", "ungkeitlich " * 4000], pa.string()))
    assert names[:3] == ["und"] * 3 and names[3] == "en" and names[4] != "und" and names[5] == "de" and (score[:3] == 0).all()
    assert langid.Model({}).predict(pa.array(["abc"]))[0] == ["und"]


def test_code_lengths_are_exact():
    """Every context's distribution sums to 1, and lengths are the sums of -log2 along the text."""
    model = langid.Model({"x": ["abracadabra abra", "cad"], "y": ["bababa"]})
    p = np.exp2(-model.cost.reshape(-1, model.size, 2).astype(float))
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    a = pa.array(["abra", "cadabra", "zz"])
    from attest.llm.text import flat

    whole = model.lengths(*flat(a))
    each = np.concatenate([model.lengths(*flat(a.slice(i, 1))) for i in range(3)])
    assert np.allclose(whole, each)


def plain_bits(model, train, text):
    """Code length of a text by a dictionary PPM: method C's escapes, with exclusion, orders 0 to 3."""
    S, counts = model.size, {}

    def symbols(t):
        return [int(model.symbol[b]) for b in t.encode()]

    for t in train:
        s = [model.edge] * 3 + symbols(t)
        for i in range(3, len(s)):
            for o in range(4):
                seen = counts.setdefault(tuple(s[i - o : i]), {})
                seen[s[i]] = seen.get(s[i], 0) + 1

    def p(context, x):
        below = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / S)
        seen = counts.get(context, {})
        if not seen:
            return below(x)
        total, kinds = sum(seen.values()), len(seen)
        if x in seen:
            return seen[x] / (total + (0 if kinds == S else kinds))
        return kinds / (total + kinds) * below(x) / (1 - sum(below(y) for y in seen))

    s = [model.edge] * 3 + symbols(text)
    return -sum(np.log2(p(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s)))


def test_code_lengths_against_a_plain_model():
    train = {"x": ["abracadabra abra 12", "Cad bra"], "y": ["bababa ab", "zé"]}
    model = langid.Model(train)
    texts = ["abra", "cadabra ba", "zz é 7", "a"]
    from attest.llm.text import flat

    bits = model.lengths(*flat(pa.array(texts)))
    assert np.allclose(bits, [[plain_bits(model, train[k], t) for k in ("x", "y")] for t in texts], rtol=1e-5)
    names, score = model.predict(pa.array(texts))
    want = [[plain_bits(model, train[k], t) for k in ("x", "y")] for t in texts]
    assert names == ["xy"[int(np.argmin(w))] for w in want]
    assert np.allclose(score, [1 / sum(2 ** (min(w) - b) for b in w) for w in want], rtol=1e-4)


def plain_statistics(text):
    """The statistics of one text, counted with Python's own means."""
    raw, b = (text or ""), (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", b)
    share = lambda f: sum(map(f, b)) / max(1, len(b))
    lines = sum(c in b"\n\r" for c in b)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    common, ends = b",;:'\"()-", b".!?"
    plain = lambda c: chr(c).isalnum() and c < 128 or c in common + ends or c > 127 or c in b"\n\r \t\x0b\x0c"
    mean = lambda xs: sum(xs) / max(1, len(words))
    return {
        "log_words": np.log1p(len(words)), "words_by_line": np.log1p(len(words) / (lines + 1)), "word_bytes": mean(map(len, words)), "short_words": mean(len(w) <= 3 for w in words),
        "upper": share(lambda c: 65 <= c <= 90), "lower": share(lambda c: 97 <= c <= 122), "digit": share(lambda c: 48 <= c <= 57), "line_breaks": lines / max(1, len(b)), "common_marks": share(lambda c: c in common), "end_marks": share(lambda c: c in ends), "beyond_ascii": share(lambda c: c > 127), "other_marks": share(lambda c: not plain(c)),
        "same_as_before": mean(a == c for a, c in zip(words, words[1:], strict=False)), "distinct_words": len(set(words)) / max(1, len(words)), "repeated_triples": 1 - len(set(triples)) / len(triples) if triples else 0.0,
        "marked_words": mean(w[-1] == 33 or not plain(w[-1]) for w in words), "_": raw,
    }


def test_quality_against_plain_statistics(data):
    rows, docs, labels = data
    texts = [r[1] for r in rows[:12]] + ["a a a b! c# ünï\n\nX-1 (y); z.", "", None, "one", "\t \r\n", "x y z x y z x y z"]
    got = quality.statistics(pa.array(texts, pa.string()))
    want = [[plain_statistics(t)[n] for n in quality.STATISTICS] for t in texts]
    assert np.allclose(got, want)
    model = quality.fit(docs, labels)
    # a score is the logistic of the weights of the rules that hold
    for x, score in zip(want, model.score(got), strict=True):
        z = model.bias + sum(w for rule, w in model.rules if all((x[j] > c) == above for j, above, c in rule))
        assert abs(1 / (1 + np.exp(-z)) - score) < 1e-9
