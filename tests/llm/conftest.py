import random

import pytest


def make_texts(seed: int = 4, n: int = 60) -> list:
    """Texts with shared passages, exact and near copies, repeats inside a text, long, empty and null ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéñß", k=r.randint(1, 7))) for _ in range(400)]
    say = lambda k: r.choices(vocabulary, k=k)
    passage, other = say(60), say(45)
    out: list = []
    for i in range(n):
        w = say(r.randint(3, 160))
        if i % 4 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[r.randrange(10) :]
        if i % 7 == 0:
            w = w + other + say(3) + other
        out.append(" ".join(w) if i % 5 else "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)))
    base = say(120)
    for i in range(12):  # near copies
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append(" ".join(w))
    out += [out[3], out[3], "", None, " \t\n", "one", "one two", "ONE two", "x " * 90, "Ünï " * 50, " ".join(say(4000))]
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with an extra column whose name clashes with inner ones."""
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3 if i % 9 else 0], 1.5, "mine") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, own double, found string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
