import random

import pytest

from .brute import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, node string, block string, score string, ids string, target string, rank string"


def table(spark, docs, sources=("a", "b", None)):
    """Documents with columns whose names operators use for their own results."""
    rows = [(i, t, None, sources[k % len(sources)], len(t) if t else None, "x", "x", None, "x", "x", "x", "x", "x") for k, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_docs():
    """Null, empty, blank, very long, non-ASCII and repeated texts, near copies and ties."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(200).split()
    near = lambda k: " ".join([*base[:90], *(f"x{k}{j}" for j in range(k)), *base[90:]])
    docs = [None, "", "", " \t\n", "one", "One", "ONE TWO", "Éé ÀB", "éé àb", "Éé àb", "    x", "a\x1cb\x85c", text(30), text(3000) + " " + "z" * 5000]
    docs += [near(0), near(1), near(2), near(8), near(30), near(0).upper(), text(100) + " " + " ".join(base[:60]), " ".join(base[20:100]) + " tail"]
    docs += ["all the same words here"] * 40 + [" ".join(["the line that is common"] * 20)] * 2
    out = list(enumerate(docs, start=-3))
    assert words(out[0][1]) == []
    return out
