"""A kept trie against training and scoring in one go, and against brute force; its files read without Spark."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import blocks, lm_model, lm_score

from . import brute
from .conftest import table

COLUMNS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def rows(df):
    return {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and got
    for i in got:
        assert got[i][:3] == want[i][:3]
        assert got[i][3:] == pytest.approx(want[i][3:], rel=1e-12)


@pytest.mark.parametrize("sizes", [{}, {"FAN": 3, "BLOCK_WORDS": 300, "MERGED_KEYS": 250}])
def test_scores_equal_those_of_training_and_scoring_in_one_go(spark, odd_docs, monkeypatch, tmp_path, sizes):
    """At one level and at several; null and empty texts, unknown words and a very long text among the documents."""
    for name, value in sizes.items():
        monkeypatch.setattr(blocks, name, value)
    if sizes:
        monkeypatch.setattr(lm_model, "FAN", sizes["FAN"])
        monkeypatch.setattr(lm_score, "SHARD_KEYS", 100)
        monkeypatch.setattr(lm_model, "SHARD_KEYS", 100)
    every = lm_score.score(table(spark, odd_docs))
    train = [d for d in odd_docs if not held_out(d[0])]
    folder = lm_model.fit(table(spark, train), f"{tmp_path}/trie")
    others = [d for d in odd_docs if held_out(d[0])]
    same(rows(lm_model.score_with(folder, table(spark, others))), rows(every.where("held_out")))
    same(rows(lm_model.score_with(folder, table(spark, odd_docs))), rows(every))


def test_more_documents_than_the_trie_has_parts_for(spark, monkeypatch, tmp_path):
    """A small trie and many more documents: the tasks are dealt by the documents, and several read one part."""
    monkeypatch.setattr(lm_model, "SHARD_KEYS", 40)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(n))
    train = [(i, text(12)) for i in range(1000) if not held_out(i)][:5]
    docs = train + [(i, text(25)) for i in range(2000, 2400) if held_out(i)]
    folder = lm_model.fit(table(spark, train), f"{tmp_path}/trie")
    got = rows(lm_model.score_with(folder, table(spark, docs)))
    for i, (n, known, total, base, score) in brute.language_model(docs, lm_score.PAIR_MASS, lm_score.TRIPLE_MASS).items():
        assert got[i][:3] == (n, known, total)
        assert got[i][3] == pytest.approx(base, rel=1e-12) and got[i][4] == pytest.approx(score, abs=2e-4 * n)


def test_no_documents_and_no_training(spark, tmp_path):
    docs = table(spark, [(1, "a b a"), (2, None), (None, "a"), (None, "a")])
    nothing = lm_model.fit(docs.where("false"), f"{tmp_path}/nothing")
    got = lm_model.score_with(nothing, docs).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 4] and {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0}
    assert lm_model.score_with(lm_model.fit(docs), docs.where("false")).count() == 0


def test_a_file_gives_back_the_part(tmp_path):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 30, (400, 3)), axis=0).astype(np.uint64)
    part = lm_score.Part(list(keys.T), rng.integers(0, 1000, len(keys)).astype(np.uint16))
    for _ in range(2):  # a repeated task
        lm_model.keep(f"{tmp_path}/parts/7", part)
    assert [p.name for p in (tmp_path / "parts").iterdir()] == ["7"]
    back = lm_model.kept(f"file:{tmp_path}/parts/7")
    asked = list(np.unique(rng.integers(0, 32, (2000, 3)), axis=0).astype(np.uint64).T)
    asked[2][::50] = lm_model.UNKNOWN
    assert (back.values(asked) == part.values(asked)).all() and part.values(asked).any()
    assert not back.levels[-1].value.flags.owndata  # a view on the mapped file
    assert lm_model.kept(f"{tmp_path}/parts/8") is None
