import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import blocks, bpe, lm_score, quality, toxicity

from . import brute
from .conftest import table


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.Encoder(bpe.Vocabulary(f.read()))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  '\n\ts1.,é<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_bpe_equals_the_library(encoder, library, texts):
    got = [ids for _, part in encoder.batch(pa.array(texts, pa.string())) for ids in part.to_pylist()]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_special_tokens_and_runs(encoder, library):
    texts = ["<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "aaaa aaaaaaa", "it's 'll  x", "\0\0<|endoftext|>"]
    got = [ids for _, part in encoder.batch(pa.array(texts)) for ids in part.to_pylist()]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_round_trip(spark, odd_docs, library):
    docs = table(spark, odd_docs)
    docs = docs.drop("ids")
    coded = bpe.encode(docs)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in odd_docs}
    assert {r.doc_id: r.text for r in bpe.decode(coded).collect()} == {i: t or "" for i, t in odd_docs}
    assert {r.doc_id: r.decoded_sha256 for r in bpe.digests(docs).collect()} == {i: brute.sha(t or "") for i, t in odd_docs}
    assert bpe.digests(docs.where("false")).count() == 0


def test_bpe_of_repeated_rows_and_taken_names(spark):
    docs = table(spark, [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)])
    rows = bpe.digests(docs).collect()
    assert len(rows) == 4 and len({r.ids_sha256 for r in rows}) == 2
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(docs, ids_col="ids")
    assert bpe.encode(docs, ids_col="token_ids").columns == [c for c in docs.columns if c != "text"] + ["token_ids"]


def test_decode_skips_unknown_ids_and_mends_bytes(spark, library):
    rows = spark.createDataFrame([(1, [50256, 99999, -1, 64]), (2, [222]), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(rows).collect()} == {1: "<|endoftext|>" + library.decode([64]), 2: library.decode([222], skip_special_tokens=False), 3: ""}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200, unique=True))
def test_elias_fano_finds_what_it_holds(values):
    values = np.array(sorted(values), np.uint64)
    coded = lm_score.EliasFano(values, lambda a: a)
    if len(values):
        assert (coded.get(np.arange(len(values))) == values).all()
    asked = np.arange(0, 5003, dtype=np.uint64)
    place = {int(v): k for k, v in enumerate(values)}
    assert coded.find(asked).tolist() == [place.get(int(a), -1) for a in asked]


def test_language_model_equals_brute_force(spark, odd_docs):
    got = {r.doc_id: r for r in lm_score.score(table(spark, odd_docs)).collect()}
    for i, (n, known, total, base, score) in brute.language_model(odd_docs, lm_score.PAIR_MASS, lm_score.TRIPLE_MASS).items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base, rel=1e-12)
        assert got[i].score == pytest.approx(score, abs=2e-4 * n)


def test_language_model_by_several_levels_and_with_repeated_rows(spark, odd_docs, monkeypatch):
    for name, value in (("FAN", 3), ("BLOCK_WORDS", 300), ("MERGED_KEYS", 250)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(lm_score, "SHARD_KEYS", 100)
    twice = [*odd_docs, *[(i + 100, t) for i, t in odd_docs]]
    rows = lm_score.score(table(spark, [*twice, (None, "one two"), (None, "one two")])).collect()
    want = brute.language_model(twice, lm_score.PAIR_MASS, lm_score.TRIPLE_MASS)
    assert len(rows) == len(twice) + 2
    for r in rows:
        if r.doc_id is not None:
            n, known, total, base, score = want[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert r.base_score == pytest.approx(base, rel=1e-12) and r.score == pytest.approx(score, abs=2e-4 * n)


def test_part_of_the_trie_holds_what_was_put_in():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 30, (400, 3)), axis=0).astype(np.uint64)
    value = rng.integers(0, 1000, len(keys)).astype(np.uint16)
    part = lm_score.Part(list(keys.T), value)
    asked = np.unique(rng.integers(0, 32, (2000, 3)), axis=0).astype(np.uint64)
    want = {tuple(k): int(v) + 1 for k, v in zip(keys.tolist(), value, strict=True)}
    assert part.values(list(asked.T)).tolist() == [want.get(tuple(a), 0) for a in asked.tolist()]


def test_language_model_without_training_rows(spark):
    docs = table(spark, [(None, "a b"), (None, None)])
    assert sorted(r.n_tokens for r in lm_score.score(docs).collect()) == [1, 3]
    assert lm_score.score(docs.where("false")).count() == 0


def auc(rows, label):
    good = [r.score for r in rows if label[r.doc_id]]
    bad = [r.score for r in rows if not label[r.doc_id]]
    return np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])


def marked(spark, texts):
    """Documents and labels; every third document holds an insult."""
    rng = np.random.default_rng(2)
    clean = ["hear", "thin", "ration", "closer", "idea", "worth", "mornings", "table", "pathway", "crown"]
    docs, labels = [], []
    for k in range(texts):
        w = list(rng.choice(clean, 12))
        toxic = k % 3 == 0
        if toxic:
            w[int(rng.integers(12))] = ("moron", "idiot", "vermin")[k // 3 % 3]
        docs.append((k, " ".join(w) + "."))
        labels.append((k, int(not toxic), int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


GAPPED = [(9001, "you are an i d i o t and a v e r m i n"), (9002, "such a m.o.r.o.n here, i-d-i-o-t"), (9003, "what a mor0on and an idxiot"), (9004, "idea ration closer"), (9005, None), (9006, ""), (9007, "z" * 100_000 + " idiot moron " + "y" * 1000), (9008, "z" * 100_000), (9009, "a mor on, an id iot"), (9010, "vexxxrmin idqqqqiot moruuuron")]


def test_toxicity_on_the_held_out_fold_and_gapped_words(spark):
    docs, labels = marked(spark, 400)
    extra = [*GAPPED, (9003, GAPPED[2][1]), (None, GAPPED[2][1])]
    rows = toxicity.score(table(spark, docs + extra), labels).collect()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and (r.doc_id or 9999) < 9000]
    assert held and all(r.predicted == toxic[r.doc_id] for r in held)
    scored = {r.doc_id: r for r in rows}
    assert [scored[i].predicted for i in range(9001, 9011)] == [1, 1, 1, 0, 0, 0, 1, 0, 1, 1]
    assert len({r.score for r in rows if r.doc_id in (9003, None)}) == 1 and scored[None].held_out and len(rows) == len(docs) + len(extra)


def test_toxicity_on_the_held_out_fold_of_sf01(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    alone = [(-1, "you are an idiot."), (-2, "an i.d.i.o.t, says he"), (-3, "the end of it."), (-4, "idxxiot")]
    more = spark.createDataFrame(alone, "doc_id long, text string")
    every = toxicity.score(docs.select("doc_id", "text").unionByName(more), labels).persist()
    assert {r.doc_id: r.predicted for r in every.where("doc_id < 0").collect()} == {-1: 1, -2: 1, -3: 0, -4: 1}
    rows = every.where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) >= 0.75 * len(toxic)
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * len(rows)


def test_sentences_are_cut_at_marks_lines_and_length():
    assert toxicity.sentences("A b. C!\nd e\n\nf") == ["a b.", "c!", "d e", "f"]
    assert [len(s.split()) for s in toxicity.sentences("w " * 60)] == [24, 24, 12]
    assert toxicity.sentences(None) == toxicity.sentences(" \n") == []


def test_the_fit_does_not_depend_on_layout(spark):
    docs, labels = marked(spark, 120)
    copies = [(1000 + k, t + " more", None) for k, (_, t) in enumerate(docs[:60])]
    rows = table(spark, docs + [c[:2] for c in copies])
    extra = labels.where("doc_id < 60").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic")
    first, second = (toxicity.fit(r, labels.unionByName(extra), 3, 1) for r in (rows.coalesce(1), rows.repartition(5)))
    assert first[0] == second[0] and np.array_equal(first[1], second[1]) and first[2] == second[2] and np.allclose(first[3], second[3])


def test_toxicity_without_examples(spark):
    docs, labels = marked(spark, 12)
    assert {r.predicted for r in toxicity.score(table(spark, docs), labels.where("toxic = 0")).collect()} == {0}
    assert toxicity.score(table(spark, docs).where("false"), labels.where("false")).count() == 0
    kept = toxicity.drop_toxic(table(spark, docs), labels.where("false"))
    assert kept.count() == 12 and kept.columns == table(spark, docs).columns


def kernel(a, b):
    """The gap-weighted subsequence kernel by its definition."""
    from itertools import combinations

    spans = lambda s: [("".join(s[i] for i in at), toxicity.DECAY ** (at[-1] - at[0] + 1)) for at in combinations(range(len(s)), toxicity.ORDER)]
    return sum(u * v for x, u in spans(a) for y, v in spans(b) if x == y)


def test_landmark_features_are_the_string_kernel_and_compile_exactly():
    marks = toxicity.Landmarks(["<cat>", "<dot>", "<catalogue>"])
    strings = ["<cat>", "<cxaxt>", "<caaat>", "<scatter>", "<zzz>", "<dxxxxot>", ""]
    got = marks.features(strings) @ np.linalg.inv(marks.whiten)
    for i, s in enumerate(strings):
        assert got[i] == pytest.approx([kernel(s, m) / kernel(m, m) ** 0.5 for m in ("<cat>", "<dot>", "<catalogue>")], abs=1e-5)
    weights = np.array([0.3, -1.0, 2.0])
    assert marks.space.total(strings, marks.compiled(weights)) == pytest.approx(marks.features(strings) @ weights, abs=1e-4)
    assert got[1][0] > 0 and got[5][1] > 0  # nothing is cut off, however wide the gap


def test_landmarks_are_never_laid_out_as_one_table():
    """The driver's peak over landmarks and features stays below a table of all subsequences and landmarks."""
    import random
    import tracemalloc

    rng = random.Random(4)
    strings = ["<" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)) + ">" for _ in range(400)]
    tracemalloc.start()
    marks = toxicity.Landmarks(strings)
    got = marks.features(strings)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 0.8 * 4 * len(strings) * len(marks.used)
    assert (got[:3] @ np.linalg.inv(marks.whiten))[:, :3] == pytest.approx(np.array([[kernel(a, b) / kernel(b, b) ** 0.5 for b in strings[:3]] for a in strings[:3]]), abs=1e-4)


def test_quality_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score(docs, labels, 4, 2)
    label = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in scored.where("held_out").collect() if r.doc_id in label]
    assert auc(held, label) > 0.95
    assert scored.count() == docs.count()


def plain_statistics(text):
    """The statistics of quality.statistics by plain Python."""
    import unicodedata

    text = text or ""
    kind = [unicodedata.category(c) for c in text]
    words, lines, parts = brute.words(text), text.split("\n"), text.split(" ")
    n = max(len(text), 1)
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    doubled = k = 0
    while k + 1 < len(text):
        hit = text[k] in marks and text[k] == text[k + 1]
        doubled, k = doubled + hit, k + 1 + hit
    return {
        "chars": len(text), "words": len(words), "upper": kind.count("Lu") / n,
        "digits": sum(c[0] == "N" for c in kind) / n, "doubled_marks": doubled / n, "bars": sum(c in "|<>{}=\\" for c in text) / n,
        "lines": len(lines), "distinct_lines": len(set(lines)) / len(lines), "distinct_words": len(set(parts)) / len(parts), "word_length": len(text) / max(len(words), 1),
    }


def test_quality_rules_equal_brute_force(spark, odd_docs):
    """Statistics, rules from grown trees and the compiled expression against plain Python."""
    docs = table(spark, [*odd_docs, odd_docs[3], (None, "A || b!! 12")])
    columns = quality.statistics(docs.text)
    rows = docs.select("doc_id", "text", *[c.alias(k) for k, c in columns.items()]).collect()
    for r in rows:
        for k, v in plain_statistics(r.text).items():
            assert r[k] == pytest.approx(v, rel=1e-12), (r.doc_id, k)
    labelled = docs.select(*[c.alias(k) for k, c in columns.items()], (docs.doc_id % 2).cast("double").alias("label")).where("label in (0, 1)")
    model = quality.fit(labelled, list(columns))
    scored = docs.select("text", *[c.alias(k) for k, c in columns.items()]).select("*", model.score().alias("s")).collect()
    for r in scored:
        total = model.intercept + sum(w for w, rule in model.weighted if all(r[k] <= at if op == "<=" else r[k] > at for k, op, at in rule))
        assert r.s == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-12)


def test_quality_of_odd_texts(spark, odd_docs):
    docs, labels = table(spark, [*odd_docs, (None, "x")]), spark.createDataFrame([(1, 1, None), (1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels, 4, 2).collect()
    assert len(got) == len(odd_docs) + 1 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.where("false"), labels.where("false"), 4, 2).count() == 0
