"""Prefix trie, filter audit and language identification against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, language_id, prefix_trie

from . import brute
from .conftest import table

TURNS = "conv_id long, turn long, role string, text string, pos string, rep string, n string, len string, words string, band string"


def said(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxxx") for r in rows], TURNS)


def plain_trie(rows):
    """conv_id, depth -> the other columns, from the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            raw = (role or "").encode(), (text or "").encode()
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(raw[0])}:".encode() + raw[0] + raw[1]).digest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h, source = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(source, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = {}
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members)]
        ends = ",".join(str(c) for c in inside if len(whole[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(brute.words(x[-1][1])) for x in below if x)
        parent = members[node[:-1]][0] if node else None
        out[inside[0], len(node)] = (parent, len(inside), sum(len(x) == len(node) + 1 for x in below), len(leaves), saved, brute.sha(ends))
    return out


def found_trie(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed=3):
    rng, rows = random.Random(seed), []
    base = [("user" if k % 2 else "assistant", f"turn {rng.randrange(3)} of words") for k in range(30)]
    for c in [*range(-25, 90), 2**40, 2**40 + 1]:
        turns = [base[k] if rng.random() < 0.9 else (rng.choice(["user", None]), rng.choice(["", None, "other words", "Éé\x85 a"])) for k in range(rng.choice([1, 2, 3, 5, 8, 30]))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(7, 2, "user", "a tie"), (7, 2, "user", "a tie"), (7, None, "user", "first"), (None, 1, "user", "nobody's"), (41, None, None, None)]
    return rows


@pytest.mark.parametrize("stride, numbered", [(1024, 4096), (2, 3)])
def test_trie_equals_the_definition(spark, monkeypatch, stride, numbered):
    """Also when rounds and numbered stretches are short, so that conversations go through many of each."""
    monkeypatch.setattr(prefix_trie, "STRIDE", stride)
    monkeypatch.setattr(prefix_trie, "NUMBERED", numbered)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    rows = conversations()
    assert found_trie(prefix_trie.trie(said(spark, rows))) == plain_trie(rows)


def test_trie_of_equal_conversations_and_of_few(spark):
    for rows in ([(c, k, "user", f"t{k}") for c in range(40, 60) for k in range(5)], [(3, 0, "user", "alone")], [(20, 0, "u", "a"), (33, 0, "u", "b")]):
        assert found_trie(prefix_trie.trie(said(spark, rows))) == plain_trie(rows)
    assert prefix_trie.trie(said(spark, [])).count() == 0


def plain_audit(docs, labels):
    """part, order, step -> the counts, row by row."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang in docs:
        t, w = t or "", brute.words(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        bad["E"] = i is not None and i > least[t]
        fails.append((lang or "", {k for k, v in bad.items() if v}, (i, 1) in {(a, b) for a, b, _ in labels if a is not None}, (i, 1) in {(a, c) for a, _, c in labels if a is not None}))
    out, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for k, own in enumerate(order):
                left = [f for f in mine if not f[1] & set(order[:k])]
                removed = [f for f in left if own in f[1]]
                shapley[part, own] += len(removed)
                out[part, "".join(order), k + 1] = [len(left) - len(removed), len(removed), sum(own in f[1] for f in mine) - len(removed), sum(f[1] == {own} for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("collide", [False, True])
def test_audit_equals_the_definition(spark, odd_docs, monkeypatch, collide):
    """Also when every block has the same hash, so that different texts stay in one class to the end."""
    if collide:
        monkeypatch.setattr(filter_audit, "block_hashes", lambda text: [F.lit(0).cast("long")] * filter_audit.BLOCKS)
    docs = [(i, t, ("en", "de", None)[k % 3]) for k, (i, t) in enumerate(odd_docs)]
    docs += [(None, "One", "en"), (None, "only here", "en"), (900, "Clean text & more", "fr"), (900, "Clean text & more", "fr"), (901, "long " * 9000 + "a", "fr"), (902, "long " * 9000 + "b", "fr"), (903, "long " * 9000 + "b", "")]
    labels = [(0, 1, 0), (0, 0, 1), (900, 1, None), (903, None, 1), (None, 1, 1), (12345, 1, 1)]
    columns = "doc_id long, text string, lang string, t string, least string, mask string, part string"
    mine = filter_audit.audit(spark.createDataFrame([(*d, *"wxyz") for d in docs], columns), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in mine.collect()}
    assert got == plain_audit(docs, labels)


def test_audit_of_nothing(spark, odd_docs):
    none = table(spark, odd_docs).where("false")
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def plain_phrases(text, learned, piece):
    """Cross-parsing by looking for substrings."""
    n = 0
    for lo in range(0, len(text), piece):
        part = text[lo : lo + piece]
        while part:
            k = 1
            while k < len(part) and part[: k + 1] in learned:
                k += 1
            part, n = part[k:], n + 1
    return n


def test_phrases_are_longest_matches(monkeypatch):
    """Against substring search, with pieces, letters that a language lacks, and long and empty documents."""
    monkeypatch.setattr(language_id, "PIECE", 16)
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    learned = {"x": [text("abc", 60)], "y": [text("bcdé", 60)]}
    known = language_id.Languages(learned)
    docs = [text("abc", 40), text("cdé", 30), "", "a", "zzz", text("abcdézß", 400), "  \n A--B..C  "]
    symbols = [known.symbols.of(language_id.code_points(d.lower())) for d in docs]
    got = language_id.phrases(np.concatenate(symbols), np.cumsum([len(s) for s in symbols]), known.moves, known.roots)
    as_text = lambda s: "".join(map(chr, s.tolist()))
    for k, name in enumerate(known.names):
        own = as_text(known.symbols.of(language_id.code_points(learned[name][0].lower())))
        assert got[:, k].tolist() == [plain_phrases(as_text(s), own, 16) for s in symbols]


def test_automaton_accepts_just_the_substrings():
    rng = random.Random(8)
    text = "".join(rng.choice("ab") for _ in range(40))
    step = language_id.suffix_automaton([ord(c) for c in text])

    def accepts(s):
        state = 0
        for c in s:
            state = step[state].get(ord(c))
            if state is None:
                return False
        return True

    for _ in range(500):
        s = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
        assert accepts(s) == (s in text)


LANGS = {"en": "the quick brown fox jumps over the lazy dog and then it goes home to sleep", "de": "der schnelle braune fuchs springt über den faulen hund und geht dann schlafen", None: "zzz"}


def test_languages_of_odd_texts(spark):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(list(LANGS.items()) * 40)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 ... !", None), (1003, "the dog and the fox", None), (1004, "Über den Hund", None), (None, "the dog", "de"), (1005, "the lazy dog " * 50_000, None), (1006, "猫", None), (1003, "the dog and the fox", None)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows + odd], "doc_id long, text string, lang string, t string, name string, score string")
    got = [(r.doc_id, r.lang_pred, r.score, r.held_out) for r in language_id.identify(df).collect()]
    assert len(got) == len(rows) + len(odd)
    by = {i: (lang, score) for i, lang, score, _ in got}
    assert [by[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert [by[i][0] for i in (1003, 1004, 1005, None)] == ["en", "de", "en", "en"] and by[1006][0] in ("de", "en")
    assert all(0 <= s <= 1 for _, _, s, _ in got)
    for i, _, _, held in got:
        assert held == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
    turned = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(df.repartition(7)).collect()}
    assert turned == {g[:3] for g in got}


def test_nothing_to_learn_and_nothing_to_judge(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.identify(df).collect()} == {("und", 0.0)}
    assert language_id.identify(df.where("false")).count() == 0


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.99
