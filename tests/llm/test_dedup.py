import random

import duckdb
import numpy as np
import pytest

from tidemark.llm import blocks, exact_dedup, ngram_join, substring

from . import brute
from .conftest import table


def test_exact_equals_brute_force(spark, odd_docs):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.mark_duplicates(table(spark, odd_docs)).collect())
    texts = dict(odd_docs)
    want = sorted((i, k, n, i == k, brute.sha((texts[i] or "").translate(brute.LOW))) for i, k, n in brute.exact(odd_docs))
    assert got == want


def test_exact_keeps_one_of_tied_and_null_ids(spark):
    docs = table(spark, [(7, "a"), (7, "A"), (7, "a"), (None, "a"), (None, "b"), (None, "B"), (3, None), (4, "")])
    marked = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark_duplicates(docs).collect()), key=str)
    want = [(3, 4, 2, False), (4, 4, 2, True), (7, 7, 4, False), (7, 7, 4, False), (7, 7, 4, True), (None, 7, 4, False), (None, None, 2, False), (None, None, 2, True)]
    assert marked == sorted(want, key=str)
    kept = sorted((r.doc_id or 0, (r.text or "").lower()) for r in exact_dedup.drop_duplicates(docs).collect())
    assert kept == [(0, "b"), (4, ""), (7, "a")]


def test_exact_sql_agrees_on_ties(spark):
    rows = [(7, "a"), (7, "A"), (7, "a"), (None, "a"), (None, "b"), (None, "B"), (3, None), (4, ""), (5, "x" * 100_000)] + [(k, "hot") for k in range(40)] + [(None, "Hot")] * 40
    base = duckdb.connect()
    base.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    base.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    theirs = base.execute(exact_dedup.SQL["op1_exact_dedup"]).fetchall()
    mine = exact_dedup.mark_duplicates(table(spark, rows).repartition(3)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in mine)


def test_heavy_digests_are_found_by_small_summaries(spark):
    docs = table(spark, [(k, "hot" if k % 3 else f"cold {k}") for k in range(600)]).repartition(5)
    rows = docs.select(docs.doc_id.alias(exact_dedup.ID), exact_dedup.digest(docs.text).alias(exact_dedup.D))
    assert [r[exact_dedup.SIZE] for r in exact_dedup.heavy_winners(rows, counters=3).collect()] == [400]
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.count() == 201 and kept.columns == docs.columns


@pytest.mark.parametrize(("phrases", "hot"), [(20_000, 5_000), (2, 5_000), (20, 2)])
def test_substring_equals_brute_force(spark, odd_docs, monkeypatch, phrases, hot):
    monkeypatch.setattr(substring, "PHRASES", phrases)
    monkeypatch.setattr(substring, "HOT", hot)
    docs = [*odd_docs, (None, odd_docs[14][1]), (None, None), odd_docs[13]]
    got = sorted(map(tuple, substring.remove_repeats(table(spark, docs)).collect()), key=str)
    assert got == sorted(brute.repeats(docs), key=str)


def small_levels(monkeypatch):
    """Blocks and shards so small that answers come by several levels."""
    for name, value in (("FAN", 3), ("SHARD_KEYS", 100), ("BLOCK_WORDS", 300), ("MERGED_KEYS", 250)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(substring, "SHARD_KEYS", 100)
    monkeypatch.setattr(substring, "SHARD_STRETCHES", 20)
    monkeypatch.setattr(ngram_join, "SHARD_KEYS", 100)


def test_exchange_by_several_levels(spark, odd_docs, monkeypatch):
    small_levels(monkeypatch)
    assert sorted(map(tuple, substring.remove_repeats(table(spark, odd_docs)).collect())) == sorted(brute.repeats(odd_docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, odd_docs)).collect()}
    assert got == brute.components(odd_docs)


def test_pieces_of_a_block_do_not_grow_with_the_corpus(monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 16)
    keys = blocks.mixed(np.arange(5000, dtype=np.uint64))
    sent = {}
    for shards in (10, 100, 1000, 100_000):
        route, levels = blocks.Route(blocks.first_column, shards), 1
        sent[shards] = route.pieces(7, 0, [keys]).num_rows
        while route.shards > blocks.FAN:
            route, levels = route.below(), levels + 1
        assert sent[shards] <= 16 and route.number() <= 16 and levels <= 1 + np.log(shards) / np.log(16)
    assert sent[100_000] == sent[100] == 16


def test_answers_come_back_in_order(monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 4)
    keys = blocks.mixed(np.arange(1000, dtype=np.uint64))
    route = blocks.Route(blocks.first_column, 4)
    pieces = route.pieces(7, 0, [keys, np.arange(1000)]).to_pylist()
    parts = [{"shard": p["shard"], "replies": blocks.pack([blocks.unpack(p["data"], p["n"])[1]])} for p in pieces]
    assert (route.returned(parts, [keys])[0] == np.arange(1000)).all()


def test_substring_random_repeats(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(rng.choice("ab") for _ in range(rng.randrange(25)))) for k in range(80)]
    got = sorted(map(tuple, substring.remove_repeats(table(spark, docs).repartition(3), n=6).collect()))
    assert got == sorted(brute.repeats(docs, 6))


def test_join_equals_brute_force(spark, odd_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, odd_docs)).collect()}
    assert got == brute.components(odd_docs)


@pytest.mark.parametrize(("rounds", "chunk"), [(2, 512), (0, 3)])
def test_join_random_near_copies(spark, monkeypatch, rounds, chunk):
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(ngram_join, "COLUMNS", 50)
    rng = random.Random(9)
    docs = []
    for k in range(160):
        if k % 4 == 0:
            base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))]
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(400)}"
        docs.append((k, " ".join(copy) + (" the common tail of all these documents" if k % 2 else "")))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, docs).repartition(4)).collect()}
    assert got == brute.components(docs)


def test_join_of_a_family_below_the_threshold(spark):
    """Documents that share 60 % of their shingles with all others, and a few near copies among them."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(90)]
    docs = [(k, " ".join([*shared, *(f"d{k}x{j}" for j in range(60))])) for k in range(60)]
    docs += [(100 + k, docs[k][1] + " tail") for k in range(0, 60, 9)]
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, docs).repartition(3)).collect()}
    assert got == brute.components(docs)


@pytest.mark.parametrize("rows", [250_000, 400])
def test_join_writes_small_tables_as_few_files(spark, monkeypatch, rows):
    """As many files as their rows need, whatever the number of shuffle partitions; each file makes the executor's JVM spawn processes."""
    held = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files, real = {}, ngram_join.written

    def counted(df, label, **more):
        out = real(df, label, **more)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", rows)
    docs = [(k, " ".join(f"d{k // 4}x{j}" for j in range(60)) + f" tail{k % 4}" * (k % 4)) for k in range(120)]
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, docs)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.components(docs)
    most = -(-120 * 16 // rows)
    assert most < 6
    for label in ("postings", "shared-tokens", "shared-postings", "components", "parents", "links", "open-tokens"):
        assert max(files[label]) <= most, (label, files[label])
    assert files["sets"] == [1]


def test_join_of_repeated_ids(spark):
    rows = [(5, "one two three four five six"), (5, "one two three four five six"), (5, "quite another text of some words"), (9, "ONE two three four five six")]
    got = sorted(map(tuple, ngram_join.components(table(spark, rows)).collect()))
    assert got == [(5, 2, 5), (5, 2, 5), (5, 2, 5), (9, 2, 5)]
    kept = [(r.doc_id, r.text) for r in ngram_join.drop_near_duplicates(table(spark, rows)).collect()]
    assert sorted(kept) == [(5, "one two three four five six"), (5, "quite another text of some words")]


#: Rows (id, text) and what stays of them; a and b are unlinked texts, each a word after them makes a near copy.
REPEATED_IDS = [
    ([(3, "a"), (5, "a tail"), (5, "b")], [(3, "a"), (5, "b")]),
    ([(5, "a"), (5, "b")], [(5, "a"), (5, "b")]),
    ([(5, "a"), (5, "a"), (5, "a")], [(5, "a")]),
    ([(5, "a"), (5, "b"), (7, "a tail"), (2, "b tail"), (None, "a end")], [(2, "b tail"), (5, "a")]),
    ([(None, "a"), (None, "b"), (None, "b"), (4, ""), (4, ""), (None, None)], [(None, "a"), (None, "b"), (4, ""), (4, ""), (None, None)]),
    ([(5, "a"), (9, "a tail"), (9, "b"), (8, "b tail")], [(5, "a"), (8, "b tail")]),
]


def test_near_copies_under_repeated_ids(spark):
    """A near copy goes whatever other row has its id, and a clean text stays; all cases in one table, with ids and words of their own."""

    def own(case, row):
        name, _, more = (row[1] or "").partition(" ")
        text = " ".join([*(f"{name}{case}w{k}" for k in range(40)), more]).strip() if name else row[1]
        return (None if row[0] is None else row[0] + 100 * case, text)

    rows = [own(k, r) for k, (some, _) in enumerate(REPEATED_IDS) for r in some]
    want = [own(k, r) for k, (_, stay) in enumerate(REPEATED_IDS) for r in stay]
    kept = ngram_join.drop_near_duplicates(table(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_near_copies_keep_clean_rows(spark, odd_docs):
    docs = table(spark, [*odd_docs, (None, "a text without id that is long enough"), (None, None)])
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute.components(odd_docs).items() if i == c}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(want)
    without = ngram_join.drop_near_duplicates(table(spark, odd_docs))
    assert sorted(r.doc_id for r in without.collect()) == sorted(want)
    assert kept.where("doc_id is null").count() == 2


def test_empty_tables(spark):
    none = table(spark, [(1, "x")]).where("false")
    assert exact_dedup.mark_duplicates(none).count() == 0
    assert exact_dedup.drop_duplicates(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert ngram_join.components(none).count() == 0
    assert ngram_join.drop_near_duplicates(none).count() == 0


def tables_written(monkeypatch):
    """How many rows each table of the join has, by label."""
    rows, real = {}, ngram_join.written

    def counted(df, label, **more):
        out = real(df, label, **more)
        rows.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", counted)
    return rows


def test_join_compares_candidates_only(spark, monkeypatch):
    """One chain through common lines, whose documents fit only the next one: what the last step compares follows the documents, not their square."""
    part = lambda k: [f"p{k}x{j}" for j in range(40)]
    docs = [(k, " ".join([*part(k), *part(k + 1), *(["a line of very many words that all of them have"] if k % 2 else [])])) for k in range(120)]
    docs += [(1000 + k, " ".join(docs[k][1].split()[: -8 - k % 5])) for k in range(0, 120, 10)]
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    rows = tables_written(monkeypatch)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, docs).repartition(3)).collect()}
    assert got == brute.components(docs)
    assert len({c for _, c in got.values()}) == 120
    assert 12 <= rows["candidates"][-1] <= 150


def test_join_counts_copies_once(spark, monkeypatch):
    """Copies with other ids add no posting, candidate or set, wherever they stand."""
    docs = [(k, " ".join(f"d{k // 2}x{j}" for j in range(60)) + f" tail{k} of it" * (k % 2)) for k in range(30)]
    copies = [(1000 * c + k, text.upper() if c == 2 else text) for c in range(5) for k, text in docs]
    rows = tables_written(monkeypatch)
    once = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, docs).repartition(2)).collect()}
    single = {k: v[0] for k, v in rows.items()}
    rows.clear()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, copies).repartition(5)).collect()}
    assert got == {1000 * c + k: once[k] for c in range(5) for k, _ in docs} == brute.components(copies)
    for label in ("postings", "shared-postings", "sets", "candidates"):
        assert rows[label][0] == single[label] > 0


@pytest.mark.parametrize("bits", [44, 5])
def test_join_where_shingles_share_tokens_and_tokens_have_parts(spark, monkeypatch, bits):
    """With few bits most documents hold one token twice; their order is open, and nothing may be left out for it."""
    monkeypatch.setattr(ngram_join, "CUT", np.uint64(2**64 - 2 ** (64 - bits)))
    monkeypatch.setattr(ngram_join, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "TOKEN_DOCS", 3)
    monkeypatch.setattr(ngram_join, "CHUNK_DOCS", 5)
    rng = random.Random(12)
    docs = []
    for k in range(90):
        if k % 6 == 0:
            base = [f"v{rng.randrange(300)}" for _ in range(rng.randrange(8, 50))]
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = f"u{rng.randrange(300)}"
        docs.append((k, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(table(spark, docs).repartition(4)).collect()}
    assert got == brute.components(docs)
    assert len({c for _, c in got.values()}) < 90
