import os
import random
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import ann, bpe, mixing, shared, url_filter

from . import brute
from .conftest import table

DATA = "/root/testdata/sf0.001"


def test_mixing_targets_and_copies(spark, odd_docs):
    docs = table(spark, [*odd_docs, (None, "no id")], sources=("a", None, "B", "ü", "a"))
    rows = mixing.with_copies(docs).collect()
    sizes = {}
    for r in rows:
        assert r[mixing.SIZE] == len(brute.words(r.text)) and 0 <= r[mixing.COPIES] <= 2
        sizes[r.source] = sizes.get(r.source, 0) + r[mixing.SIZE]
    want = brute.targets(sizes)
    for r in rows:
        assert r["__tm_target"] == pytest.approx(want[r.source]) and r["__tm_source_size"] == sizes[r.source]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r[mixing.COPIES] for r in rows)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_comes_near_its_targets_and_repeats_itself(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    run = lambda d: sorted(map(tuple, mixing.with_copies(d).select("doc_id", mixing.COPIES, "source", mixing.SIZE, "__tm_target").collect()))
    rows = run(docs)
    assert rows == run(docs.repartition(7))
    for source in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == source]
        assert sum(r[1] * r[3] for r in mine) == pytest.approx(mine[0][4], rel=0.03)


def test_mixing_of_repeated_and_null_ids(spark):
    docs = [(None, "a b c"), (None, "a b c"), (None, "d e f g"), (3, "x y"), (3, "x y"), (3, "z " * 20_000)] * 3
    once = sorted(((r.doc_id, r.text, r[mixing.COPIES]) for r in mixing.with_copies(table(spark, docs, sources=("a",))).collect()), key=str)
    again = sorted(((r.doc_id, r.text, r[mixing.COPIES]) for r in mixing.with_copies(table(spark, docs, sources=("a",)).repartition(3)).collect()), key=str)
    assert once == again and len(once) == len(docs)


PAGES = [
    (1, "https://A.org/x", '<a href="http://good.net/a">'),
    (2, "http://a.org", ""),
    (3, "http://www.example.org/es/1?q#f", '<A HREF=//evil.net:80/>'),
    (4, "http://example.org/en/12", "<a href='https://bad.net/'>"),
    (5, "http://x.com/fr/", None),
    (6, "http://x.com/de/z", '<a href="/local">'),
    (7, "http://good.net/a", '<a href="http://fine.net/"> <a href="/own">'),
    (8, "http://linker.net/", '<a href="http://x.com/de/z"> <a href="http://example.org/en/1">'),
    (9, "http://fine.net/?a", ""),
    (10, "no scheme", None),
    (11, None, None),
    (12, "http://myorg/x", ""),
    (12, "http://myorg/x", ""),
    (13, "ftp://u@b.org#frag", ""),
]


def test_url_rules_and_propagation(spark):
    pages = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert url_filter.judge(pages).count() == len(PAGES)
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("a.org", "", None, "allow")
    assert got[3] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][2:] == (None, "allow") and got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10] == got[11] == ("", "", None, "allow")
    assert got[12] == ("myorg", "/x", None, "allow") and got[13] == ("u@b.org", "", None, "allow")
    assert url_filter.judge(pages.where("false")).count() == 0
    base = duckdb.connect()
    base.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    base.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    theirs = base.execute(url_filter.SQL["op7_url_filter"]).fetchall()
    assert sorted(map(str, theirs)) == sorted(str(tuple(r)) for r in url_filter.judge(pages).collect())


def link_pages(rng, hosts, n):
    to = lambda: "".join(f'<a href="http://{rng.choice(hosts)}/x">' for _ in range(rng.randrange(4)))
    return [(k, f"http://{rng.choice(hosts)}/{rng.choice(['', 'es/', 'de/'])}{k}", to()) for k in range(n)]


@pytest.mark.parametrize("hub", [100_000, 2])
def test_propagation_goes_on_until_it_has_settled(spark, monkeypatch, hub):
    """A chain of 14 hosts to a blocked one, and random links among hosts of all kinds; with hub 2 most hosts are divided."""
    monkeypatch.setattr(url_filter, "HUB", hub)
    chain = [(k, f"http://h{k}.net/p", f'<a href="http://h{k + 1}.net/p">') for k in range(14)] + [(14, "http://h14.net/p", '<a href="http://example.org/es/">'), (15, "http://example.org/es/1", "")]
    rng = random.Random(6)
    hosts = ["a.org", "b.org", "example.org", "c.com", *(f"n{k}.net" for k in range(25))]
    schema = "page_id long, url string, html string"
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(chain, schema)).collect()}
    assert verdicts == dict.fromkeys(range(16), "block")
    pages = link_pages(rng, hosts, 150)
    base = duckdb.connect()
    base.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    base.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    theirs = base.execute(url_filter.SQL["op7_url_filter"]).fetchall()
    mine = sorted(map(str, map(tuple, url_filter.judge(spark.createDataFrame(pages, schema)).collect())))
    assert mine == sorted(map(str, theirs))
    assert {"allow", "block"} == {r[4] for r in theirs if r[3] is None}


def test_urls_and_html_of_any_length(spark):
    long = "a" * 200_000
    rows = [(1, f"http://{long}.org/{long}", f'<a href="http://x.net/{long}">' * 3), (2, f"http://x.com/{long}?{long}", long), (None, None, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(*r, "q", "q") for r in rows], "page_id long, url string, html string, rule string, path string")).collect()}
    assert got[1].rule == "org/" and got[1].host == f"{long}.org" and got[2].path == f"/{long}" and got[None].verdict == "allow"


def nearest(ids, x, q, k):
    s = (x[q] * x).sum(1)
    order = np.lexsort((ids, -s))
    return [int(ids[j]) for j in order if ids[j] != ids[q]][:k]


def recall(got, ids, x, k=20):
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, k + 1)) and mine.score.is_monotonic_decreasing
        hits, total = hits + len(set(mine.vec_id) & set(nearest(ids, x, q, k))), total + k
    return hits / total


@pytest.mark.parametrize(("size", "lists", "long"), [(512, 2048, 4096), (32, 2048, 4096), (32, 4, 64)])
def test_nearest_recall_and_order(spark, monkeypatch, size, lists, long):
    """Few lists, more than 60 lists, and four long lists that are divided by finer centroids."""
    for name, value in (("LIST", size), ("MOST_LISTS", lists), ("LONG", long), ("SHELF", 256), ("QUERIES", 50)):
        monkeypatch.setattr(ann, name, value)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.toPandas()
    got = ann.search(rows, F.col("vec_id") % 20 == 0).toPandas()
    assert recall(got, data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)) >= 0.9


def test_lists_are_divided_and_the_graph_finds_centroids():
    x = np.random.default_rng(1).normal(size=(4000, 8))
    c = ann.centroids(x, 80)
    found, d = ann.graph_search(x[:300], c, ann.neighbour_graph(c), 16)
    true = ann.distances(x[:300], c).argmin(1)
    assert len(c) >= 50 and (found[:, 0] == true).mean() > 0.95
    row, of = ann.with_replicas(x, c)
    assert set(row) == set(range(4000)) and 4000 < len(row) <= ann.REPLICAS * 4000
    assert np.bincount(of).max() < 4000 / 8


def test_nearest_keeps_double_precision(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.1]), (1, [1.0, 0.5]), (2, [1.0 + 1e-10, 0.5])], "vec_id long, embedding array<double>")
    got = ann.search(rows, F.col("vec_id") == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, (1.0 + 1e-10) + 0.1 * 0.5), (1, 1.0 + 0.1 * 0.5)]


def test_nearest_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (40, []), (9, [-3.0, 1.0]), (9, [-3.0, 1.0])]
    rows = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted(map(tuple, ann.search(rows, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (0, 4, 9, -3.0), (20, 1, 0, 1.0), (20, 2, 3, 1.0), (20, 3, 1, 0.5), (20, 4, 9, -3.0)]
    assert ann.search(rows.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    many = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(500)], "vec_id long, embedding array<float>")
    answers = ann.search(many, F.col("vec_id") % 20 == 0, k=3).where("query_id in (0, 40)").collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in answers) == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (40, 1, 0), (40, 2, 1), (40, 3, 2)]


ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
from tidemark.llm import exact_dedup
for name in ("op3_toxicity", "op4_bpe", "op8_lm_score"):
    assert __spark_entry__.queries()[name](spark, {data!r}).count() > 0
print("done")
"""


def test_workers_need_no_path_to_this_repository(tmp_path):
    """Executors get classes and functions by value: nothing is imported from this repository there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != root)
    (tmp_path / "alone.py").write_text(ALONE.format(root=root, data=DATA))
    out = subprocess.run([sys.executable, "alone.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600, check=False)
    assert "done" in out.stdout, out.stderr[-3000:]


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.scratch_root(Session())


def test_discarded_and_released_tables_are_gone(spark):
    one, two = (shared.written(spark.range(3), "gone") for _ in range(2))
    path = lambda df: df._tidemark_path.removeprefix("file:")
    shared.discard(one)
    assert not os.path.exists(path(one)) and os.path.exists(path(two))


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    rows = {r.doc_id: r for r in kept.collect()}
    stays = {i for i, k, _ in brute.exact([(i, r.text) for i, r in rows.items()]) if i == k}
    parts = brute.components([(i, rows[i].text) for i in stays])
    stays = sorted(i for i, (_, c) in parts.items() if i == c)
    sample = spark.createDataFrame([rows[i] for i in stays], docs.schema)
    copies = {r.doc_id: r[mixing.COPIES] for r in mixing.with_copies(sample).collect()}
    want = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.digests(sample).collect() for _ in range(copies[r.doc_id]))
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got.collect()) == want


def test_stages_take_odd_tables(spark, odd_docs):
    docs = table(spark, [*odd_docs, (None, None), (None, "x"), (5, "five"), (5, "five")])
    for empty in (False, True):
        part = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, DATA)
            assert (part.count() == 0) == empty
            if name != "bpe":
                assert part.columns == docs.columns
