"""Approximate nearest neighbours by inner product, over balanced posting lists.

One component is appended to every vector so that the largest inner product is the
smallest distance.  Centroids are fitted on a sample (``PER_CENTROID`` vectors for each)
and clusters that got too large there are split.  Every vector is indexed: it is put
into the posting list of its nearest centroid and, if it lies near a boundary, into
those of further centroids whose distance is within ``REPLICA_RATIO`` of the nearest.
Queries find centroids by a best-first search in a neighbour graph over the
centroids, and read the lists of those whose distance is within a ratio of the nearest,
but at least enough to hold all the neighbours asked for.  The ratio is fitted: it is
the one that reaches ``TARGET`` of the true neighbours of ``TRIED`` queries, which are
searched exactly.

The first ``MOST_LISTS`` lists, at most, are fitted on the driver.  A list that is longer
than ``LONG`` is divided by finer centroids, which a task fits on at most ``CELL_SAMPLE`` of
its vectors; its vectors and the queries routed to it move on to the finer lists, again
with replicas and by a graph, until no list is long.  So the number of lists grows with the
table and what a query compares does not.  Lists that can't be divided (equal or nearly
equal vectors) and lists with more than ``QUERIES`` queries are dealt to several tasks in
pieces of ``LONG`` vectors.

Equal vectors: ties go to the smaller id, so of vectors that are equal in every
component only the k + 1 smallest ids can be in any answer, and only those are listed;
equal queries are searched once and each drops its own id afterwards.  Neither loses
an answer, and a group of equal vectors costs no more than one of them.

Defined cases: null, zero, empty or non-finite vectors, vectors with null components
and rows with a null id take no part; where lengths differ the most frequent one
counts; of rows that repeat an id the nearest counts; with fewer candidates than k
all are returned; other columns, whatever their names, are not read; an empty table
gives an empty result.  Vectors keep their type, and scores are exact sums in double
precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, load, written

K, LIST, MOST_LISTS, PER_CENTROID = 20, 512, 2048, 8
REPLICAS, REPLICA_RATIO = 3, 1.12
TRIED, TARGET, CELL_TARGET = 128, 0.97, 0.99
LINKS, BEAM, LONG, QUERIES, CELL_SAMPLE = 16, 64, 4096, 16_384, 16_384
#: Vectors of the lists that one task compares, so that it returns one set of best ones for a query.
SHELF = 4096


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def squared(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def matrix(lists) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def lifted(x: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    """The vectors with the component that turns inner products into distances."""
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x * x).sum(1), 0))
    return np.hstack([x, last[:, None]])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def centroids(x: np.ndarray, wanted: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds on the sample; after each, empty clusters move into the fullest ones."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: max(1, min(wanted, len(x)))]]
    for _ in range(rounds):
        near = np.concatenate([distances(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        small, large = np.flatnonzero(count * 4 < len(x) / len(c)), np.argsort(-count)
        for a, b in zip(small, [k for k in large if count[k] > 2 * len(x) / len(c)], strict=False):
            mine = x[near == b]
            c[a] = mine[rng.integers(len(mine))]
    return np.unique(c, axis=0)


def neighbour_graph(c: np.ndarray, links: int = LINKS, seed: int = 7) -> np.ndarray:
    """For each centroid its nearest ones, and a few random ones that keep the graph connected."""
    d = distances(c, c)
    near = np.argsort(d, 1, kind="stable")[:, 1 : links + 1]
    far = np.random.default_rng(seed).integers(0, len(c), (len(c), max(4, links // 4)))
    ring = (np.arange(len(c))[:, None] + 1) % len(c)
    return np.hstack([near, far, ring])


def graph_search(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for a block of queries at once -> (centroids, squared distances), nearest first."""
    n, beam = len(q), min(beam, len(c))
    rows = np.arange(n)[:, None]
    entry = np.unique(np.linspace(0, len(c) - 1, min(8, len(c))).astype(int))
    seen = np.zeros((n, len(c)), bool)
    seen[:, entry] = True
    found = np.full((n, beam), 0)
    dist = np.full((n, beam), np.inf)
    opened = np.ones((n, beam), bool)
    near = distances(q, c[entry])
    m = min(beam, len(entry))
    order = np.argsort(near, 1)[:, :m]
    found[:, :m], dist[:, :m], opened[:, :m] = entry[order], np.take_along_axis(near, order, 1), False
    for _ in range(4 * beam):
        waiting = np.where(opened, np.inf, dist)
        at = waiting.argmin(1)
        alive = np.isfinite(waiting[np.arange(n), at])
        if not alive.any():
            break
        opened[np.arange(n), at] = True
        step = graph[found[np.arange(n), at]]
        fresh = ~seen[rows, step] & alive[:, None]
        seen[rows, step] |= alive[:, None]
        d = np.where(fresh, ((q[:, None, :] - c[step]) ** 2).sum(-1), np.inf)
        # a centroid may stand twice in one row of the graph
        by_id = np.argsort(step, 1, kind="stable")
        twice = np.take_along_axis(step, by_id, 1)
        again = np.zeros_like(fresh)
        np.put_along_axis(again, by_id[:, 1:], twice[:, 1:] == twice[:, :-1], 1)
        d = np.where(again, np.inf, d)
        all_d, all_f = np.hstack([dist, d]), np.hstack([found, step])
        all_o = np.hstack([opened, np.zeros_like(fresh)])
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist, found, opened = (np.take_along_axis(a, order, 1) for a in (all_d, all_f, all_o))
    return found, dist


def fit(rows: DataFrame, seed: int = 7) -> tuple[int, np.ndarray, float]:
    """(usable vectors, centroids, largest squared length); rows: id, v."""
    n, most = rows.agg(F.count("*"), F.max(squared(F.col("v")))).first()
    if not n:
        return 0, np.zeros((1, 1)), 0.0
    wanted = max(1, min(n // LIST, MOST_LISTS))
    share = min(1.0, 1.2 * PER_CENTROID * wanted / n)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(PER_CENTROID * wanted).toArrow()
    x = matrix(picked.column("v").combine_chunks()) if picked.num_rows else matrix(rows.select("v").limit(1).toArrow().column("v").combine_chunks())
    x = lifted(x, most)
    return n, centroids(x, max(1, min(wanted, len(x) // PER_CENTROID))), most


def with_replicas(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): each lifted vector's nearest centroid, and further ones whose distance is near that."""
    rows, lists = [], []
    for i in range(0, len(x), 2048):
        d = np.sqrt(distances(x[i : i + 2048], c))
        near = np.argsort(d, 1, kind="stable")[:, : min(REPLICAS, len(c))]
        at = np.take_along_axis(d, near, 1)
        row, col = np.nonzero(at <= np.maximum(at[:, :1] * REPLICA_RATIO, 1e-12))
        rows.append(i + row)
        lists.append(near[row, col])
    return np.concatenate(rows), np.concatenate(lists)


def read_lists(found: np.ndarray, d: np.ndarray, sizes: np.ndarray, ratio: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, list, whether it is near): the lists within the ratio of the nearest centroid; those that are near hold k vectors."""
    reached = np.isfinite(d)
    held = np.cumsum(np.where(reached, sizes[found], 0), 1)
    needed = np.hstack([np.zeros((len(found), 1)), held[:, :-1]]) < (k + 1) * REPLICAS
    use = reached & (needed | (d <= d[:, :1] * ratio))
    short = (held[:, -1] < (k + 1) * REPLICAS) & (sizes.sum() > held[:, -1])
    row, col = np.nonzero(use & ~short[:, None])
    lists, some = found[row, col], np.flatnonzero(short)  # too few in reach: all lists
    near = np.append((reached & needed)[row, col], np.ones(len(some) * len(sizes), bool))
    return np.append(row, np.repeat(some, len(sizes))), np.append(lists, np.tile(np.arange(len(sizes)), len(some))), near


def scan(q: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the k best vectors of each query, and of all that tie with the last, if they score at least so much."""
    floor = np.broadcast_to(least, len(q))
    rows, cols, scores = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64))
    step = max(1, 4_000_000 // max(1, len(x)))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        s = part @ x.T
        last = np.maximum(np.partition(s, -min(k, s.shape[1]), 1)[:, -min(k, s.shape[1])], floor[i : i + step])
        row, col = np.nonzero(s >= (last - 1e-9 * np.maximum(np.abs(s).max(1), 1e-300))[:, None])
        rows.append(i + row)
        cols.append(col)
        scores.append((part[row] * x[col]).sum(1))  # the same for equal vectors, whatever stands beside them
    return tuple(map(np.concatenate, (rows, cols, scores)))


def best_of(query: np.ndarray, vector: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller vector, replicas once; sorted."""
    order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (vector[1:] != vector[:-1]) | (score[1:] != score[:-1])
    query, vector, score = query[fresh], vector[fresh], score[fresh]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], vector[keep], score[keep]


def nearest_centroids(q: np.ndarray, c: np.ndarray, graph: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, distances) of queries, nearest first.

    Of a query's distance to a lifted point only the inner product matters, so the square
    of the nearest one is replaced by a quarter of the query's own.
    """
    found, d2 = graph_search(lifted(q, 0, query=True), c, graph, beam)
    own = 0.25 * np.maximum((q * q).sum(1)[:, None], 1e-300)
    return found, np.sqrt(d2 - d2[:, :1] + own)


def exact_neighbours(listed: DataFrame, q: np.ndarray, k: int) -> DataFrame:
    """at (row of q), id: the k best of all vectors for each of a few queries, ties to smaller ids."""
    shared = listed.sparkSession.sparkContext.broadcast(q)

    def best(batches):
        q = shared.value
        for b in batches:
            x, ids = matrix(b.column("v")), b.column("id").to_numpy()
            score = q @ x.T
            for at in range(len(q)):
                top = np.lexsort((ids, -score[at]))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), at, np.int32)), pa.array(ids[top]), pa.array(score[at][top])], ["at", "id", "score"])

    order = Window.partitionBy("at").orderBy(F.desc("score"), "id")
    return listed.mapInArrow(best, "at int, id long, score double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("at", "id")


def fitted_ratio(asked: DataFrame, listed: DataFrame, postings: DataFrame, c: np.ndarray, graph: np.ndarray, k: int) -> tuple[float, int]:
    """(distance ratio, centroids to search for) that reach TARGET of the true neighbours of TRIED queries."""
    tried = asked.orderBy(F.xxhash64("rep")).limit(TRIED).select("v").toArrow()
    if not tried.num_rows or len(c) == 1:
        return 1.0, BEAM
    q = matrix(tried.column("v").combine_chunks())
    true = exact_neighbours(listed, q, k)
    where = postings.select("list", "id").join(F.broadcast(true), "id").groupBy("at", "id").agg(F.collect_list("list").alias("lists")).collect()
    found, d = nearest_centroids(q, c, graph, len(c))
    needed = np.full((len(q), len(c)), np.inf)
    np.put_along_axis(needed, found, d / d[:, :1], 1)  # ratio at which each list is read
    ratios = np.sort([needed[r["at"], r["lists"]].min() for r in where])
    ratio = float(ratios[min(len(ratios) - 1, int(np.ceil(TARGET * len(ratios))))])
    if not np.isfinite(ratio):
        return np.inf, len(c)
    return ratio, int(min(len(c), max(BEAM, 1.5 * (d <= d[:, :1] * ratio).sum(1).max())))


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    rows = rows.where(F.size("v") == (widths["w"] if widths else 0))
    n, c, most = fit(rows)
    model = spark.sparkContext.broadcast((c, neighbour_graph(c), most))

    # of equal vectors, the k + 1 smallest ids (Spark drops the others before the shuffle)
    equal = Window.partitionBy("v").orderBy("id")
    listed = rows.select("id", "v").withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1).select("id", "v")

    def assign(batches):
        c, _, most = model.value
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                row, lists = with_replicas(lifted(matrix(part.column("v")), most), c)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column("id").take(take), part.column("v").take(take)], ["list", "id", "v"])

    postings = written(listed.mapInArrow(assign, f"list int, id long, v {kind}"), "postings")
    sizes = per_list(postings, len(c))
    asked = rows.where("asks").groupBy("v").agg(F.min("id").alias("rep"))
    ratio, beam = fitted_ratio(asked, listed, postings, *model.value[:2], k)
    lengths = spark.sparkContext.broadcast(sizes)

    def route(batches):
        c, graph, _ = model.value
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found, d = nearest_centroids(matrix(part.column("v")), c, graph, beam)
                row, lists, near = read_lists(found, d, lengths.value, ratio, k)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column("rep").take(take), part.column("v").take(take), pa.array(near)], ["list", "rep", "v", "near"])

    routed = written(asked.mapInArrow(route, f"list int, rep long, v {kind}, near boolean"), "routed")
    while True:
        finer = divided(postings, routed, sizes, k, kind)
        if finer is None:
            break
        discard(postings, routed)
        postings, routed, sizes = finer
    chunks, parts = np.maximum(1, -(-sizes // LONG)), np.maximum(1, -(-per_list(routed, len(sizes)) // QUERIES))
    plan = spark.sparkContext.broadcast({"chunk": chunks, "part": parts, "shelf": np.cumsum(np.minimum(sizes, LONG)) // SHELF})

    def planned(name: str) -> Column:
        return F.arrow_udf(lambda lists: pa.array(plan.value[name][lists.to_numpy()].astype(np.int32)), "int")("list")

    deal = lambda df, name, own: df.withColumn(name, F.pmod(F.xxhash64(own), planned(name)).cast("int"))
    all_of = lambda df, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), planned(name) - 1)))
    right = all_of(deal(postings, "chunk", "id"), "part").withColumn("shelf", planned("shelf"))

    def compare(key, left: pa.Table, right: pa.Table) -> pa.Table:
        listed_at, asked_at = right.column("list").to_numpy(), left.column("list").to_numpy()
        all_x, all_ids = matrix(right.column("v").combine_chunks()), right.column("id").to_numpy()
        all_q, all_reps, least = matrix(left.column("v").combine_chunks()), left.column("rep").to_numpy(), left.column("least").to_numpy()
        hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for which in np.intersect1d(listed_at, asked_at):
            mine, asks = np.flatnonzero(listed_at == which), np.flatnonzero(asked_at == which)
            row, col, score = scan(all_q[asks], all_x[mine], k + 1, least[asks])
            hits.append((all_reps[asks[row]], all_ids[mine[col]], score))
        rep, vec, score = best_of(*map(np.concatenate, zip(*hits, strict=True)), k + 1)
        return pa.table({"rep": rep, "id": vec, "score": score})

    group = ("shelf", "chunk", "part")
    order = Window.partitionBy("rep").orderBy(F.desc("score"), "id")

    def hits(asks: DataFrame) -> DataFrame:
        left = all_of(deal(asks, "part", "rep"), "chunk").withColumn("shelf", planned("shelf"))
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, "rep long, id long, score double")

    def top(found: DataFrame) -> DataFrame:
        return found.groupBy("rep", "id").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)

    # the near lists give each query a bound, below which the others need not report anything
    near = written(top(hits(routed.where("near").withColumn("least", F.lit(float("-inf"))))), "near")
    bound = near.where(F.col("place") == k + 1).select("rep", F.col("score").alias("least"))
    far = routed.where("not near").join(bound, "rep", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    best = top(near.drop("place").unionByName(hits(far)))
    mine = rows.where("asks").select(F.col("id").alias("query_id"), "v").distinct().join(asked, "v").select("query_id", "rep")
    answers = mine.join(best, "rep").where("id != query_id").groupBy("query_id", F.col("id").alias("vec_id")).agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divided(postings: DataFrame, routed: DataFrame, sizes: np.ndarray, k: int, kind: str, seed: int = 7) -> tuple[DataFrame, DataFrame, np.ndarray] | None:
    """(postings, routed, sizes) with every long list divided by finer centroids; None if none can be."""
    spark = postings.sparkSession
    at = np.flatnonzero(sizes > LONG)
    if not len(at):
        return None
    share = np.ones(len(sizes))
    share[at] = CELL_SAMPLE / sizes[at]
    first = spark.sparkContext.broadcast((np.isin(np.arange(len(sizes)), at), (share * (1 << 30)).astype(np.int64), np.maximum(1, -(-sizes // (16 * LONG)))))

    def planned(what: int, type_: str) -> Column:
        return F.arrow_udf(lambda lists: pa.array(first.value[what][lists.to_numpy()]), type_)("list")

    def cell(rows: pa.Table) -> pa.Table:
        x = matrix(rows.column("v").combine_chunks())
        most = (x * x).sum(1).max() * 1.0001
        which = rows.column("list")[0].as_py()
        c = centroids(lifted(x, most), max(2, min(len(x) // PER_CENTROID, -(-4 * sizes[which] // LONG))), seed=seed)
        # the ratio that reaches CELL_TARGET of the sample's true neighbours for some of its vectors
        q = x[np.random.default_rng(seed).permutation(len(x))[:TRIED]]
        row, col, _ = scan(q, x, k)
        near, d = nearest_centroids(q, c, neighbour_graph(c), len(c))
        at = np.full((len(q), len(c)), np.inf)
        np.put_along_axis(at, near, d / d[:, :1], 1)
        least = np.full((len(x), len(q)), np.inf, np.float32)
        member, of = with_replicas(lifted(x, most), c)
        np.minimum.at(least, member, at[:, of].T)
        ratio = float(np.quantile(least[col, row], CELL_TARGET, method="higher"))
        return pa.table({"list": pa.array([which], pa.int32()), "width": pa.array([c.shape[1]], pa.int32()), "c": pa.array([c.tobytes()], pa.binary()), "most": [most], "ratio": [ratio]})

    sample = postings.where(planned(0, "boolean") & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < planned(1, "long")))
    cells = written(sample.groupBy("list").applyInArrow(cell, "list int, width int, c binary, most double, ratio double"), "cells")
    found = {r["list"]: len(r["c"]) // 8 // r["width"] for r in cells.select("list", "width", "c").toLocalIterator()}  # at most MOST_LISTS rows at a time
    number = np.array([found.get(i, 1) for i in range(len(sizes))])
    base = np.cumsum(number) - number

    def inside(table: pa.Table) -> tuple[np.ndarray, float, float]:
        row = table.slice(0, 1).to_pylist()[0]
        return np.frombuffer(row["c"]).reshape(-1, row["width"]), row["most"], row["ratio"]

    def assign(key, rows: pa.Table, table: pa.Table) -> pa.Table:
        which = key[0].as_py()
        rows = rows.select(["list", "id", "v"])
        if not table.num_rows or not rows.num_rows:
            return rows.set_column(0, "list", pa.array(np.full(rows.num_rows, base[which], np.int32)))
        c, most, _ = inside(table)
        row, lists = with_replicas(lifted(matrix(rows.column("v").combine_chunks()), most), c)
        rows = rows.take(pa.array(row))
        return rows.set_column(0, "list", pa.array((base[which] + lists).astype(np.int32)))

    piece = lambda df, own: df.withColumn("piece", F.pmod(F.xxhash64(own), planned(2, "long")).cast("int"))
    each = cells.withColumn("piece", F.explode(F.sequence(F.lit(0), (planned(2, "long") - 1).cast("int"))))
    finer = piece(postings, "id").groupBy("list", "piece").cogroup(each.groupBy("list", "piece")).applyInArrow(assign, f"list int, id long, v {kind}")
    finer = written(finer.dropDuplicates(["list", "id"]), "postings")
    counts = per_list(finer, int(number.sum()))
    if max(counts, default=0) >= max(sizes):  # nothing was gained: the vectors are too much alike
        discard(finer, cells)
        return None

    def route(key, rows: pa.Table, table: pa.Table) -> pa.Table:
        which = key[0].as_py()
        rows = rows.select(["list", "rep", "v", "near"])
        if not table.num_rows or not rows.num_rows:
            return rows.set_column(0, "list", pa.array(np.full(rows.num_rows, base[which], np.int32)))
        c, _, ratio = inside(table)
        graph, q = neighbour_graph(c), matrix(rows.column("v").combine_chunks())
        row, lists, close = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for i in range(0, len(q), 256):
            near, d = nearest_centroids(q[i : i + 256], c, graph, max(BEAM, len(c) // 4))
            a, b, c_near = read_lists(near, d, counts[base[which] : base[which] + len(c)], ratio, k)
            row.append(i + a)
            lists.append(b)
            close.append(c_near)
        rows = rows.take(pa.array(np.concatenate(row)))
        near = rows.column("near").to_numpy() & np.concatenate(close)
        return rows.set_column(3, "near", pa.array(near)).set_column(0, "list", pa.array((base[which] + np.concatenate(lists)).astype(np.int32)))

    moved = piece(routed, "rep").groupBy("list", "piece").cogroup(each.groupBy("list", "piece")).applyInArrow(route, f"list int, rep long, v {kind}, near boolean")
    out = written(moved, "routed")
    discard(cells)
    return finer, out, counts


def per_list(rows: DataFrame, lists: int) -> np.ndarray:
    """How many rows each list has."""
    out = np.zeros(lists, np.int64)
    for r in rows.groupBy("list").count().toLocalIterator():  # one row per centroid
        out[r["list"]] = r["count"]
    return out


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL: dict = {}
