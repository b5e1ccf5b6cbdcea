"""Isolation forest over orders: how few random splits set an order apart from others.

Trees are grown on the driver from at most ``SAMPLE`` orders, those with the least hashes of
their row, so the sample doesn't depend on how rows are laid out; the bound is one of the fit
only.  Each tree becomes a CASE expression over the features and every order is scored by the
sum of these expressions, without Python on executors.

An order's features are its price, the number of its lines, their quantity, their largest
discount and price, and the days from the order to its last shipping.  Lines are added up by
order before the join, so an order with very many lines is one row there.

Defined cases: an order without lines, and a null value, count as 0; values that are not finite
go the way of very large or small ones and set no splits, and as a quantity count as 0; repeated orders are scored each, and
an order number's lines count for each of them; a null order number has no lines; orders that
are all alike have score 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timing import micros
from ..sources.scratch import settled

SAMPLE, TREES, PER_TREE = 4096, 32, 256
FEATURES = ("price", "n_lines", "quantity", "most_discount", "dearest", "days")
DAY = 86_400_000_000

#: A leaf is the path length that it stands for, any other node (feature, split, below, other).
Tree = float | tuple


def order_features(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """o_orderkey and FEATURES, doubles without nulls, for each order."""
    lines = lineitem.where(F.col("l_orderkey").isNotNull()).groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("l_quantity").try_cast("decimal(18,4)")).alias("quantity"),
        F.max("l_discount").alias("most_discount"),
        F.max("l_extendedprice").alias("dearest"),
        F.max(micros(F.col("l_shipdate"))).alias("shipped"),
    )
    slim = orders.select("o_orderkey", F.col("o_totalprice").alias("price"), micros(F.col("o_orderdate")).alias("ordered"))
    rows = slim.join(lines, slim["o_orderkey"] == lines["l_orderkey"], "left").withColumn("days", (F.col("shipped") - F.col("ordered")) / DAY)
    return rows.select("o_orderkey", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])


def expected_path(n: int) -> float:
    """Mean path length to a leaf of a random tree over n rows."""
    return 2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n if n > 1 else 0.0


def grown(rows: list[tuple], rng: random.Random, depth: int, most: int) -> Tree:
    spans = []
    for k in range(len(rows[0])):
        values = [r[k] for r in rows if math.isfinite(r[k])]
        if values and min(values) < max(values):
            spans.append((k, min(values), max(values)))
    if not spans or depth == most:
        return depth + expected_path(len(rows))
    k, lo, hi = rng.choice(spans)
    split = rng.uniform(lo, hi)
    if not lo < split:  # the draw may fall on the least value, which would leave nothing below
        split = hi
    below, other = [r for r in rows if r[k] < split], [r for r in rows if not r[k] < split]
    return (k, split, grown(below, rng, depth + 1, most), grown(other, rng, depth + 1, most))


def fit(rows: list[tuple], trees: int = TREES, per_tree: int = PER_TREE, seed: int = 0) -> list[Tree]:
    """Random trees, each of at most per_tree of the rows."""
    if not rows:
        return []
    rng, size = random.Random(seed), min(per_tree, len(rows))
    most = max(1, math.ceil(math.log2(size)))
    return [grown(rng.sample(rows, size), rng, 0, most) for _ in range(trees)]


def compiled(tree: Tree, columns: tuple[str, ...]) -> str:
    """SQL for the path length of a row in the tree."""
    if isinstance(tree, float):
        return f"{tree!r}D"
    k, split, below, other = tree
    return f"CASE WHEN `{columns[k]}` < {split!r}D THEN {compiled(below, columns)} ELSE {compiled(other, columns)} END"


def scored(features: DataFrame, forest: list[Tree], size: int) -> DataFrame:
    """path_length, the mean over the trees, and score, from 0 to 1 and near 1 for rows that are soon set apart."""
    norm = expected_path(size)
    total = F.aggregate(F.array(*[F.expr(compiled(t, FEATURES)) for t in forest]), F.lit(0.0), lambda a, x: a + x) if forest else F.lit(0.0)
    out = features.withColumn("path_length", total / max(1, len(forest)))
    return out.withColumn("score", F.pow(F.lit(2.0), -F.col("path_length") / norm) if norm else F.lit(0.5)).select("o_orderkey", "path_length", "score")


def sampled(features: DataFrame, sample: int = SAMPLE) -> list[tuple]:
    """At most so many rows' features, those with the least hashes of order number and features."""
    least = features.orderBy(F.xxhash64("o_orderkey", *FEATURES), "o_orderkey", *FEATURES).limit(sample)
    return [tuple(r) for r in least.select(*FEATURES).collect()]


def isolation_scores(orders: DataFrame, lineitem: DataFrame, sample: int = SAMPLE, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 0) -> DataFrame:
    """o_orderkey, path_length and score of every order."""
    features = settled(order_features(orders, lineitem))
    rows = sampled(features, sample)
    return scored(features, fit(rows, trees, per_tree, seed), min(per_tree, len(rows)))
