"""A block of customers and suppliers that trade unusually much with each other, by peeling.

The density of customers S and suppliers T is the weight of the pairs between them over
sqrt(|S| |T|).  Round after round one side is peeled, the one that is larger against the
proportion aimed at: all its members leave whose weight is at most 1 + slack of the side's mean.
Weights of the rest fall with them, so the next round has other means.  The densest of all rounds'
blocks is the result: for blocks of that proportion its density is at least 1 / (2 + 2 slack) of
the best one's, and a round leaves its side smaller by a factor of 1 + slack at least.

A pair is one row, however many lines it has, and leaves in exactly one round; a member's last
round is the largest of its pairs.  Only three numbers of a round come to the driver, and pairs are
checkpointed round by round.  A round shuffles the pairs that are left by the peeled side; a
member with very many pairs is split by the adaptive skew join, since only the pairs' side is large.

Defined cases: lines whose order is missing, and pairs with a null on either side, are left out;
repeated lines add weight; of equally dense rounds the first, the largest block, counts; a member
without pairs left has left; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled


def trade(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """left (customer), right (supplier), weight (number of lines)."""
    lines = lineitem.select(F.col("l_orderkey").alias("order"), F.col("l_suppkey").alias("right")).where("right is not null")
    buyers = orders.select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("left")).where("left is not null")
    return lines.join(buyers, "order").groupBy("left", "right").agg(F.count("*").alias("weight"))


def peeled(pairs: DataFrame, slack: int = 10) -> tuple[DataFrame, list[float]]:
    """The pairs (left, right, weight) with the round in which each leaves, and every round's density.

    slack: in percent.  The proportion aimed at is that of all pairs' sides.
    """
    rest, gone, densities, aim = settled(pairs), [], [], None
    while True:
        weights = {side: rest.groupBy(side).agg(F.sum("weight").alias("sum")) for side in ("left", "right")}
        sizes = reduce(DataFrame.unionByName, [w.agg(F.lit(s).alias("side"), F.count("*").alias("n"), F.sum("sum").alias("total")) for s, w in weights.items()])
        n, total = {}, 0
        for row in sizes.collect():
            n[row.side], total = row.n, row.total
        if not total:
            break
        aim = aim or dict(n)
        densities.append(total / math.sqrt(n["left"] * n["right"]))
        side = "left" if n["left"] * aim["right"] >= aim["left"] * n["right"] else "right"
        # decimals, as products of sums and counts can pass 2^63
        leaves = (F.col("sum").cast("decimal(38,0)") * 100 * n[side]) <= F.lit((100 + slack) * total).cast("decimal(38,0)")
        few = weights[side].where(leaves).select(side, F.lit(True).alias("leaves"))
        marked = settled(rest.join(few, side, "left"))
        gone.append(marked.where("leaves").select("left", "right", "weight", F.lit(len(densities)).alias("round")))
        rest = marked.where("leaves is null").select("left", "right", "weight")
    if not gone:
        return rest.withColumn("round", F.lit(1)), []
    return reduce(DataFrame.unionByName, gone), densities


def dense_block(orders: DataFrame, lineitem: DataFrame, slack: int = 10) -> DataFrame:
    """side, member, rounds (its last one), in_block and the block's density, for everyone who trades."""
    pairs, densities = peeled(trade(orders, lineitem), slack)
    best = max(densities, default=0.0)
    first = densities.index(best) + 1 if densities else 1
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), F.col(at).alias("member")) for name, at in (("customer", "left"), ("supplier", "right"))]))
    rounds = pairs.select(sides.alias("m"), "round").groupBy("m.side", "m.member").agg(F.max("round").alias("rounds"))
    return rounds.withColumns({"in_block": F.col("rounds") >= first, "density": F.lit(best)})
