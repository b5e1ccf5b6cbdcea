"""Exact deduplication by a heavy-hitter split.

Texts are equal when identical after lower-casing A-Z.  A Misra-Gries pass over
the digests finds every digest that could hold more than 1/(counters + 1) of the
rows.  Those candidates are counted exactly; the verified winners, at most
``counters`` rows of 56 bytes, are broadcast, and each task removes the copies
that cannot stay before anything is shuffled.  All other digests, and the few
rows that may stay, are shuffled by digest as usual, in groups that are small
because the large ones are gone.

Rows are never gathered by digest to pick one: what may stay is counted by (digest, id)
first, so any number of rows that agree in both is one row of the shuffle.

Defined cases: a null text counts as empty; a null id is smaller than any id; of rows that
tie on text and id exactly one stays; a text of any length is one digest; columns of any
name pass through drop_duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, discard, load, written

#: Counters that a Misra-Gries summary holds, hence the most winners that are broadcast.
COUNTERS = 1024
#: Copies from which a candidate is worth removing before the shuffle.
LEAST_COPIES = 16

D, ID, KEEP, SIZE, RANK = "__tm_digest", "__tm_id", "__tm_keep", "__tm_size", "__tm_rank"


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 text with A-Z lower-cased."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER).cast("binary"), 256))


def misra_gries(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests, among them all that hold more than 1/(counters + 1) of the rows."""

    def summarise(batches):
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - cut for k, v in held.items() if v > cut})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["d", "c"])

    partial = digests.select(D).mapInArrow(summarise, "d binary, c long")
    return partial.groupBy(F.col("d").alias(D)).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), D).limit(counters).select(D)


def heavy_winners(digests: DataFrame, counters: int = COUNTERS, least: int = LEAST_COPIES) -> DataFrame:
    """Exact size and staying id of each verified heavy digest; digests has the columns D and ID."""
    mine = digests.join(F.broadcast(misra_gries(digests, counters)), D, "left_semi")
    return mine.groupBy(D).agg(F.count("*").alias(SIZE), F.max(ID).alias(KEEP)).where(F.col(SIZE) >= least)


def loses() -> Column:
    """Whether a row joined with its digest's winner, if any, cannot stay."""
    return F.col(SIZE).isNotNull() & ~F.col(ID).eqNullSafe(F.col(KEEP))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the id that stays, the group's size, whether it stays, the digest."""
    digests = written(docs.select(F.col(id_col).alias(ID), digest(F.col(text_col)).alias(D)), "digests")
    winners = written(heavy_winners(digests), "winners")
    tagged = digests.join(F.broadcast(winners), D, "left")
    gone = tagged.where(loses()).select(ID, D, SIZE, KEEP, F.lit(False).alias(RANK))
    alike = tagged.where(~loses()).groupBy(D, ID).agg(F.count("*").alias("n"), F.max(SIZE).alias(SIZE))
    groups = alike.groupBy(D).agg(F.coalesce(F.max(SIZE), F.sum("n")).alias(SIZE), F.max(ID).alias(KEEP))
    each = alike.drop(SIZE).join(groups, D).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    rest = each.select(ID, D, SIZE, KEEP, (F.col(ID).eqNullSafe(F.col(KEEP)) & (F.col("copy") == 1)).alias(RANK))
    both = gone.unionByName(rest)
    return both.select(F.col(ID).alias(id_col), F.col(KEEP).alias("keep_id"), F.col(SIZE).alias("group_size"), F.col(RANK).alias("kept"), F.lower(F.hex(D)).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Texts are shuffled once.  Spark takes the first row of each digest within every task
    before that shuffle, so rows that tie on text and id meet as one row per task.
    """
    rows = docs.withColumns({ID: F.col(id_col), D: digest(F.col(text_col))})
    digests = written(rows.select(ID, D), "digests")
    winners = written(heavy_winners(digests), "winners")
    discard(digests)
    tagged = rows.join(F.broadcast(winners), D, "left").where(~loses())
    ranked = tagged.withColumn(RANK, F.row_number().over(Window.partitionBy(D).orderBy(F.desc_nulls_last(ID))))
    return ranked.where(F.col(RANK) == 1).select(docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(load(spark, sf_dir, "documents"))


SQL = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)"""
}
