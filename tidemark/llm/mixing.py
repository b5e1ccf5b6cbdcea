"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target in words.  A document of a source with target t and s
words is expected t / s times.  Documents stand in a fixed order within their
source; the running sum of their expected copies plus one random offset of the
source crosses some integers, and a document is emitted once for each integer
that is crossed at it.  The order is by size class, then by a hash of id and text, so
that every stretch of the running sum holds the same mix of sizes.

The running sum is not taken over a source in one task.  Documents are numbered
within (source, size class, hash prefix) buckets, of a prefix as long as keeps them
at about ``BUCKET_ROWS`` rows, and the buckets' small table of counts gives each
bucket's start.  The order does not depend on how long the prefix is.  Numbering and
the join with the starts share one shuffle, the only one that carries texts.

Defined cases: null text or no words is size 0, and a text of any length is one row;
null source is a source, ordered last; a source without words has target 0 and its
documents are not taken; rows that agree in id and text are alike, so that which of
them is taken makes no difference to those columns; columns of any name pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, load, written

WEIGHTS = (3, 1, 2)
SHARE, MOST_COPIES, SEED, BUCKET_ROWS = 1.5, 2.0, "mix", 4096

SRC, SIZE, CLASS, SUB, HASH, COPIES = "__tm_src", "__tm_size", "__tm_class", "__tm_sub", "__tm_hash", "__tm_copies"
#: The source as a string that is never null.
KEY = "__tm_key"
BUCKET = [KEY, CLASS, SUB]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """SRC, KEY, source_size -> with target.  One row per source; the level that all uncapped sources
    share per unit of weight is found by sorting sources by the level at which each is capped."""
    ordered = Window.orderBy(F.asc_nulls_last(SRC))
    by_cap = Window.orderBy("cap_level", "place")
    weighted = (
        sources.withColumn("place", F.row_number().over(ordered))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    fits = F.max(F.when(F.col("level") <= F.col("cap_level"), F.col("level"))).over(Window.partitionBy())
    return weighted.withColumn("target", F.coalesce(F.least("cap", fits * F.col("weight")), F.col("cap"))).select(SRC, KEY, "source_size", "target")


def with_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST_COPIES, seed=SEED) -> DataFrame:
    """docs with SIZE, source_size, target and COPIES, all named apart from the columns of docs."""
    digits = max(2, math.ceil(math.log(max(docs.count(), 1) / BUCKET_ROWS, 16)))
    own = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.withColumns({SRC: F.col(source_col), KEY: F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")), SIZE: word_count(F.col(text_col)), HASH: own})
    rows = rows.withColumns({CLASS: F.length(F.bin(SIZE)), SUB: F.substring(HASH, 1, digits)})
    buckets = written(rows.groupBy(SRC, *BUCKET).agg(F.count("*").alias("n"), F.sum(SIZE).alias("words")), "buckets")
    goal = targets(buckets.groupBy(SRC, KEY).agg(F.sum("words").alias("source_size")), weights, share, most)
    before = Window.partitionBy(KEY).orderBy(CLASS, SUB).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(SRC, F.lit(""))).cast("binary")), 1, 4), 16, 10).cast("double") / 65536.0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    starts = buckets.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(goal.drop(SRC), KEY)
    starts = starts.select(*BUCKET, F.col("start").alias("__tm_start"), F.col("source_size").alias("__tm_source_size"), F.col("target").alias("__tm_target"), rate.alias("__tm_rate"), offset.alias("__tm_offset"))
    within = Window.partitionBy(*BUCKET).orderBy(HASH)
    placed = rows.withColumn("__tm_place", F.row_number().over(within)).join(starts, BUCKET)
    place = (F.col("__tm_start") + F.col("__tm_place")).cast("double")
    crossed = F.floor(F.col("__tm_offset") + F.col("__tm_rate") * place) - F.floor(F.col("__tm_offset") + F.col("__tm_rate") * (place - 1.0))
    return placed.withColumn(COPIES, crossed.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of docs."""
    taken = with_copies(docs, **options).where(F.col(COPIES) > 0)
    return taken.withColumn("__tm_copy", F.explode(F.sequence(F.lit(1), F.col(COPIES)))).select(docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_copies(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col(SIZE).alias("size"), F.col("__tm_source_size").alias("source_size"), F.col("__tm_target").alias("target"), (F.col(COPIES) * F.col(SIZE)).alias("taken"))


SQL = {
    "op5_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS own FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
        w AS (SELECT *, ([3.0, 1.0, 2.0])[((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
        l AS (SELECT *, cap / weight AS cap_level,
                     (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                     / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, md5('mix:' || coalesce(source, '')) AS h,
                     coalesce(least(cap, max(CASE WHEN level <= cap_level THEN level END) OVER () * weight), cap) AS target FROM l),
        o AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
                     ((instr('0123456789abcdef', substr(h, 1, 1)) - 1) * 4096 + (instr('0123456789abcdef', substr(h, 2, 1)) - 1) * 256
                      + (instr('0123456789abcdef', substr(h, 3, 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, 4, 1)) - 1)::DOUBLE / 65536.0::DOUBLE AS offs FROM t),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), own)::DOUBLE AS i FROM d)
        SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
               ((floor(offs + rate * i) - floor(offs + rate * (i - 1.0))) * size)::BIGINT AS taken
        FROM n JOIN o ON n.source IS NOT DISTINCT FROM o.source"""
}
