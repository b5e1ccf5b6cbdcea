"""An audit of how five document filters interact, in every order in which they can be applied.

Each document gets a mask of the conditions that it fails:

* A: fewer than 100 words; B: fewer than 80 distinct words to 100 words; C: more than one
  capital A to Z to ten code points; D: one of the marks ``#$%&*|``; these are columns;
* E: its text stands under a smaller id as well, found by partition refinement.

Refinement starts with one class for each text length and splits the classes by the hash of
one block of the text after the other, blocks growing ``GROWTH`` times each.  Classes of one
row are dropped after each split, so a row whose text is not repeated soon plays no part.
The hashes are taken while the statistics are, so the splits shuffle rows of a few numbers.
Only texts that survive all splits are compared in full.  Which they are is told to the second
reading by a bitmap of ``MEMBERS`` bits (8 MiB, whatever the table), one bit for each class;
the few other texts that its bits let through are compared as well and found to be alone.
Texts are grouped by class and by the text itself, copies being added up before the shuffle.
A class of one text marks its rows by its smallest id; if different texts ever meet in a
class, its rows are marked text by text.

Masks are then counted by part, and what every order of the filters keeps, removes and loses
at every step follows from these counts, at most 128 for a part.  A removal is credited
over all orders: of the filters that a document fails each comes first equally often.

Defined cases: null text is the empty text, which fails A only (and E as a repeat); null lang
is the part ""; a null id never fails E and makes no other row fail it; rows of one id and
text are no repeats of each other, and every row counts; several labels of an id count as one
that has each mark that any of them has, and a null id has none; other columns, whatever their names, are not
read; a text of any length is one row; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, discard, load, written

FILTERS = "ABCDE"
#: Code points of the first block of a text, how many times longer each next one is, and how many there are: more than a string can fill.
FIRST_BLOCK, GROWTH, BLOCKS = 256, 16, 7
COPY = 1 << FILTERS.index("E")
#: Bits of the map of classes that hold several rows, and bits of one of its rows (as bitmap_construct_agg makes them).
MEMBERS, ROW = 1 << 26, 1 << 15


def block_starts() -> list[int]:
    """Where each block begins, and where the last one ends."""
    return [sum(FIRST_BLOCK * GROWTH**j for j in range(k)) for k in range(BLOCKS + 1)]


def block_hashes(text: Column) -> list[Column]:
    """Hashes of the successive blocks of a text; 0 from where it has ended."""
    starts = block_starts()
    return [F.when(F.length(text) > a, F.xxhash64(F.substring(text, a + 1, min(b, (1 << 31) - 1) - a))).otherwise(F.lit(0).cast("long")) for a, b in zip(starts, starts[1:], strict=False)]


def conditions(text: Column) -> dict[str, Column]:
    """Which of A to D a text fails; never null."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeated(rows: DataFrame) -> DataFrame:
    """rows (n_chars, hashes): the classes n_chars, hashes that hold several rows after all splits."""
    left, last = rows.select("n_chars", "hashes"), None
    key = ["n_chars"]
    for k, start in enumerate([-1, *block_starts()]):
        if k and left.where(F.col("n_chars") > start).isEmpty():
            break
        if k:
            key.append(f"h{k}")
            left = left.withColumn(key[-1], F.col("hashes")[k - 1])
        several = left.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        left = written(left.join(several, key, "left_semi"), "audit-classes")
        if last is not None:
            discard(last)
        last = left
    out = written(left.select("n_chars", "hashes").distinct(), "audit-repeated")
    discard(left)
    return out


def likely(rows: DataFrame, classes: DataFrame, cls: list[str]) -> DataFrame:
    """The rows of these classes, and few others, without a shuffle of rows."""
    place = F.pmod(F.xxhash64(*cls), F.lit(MEMBERS))
    bit = F.pmod("place", F.lit(ROW)).cast("int")
    bits = classes.select(place.alias("place")).groupBy(F.floor(F.col("place") / ROW).alias("map_row")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    found = rows.withColumn("place", place).join(F.broadcast(bits), F.floor(F.col("place") / ROW) == F.col("map_row"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))).cast("int") % 2 == 1
    return found.where(is_set).select(rows.columns)


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic for every row; bit k of the mask is the filter FILTERS[k]."""
    cls = ["n_chars", "hashes"]
    whole = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    fails = [F.when(c, 1 << FILTERS.index(k)).otherwise(0) for k, c in conditions(F.col("t")).items()]
    whole = whole.withColumns({"n_chars": F.length("t"), "hashes": F.array(*block_hashes(F.col("t"))), "mask": sum(fails, F.lit(0)).cast("int")})
    rows = written(whole.drop("t"), "audit-rows")
    classes = repeated(rows)
    texts = likely(whole.select("id", "t", *cls), classes, cls).groupBy(*cls, "t").agg(F.min("id").alias("least"))
    least = written(texts.groupBy(*cls).agg(F.min("least").alias("least"), F.count("*").alias("n_texts")), "audit-least")
    marked = rows.join(least.where("n_texts = 1"), cls, "left").select("id", "part", "mask", "least")
    several = least.where("n_texts > 1").select(cls)
    if not several.isEmpty():  # different texts with equal hashes
        alone = rows.join(least, cls, "left").where("n_texts is null or n_texts = 1").select("id", "part", "mask", "least")
        marked = alone.unionByName(whole.join(several, cls, "left_semi").join(texts.join(several, cls, "left_semi"), [*cls, "t"]).select("id", "part", "mask", "least"))
    copy = F.when(F.col("id") > F.col("least"), COPY).otherwise(0)
    flags = labels.groupBy(F.col(id_col).alias("l_id")).agg(*[F.max(F.coalesce(F.col(k) == 1, F.lit(False))).alias(k) for k in ("quality", "toxic")])
    out = marked.select("id", "part", (F.col("mask") + copy).alias("mask")).join(flags, F.col("id") == F.col("l_id"), "left")
    return out.select("part", "mask", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    counts = masks(docs, labels, id_col, text_col, lang_col).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))
    counts = written(counts, "audit-counts")
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = {k: F.instr("filter_order", k) for k in FILTERS}
    bits = lambda used: sum((F.when(used(place[k]), 1 << FILTERS.index(k)).otherwise(0) for k in FILTERS), F.lit(0))
    steps = steps.withColumns({"own": bits(lambda p: p == F.col("step")), "before": bits(lambda p: p < F.col("step"))})
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")
    share = (F.col("n") * F.lit(len(list(permutations(FILTERS)))) / F.bit_count("mask")).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone, "n_good").alias("good_lost"),
        total(fails & ~gone, "n_toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = {
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
        f AS (SELECT doc_id, part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
                     100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
                     coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E,
                     doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM w),
        c AS (SELECT part, CASE WHEN A THEN 'A' ELSE '' END || CASE WHEN B THEN 'B' ELSE '' END || CASE WHEN C THEN 'C' ELSE '' END ||
                     CASE WHEN D THEN 'D' ELSE '' END || CASE WHEN E THEN 'E' ELSE '' END AS fails, count(*) AS n,
                     count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
              WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[:step - 1] AS earlier FROM o, unnest(range(1, 6)) u(step)),
        j AS (SELECT part, filter_order, step, own, fails, n, n_good, n_toxic, contains(fails, own) AS failing,
                     len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone FROM c, s),
        r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT failing AND NOT gone), 0) AS kept,
                     coalesce(sum(n) FILTER (WHERE failing AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE failing AND gone), 0) AS redundant,
                     coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails, coalesce(sum(n_good) FILTER (WHERE failing AND NOT gone), 0) AS good_lost,
                     coalesce(sum(n_toxic) FILTER (WHERE failing AND NOT gone), 0) AS toxic_lost FROM j GROUP BY ALL),
        v AS (SELECT part, own, sum(removed) AS shapley FROM r GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley FROM r JOIN v USING (part, own)"""
}
