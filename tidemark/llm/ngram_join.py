"""Near-duplicate documents by an exact Jaccard join over word shingles.

A document's set holds its distinct shingles of ``WORDS`` lower-cased words (a shorter
document is one shingle).  Documents whose sets meet the threshold are linked, and
linked documents form components.  Equal sets are one node from the start.

If two sets of sizes m and n meet the threshold, at most a quarter of either is missing
in the other.  So in any order of the shingles that all documents agree on, both sets
have a common shingle among their first size // 4 + 1.  Candidates must have one in each
of several orders:

* rarest first, by frequencies that are counted over the whole corpus.  It proposes the
  pairs: shingles that no other document has come first, so only documents that share
  three quarters of their shingles with others propose anything;
* by hash ascending, and by hash descending.

Pairs that pass are verified on the whole sets.  Only components are wanted, so a
proposing shingle first pairs its documents with a pivot, in two rounds; documents that
turn out to be in one component need no further pairs.  What then still lies in different
components is paired by the proposing shingles it shares: what two sets share is shared by
their prefixes or lies behind one of them, so a pair that shares too few is none.  The other two orders'
prefixes and then whole sets are compared for pairs only, by pairs of chunks of documents.  A shingle of very
many documents is joined with its pivot by a broadcast of the few such shingles, and with itself part by part.

Defined cases: null or empty text has no shingles, is linked with nothing and is its own
component; a text of any length is one set; a null id never is a component's name unless
all its documents have none; rows may repeat, also with the same id, and each is a document
of its own in components(); columns of any name pass through drop_near_duplicates; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import SHARD_KEYS, Block, Route, blocks, corpus_counts, exchange, first_column, mixed, ngrams, rows_of, totals, with_replies, within
from .shared import discard, load, written

WORDS, PIVOT_ROUNDS = 5, 2
#: Documents and shingles of a chunk whose pairs are compared, and documents that one is compared with at once.
CHUNK_DOCS, CHUNK_SHINGLES, COLUMNS = 512, 500_000, 4096
#: Documents of a part of a token that very many have.
TOKEN_DOCS = 1024
#: A token of more than one in so many postings is joined by a broadcast of at most so many rows.
HOT_SHARE = 1024
#: Rows of a small table, and shingles of sets, that one task writes, about.
TASK_ROWS, TASK_SHINGLES = 250_000, 1_000_000
#: Bits of a shingle's hash that propose a pair; a false meeting costs a comparison.
TOKEN_BITS = 44
CUT = np.uint64(2**64 - 2 ** (64 - TOKEN_BITS))


class Sets:
    """The shingle sets of a block: rows (doc, key), sorted, and what holds for each document.

    first: the documents that no other one equals word for word, or that stand for those that do.
    """

    def __init__(self, block: Block, first: np.ndarray):
        h, n_docs = block.hashes(), len(block.lengths)
        at = within(block, WORDS)
        docs, keys = [block.document()[at]], [ngrams(h, WORDS)[at] if len(h) >= WORDS else np.zeros(0, np.uint64)]
        for k in range(1, WORDS):
            short = np.flatnonzero(block.lengths == k)
            if len(short):
                docs.append(short)
                keys.append(ngrams(h, k)[block.starts[short]])
        doc, key = np.concatenate(docs), np.concatenate(keys)
        order = np.argsort(key)
        order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]  # a block has fewer documents
        doc, key = doc[order], key[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        self.doc, self.key = doc[new], key[new]
        self.size = np.bincount(self.doc, minlength=n_docs)
        self.ends = np.cumsum(self.size)
        total = np.zeros(n_docs + 1, np.uint64)
        with np.errstate(over="ignore"):
            cum = np.concatenate([[np.uint64(0)], np.cumsum(mixed(self.key), dtype=np.uint64)])
            total = cum[self.ends] - cum[self.ends - self.size]
            self.node = mixed(total ^ mixed(self.size.astype(np.uint64))).view(np.int64)
        self.slack = self.size // 4
        # what lies behind the prefix; all of the set where two shingles are one token, whose order is open
        same = np.zeros(n_docs, bool)
        same[self.doc[1:][(self.doc[1:] == self.doc[:-1]) & ((self.key[1:] & CUT) == (self.key[:-1] & CUT))]] = True
        self.rest = np.where(same, self.size, self.size - self.slack - 1)
        lead = np.zeros(n_docs, bool)  # of equal sets the first stands for all
        lead[first[np.unique(self.node[first], return_index=True)[1]]] = True
        self.rows = np.flatnonzero((lead & (self.size > 0))[self.doc])
        self.tokens = self.key[self.rows] & CUT

    def keys(self) -> list[np.ndarray]:
        return list(np.unique(self.tokens, return_counts=True))

    def prefixes(self, tokens: np.ndarray, frequency: np.ndarray):
        """(documents, tokens) that propose pairs, and how many tokens of each document recur.

        frequency: of tokens, the sorted distinct ones.
        """
        recurs = frequency[np.searchsorted(tokens, self.tokens)] if len(self.tokens) else frequency
        doc = self.doc[self.rows]
        common = np.bincount(doc[recurs > 1], minlength=len(self.size))
        left = self.slack + 1 - (self.size - common)
        some = (recurs > 1) & (left[doc] > 0)
        doc, token, recurs = doc[some], self.tokens[some], recurs[some]
        order = np.lexsort((token, recurs, doc))
        doc, token = doc[order], token[order]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        keep = place < left[doc]
        return doc[keep], token[keep], common


def lists(doc: np.ndarray, values: np.ndarray, present: np.ndarray) -> pa.Array:
    """For each document its values as a list, null where it is not present; doc ascends."""
    counts = np.bincount(doc, minlength=len(present))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    flat = pa.array(values.view(np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(~present))


def texts_of(row: dict) -> list[np.ndarray]:
    """Hashes of the distinct texts of a block, and the place of the first document with each."""
    return list(np.unique(np.frombuffer(row["texts"], np.uint64), return_index=True))


def first_of_equals(columns, shard):
    """1 for one of the blocks that ask for a key, 0 for the others."""
    (at, total, _), reply = totals(columns, np.ones(len(columns[0]), np.int64)), np.zeros(len(columns[0]), np.uint64)
    reply[at] = 1
    return [reply], len(total), int(total.sum()), None


def proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, block, node, size, common and rest for every document; for nodes that may have links also prefix and set."""
    table = blocks(docs, id_col, text_col, lower=True)
    total, n_docs = table.agg(F.sum("n_words"), F.sum(F.size("ids"))).first()
    first_of = Route(first_column, -(-(n_docs or 1) // SHARD_KEYS))
    firsts = exchange(table, lambda row: texts_of(row)[:1], first_of, first_of_equals, "firsts")
    table, plain = written(with_replies(table, {"firsts": firsts}), "blocks"), table
    discard(plain, firsts)
    route = Route(first_column, -(-((total or 0) + 1) // SHARD_KEYS))

    def sets(row: dict) -> Sets:
        keys, places = texts_of(row)
        mine = first_of.returned(row["firsts"], [keys])
        return Sets(Block(row), places[mine[0] > 0] if mine else places)

    def frequency(columns, shard):
        (total,), keys, every, report = corpus_counts(columns, shard)
        return [np.minimum(total, 255)], keys, every, report

    seen = exchange(table, lambda row: sets(row).keys(), route, frequency, "shingles", keys=1)

    def proposed(row: dict) -> pa.RecordBatch:
        s = sets(row)
        keys = s.keys()
        got = route.returned(row["seen"], keys)
        doc, token, common = s.prefixes(keys[0], got[0].astype(np.int64) if got else np.zeros(0, np.int64))
        present = np.bincount(doc, minlength=len(s.size)) > 0
        mine = present[s.doc]
        return pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(np.full(len(s.size), row["block"])), pa.array(s.node), pa.array(s.size), pa.array(common), pa.array(s.rest), lists(doc, token, present), lists(s.doc[mine], s.key[mine], present)],
            ["id", "block", "node", "size", "common", "rest", "prefix", "set"],
        )

    def run(batches):
        for row in rows_of(batches):
            yield proposed(row)

    out = written(with_replies(table, {"seen": seen}).mapInArrow(run, "id long, block long, node long, size long, common long, rest long, prefix array<long>, set array<long>"), "proposals")
    discard(table)
    discard(seen)
    return out


def by_token(left: DataFrame, right: DataFrame, hot: DataFrame | None) -> DataFrame:
    """left joined with right, which has one row for a token; the few hot tokens of right, if any, are broadcast."""
    if hot is None:
        return left.join(right, "token")
    few, others = right.join(F.broadcast(hot), "token", "left_semi"), right.join(F.broadcast(hot), "token", "left_anti")
    return left.join(F.broadcast(few), "token").unionByName(left.join(F.broadcast(hot), "token", "left_anti").join(others, "token"))


def merged(component: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    """component (node, comp) after linking; components point to their smallest neighbour until none is left.

    tasks: how many write each table at most, of which there are two for each step.
    """
    while True:
        at = lambda k: component.select(F.col("node").alias(k), F.col("comp").alias(f"{k}_comp"))
        open_links = links.join(at("a"), "a").join(at("b"), "b").where("a_comp != b_comp")
        ways = open_links.select(F.greatest("a_comp", "b_comp").alias("u"), F.least("a_comp", "b_comp").alias("v"))
        parent = written(ways.groupBy("u").agg(F.min("v").alias("p")), "parents", tasks=tasks)
        if parent.isEmpty():
            return component
        for _ in range(2):
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        component = written(component.join(parent.withColumnRenamed("u", "comp"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "components", tasks=tasks)


def fits():
    """Whether two sizes, and how much of each recurs at all, allow the threshold: shared >= 3/7 (m + n)."""
    return (4 * F.least("a_size", "b_size") >= 3 * F.greatest("a_size", "b_size")) & (7 * F.least("a_common", "b_common") >= 3 * (F.col("a_size") + F.col("b_size")))


def shared_with(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many keys of each of the others are in one; all are sorted."""
    if not len(one):
        return np.zeros(len(others), np.int64)
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.bincount(np.repeat(np.arange(len(others)), [len(x) for x in others])[hit], minlength=len(others))


def compared(group: pa.Table) -> pa.Table:
    """Those pairs of the group that share prefixes in both hash orders and meet the threshold on the whole sets."""
    docs, pairs = group.filter(group.column("node").is_valid()), group.filter(group.column("a").is_valid())
    lists = docs.column("set").combine_chunks()
    keys, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())
    node = docs.column("node").to_numpy()
    order = np.argsort(node)
    ends, sizes, node = ends[order], lists.value_lengths().to_numpy().astype(np.int64)[order], node[order]
    starts, most = ends - sizes, sizes // 4 + 1
    a, b = (np.searchsorted(node, pairs.column(k).to_numpy()) for k in "ab")
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    cuts = np.flatnonzero(np.diff(a, prepend=-1))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)], strict=True):
        x = int(a[first])
        for lo in range(first, last, COLUMNS):
            mine = b[lo : min(lo + COLUMNS, last)]
            for near in (lambda y: keys[starts[y] : starts[y] + most[y]], lambda y: keys[ends[y] - most[y] : ends[y]]):
                mine = mine[shared_with(near(x), [near(y) for y in mine]) > 0] if len(mine) else mine
            if len(mine):
                shared = shared_with(keys[starts[x] : ends[x]], [keys[starts[y] : ends[y]] for y in mine])
                mine = mine[100 * shared >= 75 * (sizes[x] + sizes[mine] - shared)]
                left.append(np.full(len(mine), x))
                right.append(mine)
    return pa.table({"a": node[np.concatenate(left)], "b": node[np.concatenate(right)]})


def checked(pairs: DataFrame, sets: DataFrame, chunks: int, tasks: int) -> DataFrame:
    """Those of the pairs (a, b) that share prefixes in both hash orders and meet the threshold, as a written table.

    Documents are dealt into chunks, those with the same least partner together, and the pairs of
    two chunks are compared in one task, which gets each document's set once, and none
    that is in no pair.  So sets are sent twice for a pair at most, and once for hundreds of pairs where many
    documents of a family are candidates of each other.
    """
    pairs = written(pairs.repartition(tasks), "candidates", tasks=tasks)
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    nodes = ends.groupBy("node").agg(F.min("other").alias("label")).join(sets.select("node", "size"), "node")
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK_DOCS), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    labels = nodes.groupBy("label").agg(parts.alias("parts"))
    chunk = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(3)), "parts")), F.lit(chunks))
    nodes = nodes.join(labels, "label").select("node", chunk.alias("chunk"))
    at = lambda k: nodes.select(F.col("node").alias(k), F.col("chunk").alias(f"{k}_chunk"))
    pairs = pairs.join(at("a"), "a").join(at("b"), "b")
    pairs = pairs.select(F.least("a_chunk", "b_chunk").alias("i"), F.greatest("a_chunk", "b_chunk").alias("j"), "a", "b")
    docs = pairs.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "set"), "node")
    rows = pairs.unionByName(docs, allowMissingColumns=True)
    return written(rows.groupBy("i", "j").applyInArrow(compared, "a long, b long").repartition(tasks), "links", tasks=tasks)


def candidates(at: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents of different components that fit and share enough tokens of their prefixes.

    What two documents share is shared by their prefixes or lies behind the prefix of one of them.
    Tokens of many documents are joined part by part.
    """
    many = at.groupBy("token").agg(F.ceil(F.count("*") / TOKEN_DOCS).cast("int").alias("parts")).where("parts > 1")
    at = at.join(many, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    at = at.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), "parts").cast("int"))

    def side(k: str, i: Column, j: Column) -> DataFrame:
        return at.select("token", i.alias("i"), j.alias("j"), *[F.col(c).alias(f"{k}_{c}") for c in ("node", "size", "common", "rest", "comp")])

    own = F.col("part")
    left, right = side("a", own, F.explode(F.sequence(own, F.col("parts") - 1))), side("b", F.explode(F.sequence(F.lit(0), own)), own)
    met = left.join(right, ["token", "i", "j"]).where("a_comp != b_comp and (i < j or a_node < b_node)").where(fits())
    least = F.ceil(3 * (F.col("a_size") + F.col("b_size")) / 7).cast("long") - F.greatest("a_rest", "b_rest")
    pairs = met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"), least.alias("least"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b")


def linked(found: DataFrame) -> DataFrame:
    """node, comp for every node that may have links."""
    some = found.where(F.col("prefix").isNotNull())
    n_postings, n_shingles = some.agg(F.sum(F.size("prefix")), F.sum("size")).first()
    # no table of nodes, tokens or links with pivots has more rows than there are postings
    tasks, set_tasks = -(-(n_postings or 1) // TASK_ROWS), -(-(n_shingles or 1) // TASK_SHINGLES)
    distinct = some.select("node", "size", "common", "rest", F.explode("prefix").alias("token"))
    distinct = written(distinct.distinct(), "postings", tasks=tasks)  # equal sets of several blocks propose the same
    shared = written(distinct.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "shared-tokens", tasks=tasks)
    # tokens of more than 1 / HOT_SHARE of the postings: at most HOT_SHARE of them
    hot = written(shared.where(F.col("n") > distinct.count() // HOT_SHARE).select("token"), "hot-tokens")
    if hot.isEmpty():
        hot = None
    active = written(by_token(distinct, shared.select("token"), hot), "shared-postings", tasks=tasks)
    discard(distinct, shared)
    owner = found.where(F.col("set").isNotNull()).groupBy("node").agg(F.min("block").alias("block"))
    owner = active.select("node").distinct().join(owner, "node")
    sets = written(found.where(F.col("set").isNotNull()).select("node", "block", "size", "set").join(owner, ["node", "block"]).select("node", "size", "set"), "sets", tasks=set_tasks)
    n_sets, n_shingles = sets.agg(F.count("*"), F.sum("size")).first()
    chunks = max(1, -(-n_sets // CHUNK_DOCS), -(-(n_shingles or 0) // CHUNK_SHINGLES))
    component = written(sets.select("node", F.col("node").alias("comp")), "components", tasks=tasks)
    parts = ("node", "size", "common", "comp")

    def tokens_between(k: int) -> tuple[DataFrame, DataFrame]:
        at = active.join(component, "node")
        pivot = F.min_by(F.struct(*parts), F.xxhash64("node", F.lit(k)))
        return at, at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), pivot.alias("pivot")).where("lo != hi").select("token", "pivot")

    for k in range(PIVOT_ROUNDS):
        at, open_tokens = tokens_between(max(0, k - 1))
        others = at.select("token", *[F.col(c).alias(f"b_{c}") for c in parts])
        pairs = by_token(others, open_tokens.select("token", *[F.col(f"pivot.{c}").alias(f"a_{c}") for c in parts]), hot)
        counts = pairs.where("a_comp != b_comp").where(fits()).groupBy(F.col("a_node").alias("a"), F.col("b_node").alias("b")).agg(F.count("*").alias("n"))
        if k == 0:  # each document with the pivot that it meets most often
            best = Window.partitionBy("b").orderBy(F.desc("n"), "a")
            counts = counts.withColumn("place", F.row_number().over(best)).where("place = 1")
        component = merged(component, checked(counts.select("a", "b"), sets, chunks, tasks), tasks)
    at = active.join(component, "node")
    # only documents that meet another one that fits can have a link left
    meets = at.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("common").alias("most")).where("lo != hi")
    at = by_token(at, meets.select("token", "most"), hot).where(7 * F.least("common", "most") >= 3 * F.col("size") * 1.75)
    at = written(at.drop("most"), "open-tokens", tasks=tasks)
    if not at.isEmpty():
        component = merged(component, checked(candidates(at), sets, chunks, tasks), tasks)
    discard(active, sets)
    return component


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id for every document."""
    found = proposals(docs, id_col, text_col)
    least = found.where("size > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = least.join(linked(found), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    name = named.groupBy("comp").agg(F.min("least").alias("name"))
    of_node = named.join(name, "comp").select("node", "name")
    rows = found.select("id", "node", "size").join(of_node, "node", "left")
    return rows.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, that with the smallest id, with all its columns.

    Rows of one id are documents of their own: each group keeps one row whatever ids its
    members share, and texts that are not linked all stay.  Of rows alike in id and text one
    stays, and a row without an id goes before no other.  Rows without words all stay.
    """
    repeated = docs.groupBy(F.col(id_col).alias("__tm_id")).agg(F.count("*").alias("__tm_rows"))
    repeated = written(repeated.where("__tm_rows > 1 or __tm_id is null").select("__tm_id"), "repeated-ids")
    if repeated.isEmpty():
        stays = components(docs.select(id_col, text_col), id_col, text_col)
        return docs.join(stays.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__tm_id")), F.col(id_col) == F.col("__tm_id"), "left_semi")
    # a row whose id does not name it gets a name from id and text, above any usual id
    name = F.shiftrightunsigned(F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col)), 2).bitwiseOR(F.lit(1 << 62))
    shared = F.col("__tm_id").isNotNull() | F.col(id_col).isNull()
    keyed = docs.join(repeated, F.col(id_col) == F.col("__tm_id"), "left").withColumn("__tm_name", F.when(shared, name).otherwise(F.col(id_col).cast("long")))
    keyed = written(keyed.drop("__tm_id").withColumn("__tm_shared", F.col("__tm_name") >= 1 << 62), "named")
    found = written(components(keyed.select("__tm_name", text_col), "__tm_name", text_col).distinct(), "named-components")
    ids = keyed.select("__tm_name", F.col(id_col).alias("__tm_id")).distinct()
    first = F.min_by("__tm_name", F.struct(F.col("__tm_id").isNull(), "__tm_id", "__tm_name")).alias("__tm_name")
    stays = found.where("n_shingles > 0").join(ids, "__tm_name").groupBy("component_id").agg(first).select("__tm_name")
    worded = found.where("n_shingles > 0").select("__tm_name")
    kept = keyed.join(stays, "__tm_name", "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    alike = kept.where("__tm_shared").groupBy("__tm_name").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("__tm_row")).select("__tm_row.*")
    wordless = keyed.join(worded, "__tm_name", "left_anti")
    return kept.where("not __tm_shared").select(docs.columns).unionByName(alike).unionByName(wordless.select(docs.columns))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(load(spark, sf_dir, "documents"))


SQL = {
    "op10_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        place AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS x FROM place),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        pair AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * k >= 75 * (x.n + y.n - k)),
        ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id
        FROM d JOIN reach ON d.r = reach.a JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n.n"""
}
