"""The prefix trie of rebuilt conversations, by partition refinement.

Conversation c is rebuilt from the first turns of conversation c - c % ``FAMILY`` and its own
later ones.  Conversations that begin with the same turns (role and text) share nodes.

Refinement starts with one class, all conversations at the root, and splits the classes
that have several members by their next turns.  A round takes as many turns as all
rounds before it and one more, at most ``STRIDE``, and reads those only: a task chains the
digests of a member's turns of that stretch to the class it was in, equal chains are a
class at each depth, and its smallest member names it.  A class of one member is retired:
the rest of that conversation is a chain of nodes with one child each, made from its turns at
once.  So the number of rounds follows the longest beginning that two conversations share,
and what has been told apart is not looked at again.

Folding back needs no walk over the levels.  A node belongs to its smallest member, and lies
in the subtree of another node just if that member is a member there, too, and it is not
higher.  So what a conversation owns is added up from its end (by stretches, then inside
each), and a node's sums over its subtree are sums over its members; these are added up
before they are shuffled, so a node that a third of all conversations share is no large group.

The ids for a node's digest are sorted by ranges, joined in pieces of ``IDS`` ids and only
then put one after the other, so no task holds all ids of a node.

Turns are digests of 16 bytes from the start (SHA-256, role and text kept apart), so texts
are read once and never shuffled.

Defined cases: null role or text is empty; turns of one number are in order of their digests,
and repeated rows are turns like others; a null turn comes first; rows with a null conv_id
belong to no conversation; other columns, whatever their names, are not read; texts of any
length are one turn; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, load, written

#: A conversation begins as the one whose id is the multiple of FAMILY towards zero; heads have up to HEADS - 1 turns.
FAMILY, HEADS = 20, 4
#: Turns of a round at most; turns of a conversation that are numbered together; ids of a piece.
STRIDE, NUMBERED, IDS = 1024, 4096, 1000
EMPTY = hashlib.sha256(b"").hexdigest()


def digest(role: Column, text: Column) -> Column:
    """16 bytes for a turn; the length of the role keeps it apart from the text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, words: turns in order, numbered by stretches of turn numbers and inside each."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.floor(F.col("turn") / NUMBERED).alias("stretch"), digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    held = rows.groupBy(F.col("conv_id").alias("c"), F.col("stretch").alias("s")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("c", "s", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "stretch").orderBy(F.asc_nulls_first("turn"), "digest"))
    rows = rows.withColumn("inside", inside).join(held, (F.col("conv_id") == F.col("c")) & F.col("stretch").eqNullSafe(F.col("s")))
    return rows.select("conv_id", (F.col("before") + F.col("inside")).alias("pos"), "digest", "words")


def band(pos: Column) -> Column:
    """The round that looks at a turn: 1, 2, 4, ... turns each, and STRIDE turns from there on."""
    return F.when(pos < 2 * STRIDE, F.length(F.bin(pos)) - 1).otherwise(F.length(F.bin(F.lit(STRIDE))) + F.floor(pos / STRIDE) - 2).cast("int")


def last_of(k: int) -> int:
    """The last turn of a round."""
    top = STRIDE.bit_length() - 1
    return (2 << k) - 1 if k <= top else STRIDE * (k - top + 2) - 1


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, words, band) of all rebuilt turns, and (conv_id, len) of all conversations."""
    own = written(numbered(turns), "trie-turns")
    n = own.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = n.withColumns({"from": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS})
    first = n.select(F.col("conv_id").alias("from"), F.col("n").alias("from_n"))
    convs = convs.join(first, "from", "left").withColumn("head", F.least("h", F.coalesce("from_n", F.lit(0))))
    convs = written(convs.select("conv_id", "from", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-conversations")
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "from")
    begin = convs.join(heads, "from").where("pos <= h").select("conv_id", "pos", "digest", "words")
    rest = own.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "words")
    out = written(begin.unionByName(rest).withColumn("band", band(F.col("pos"))), "trie-rebuilt", by="band")
    discard(own)
    return out, convs.select("conv_id", "len")


def chained(rows: DataFrame) -> DataFrame:
    """rows (conv_id, cls, turns) -> conv_id, pos, words, chain: what a conversation said up to pos since it was in cls."""

    def run(batches):
        for batch in batches:
            ids, at, words, chain = [], [], [], []
            for row in batch.to_pylist():
                so_far = hashlib.sha256(str(row["cls"]).encode())
                for turn in row["turns"]:
                    so_far.update(turn["digest"])
                    ids.append(row["conv_id"])
                    at.append(turn["pos"])
                    words.append(turn["words"])
                    chain.append(so_far.digest()[:16])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(words, pa.int64()), pa.array(chain, pa.binary())], ["conv_id", "pos", "words", "chain"])

    return rows.mapInArrow(run, "conv_id long, pos long, words long, chain binary")


def refined(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, pos, band, words, rep, n: the class (its smallest member, its size) of conversations at every depth up to that where they are retired."""
    root = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).first()
    parts = [convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(-1).alias("band"), F.lit(0).cast("long").alias("words"), F.lit(root["rep"]).cast("long").alias("rep"), F.lit(root["n"]).alias("n"))]
    active, k = convs.where(F.lit(root["n"] > 1)).select("conv_id", F.lit(root["rep"]).cast("long").alias("cls")), 0
    while True:
        turn = F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns")
        stretch = turns.where(F.col("band") == k).join(active, "conv_id").groupBy("conv_id", "cls").agg(turn)
        rows = written(chained(stretch), "trie-chains")
        if rows.isEmpty():
            discard(rows)
            break
        classes = rows.groupBy("pos", "chain").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
        parts.append(written(rows.join(classes, ["pos", "chain"]).select("conv_id", "pos", F.lit(k).alias("band"), "words", "rep", "n"), "trie-classes"))
        discard(rows)
        active = parts[-1].where((F.col("pos") == last_of(k)) & (F.col("n") > 1)).select("conv_id", F.col("rep").alias("cls"))
        k += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def joined_digests(ends: DataFrame) -> DataFrame:
    """ends (pos, rep, conv_id) -> pos, rep, ends_sha256 of each node's ids in ascending order."""

    def pieces(batches):
        held, node, first = [], None, None
        made: list = []

        def flush():
            if held:
                made.append((*node, first, ",".join(map(str, held))))
                held.clear()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], pa.int64()) for i in range(3)] + [pa.array([m[3] for m in made], pa.string())], ["pos", "rep", "first", "ids"])
            made.clear()
            return out

        for b in batches:
            for pos, rep, i in zip(*(b.column(c).to_pylist() for c in ("pos", "rep", "conv_id")), strict=True):
                if (pos, rep) != node or len(held) >= IDS:
                    flush()
                    node, first = (pos, rep), i
                held.append(i)
            yield batch()
        flush()
        yield batch()

    def hashed(batches):
        node, so_far = None, None
        for b in batches:
            done = []
            for pos, rep, ids in zip(*(b.column(c).to_pylist() for c in ("pos", "rep", "ids")), strict=True):
                if (pos, rep) == node:
                    so_far.update(b",")
                else:
                    if node:
                        done.append((*node, so_far.hexdigest()))
                    node, so_far = (pos, rep), hashlib.sha256()
                so_far.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["pos", "rep", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([so_far.hexdigest()])], ["pos", "rep", "ends_sha256"])

    key = ["pos", "rep", "conv_id"]
    part = ends.select(key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(pieces, "pos long, rep long, first long, ids string")
    return part.repartition("pos", "rep").sortWithinPartitions("pos", "rep", "first").mapInArrow(hashed, "pos long, rep long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (turns: conv_id, turn, role, text)."""
    said, convs = rebuilt(turns)
    classes = refined(said, convs)
    last = classes.groupBy("conv_id").agg(F.max("pos").alias("last"))
    convs = written(convs.join(last, "conv_id"), "trie-retired")
    node = ["pos", "rep"]
    is_rep = F.col("conv_id") == F.col("rep")

    owned = classes.withColumn("own", F.when(is_rep, (F.col("n") - 1) * F.col("words")).otherwise(0))
    later = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    after = owned.groupBy("conv_id", "band").agg(F.sum("own").alias("s")).select("conv_id", "band", F.coalesce(F.sum("s").over(later), F.lit(0)).alias("after"))
    from_here = F.sum("own").over(Window.partitionBy("conv_id", "band").orderBy(F.desc("pos")))
    members = owned.withColumn("from_here", from_here).join(after, ["conv_id", "band"]).withColumn("saved", F.col("from_here") + F.col("after")).join(convs, "conv_id")
    members = written(members.select("conv_id", "pos", "rep", "n", "saved", "len", "last"), "trie-members")

    longest = members.groupBy(*node).agg(F.max("len").alias("longest"))
    leaf = members.where(is_rep & (F.col("pos") == F.col("len"))).join(longest, node).where("longest = pos").select("conv_id")
    leaf = leaf.unionByName(convs.where("len > last").select("conv_id")).withColumn("leaf", F.lit(1))
    sums = members.join(leaf, "conv_id", "left").groupBy(*node).agg(F.max("n").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    above = members.select(F.col("conv_id").alias("rep"), (F.col("pos") + 1).alias("pos"), F.col("rep").alias("parent"))
    nodes = members.where(is_rep).select("pos", "rep", "len").join(above, node, "left")
    nodes = written(nodes.join(sums, node), "trie-nodes")
    children = nodes.where("pos > 0").groupBy((F.col("pos") - 1).alias("pos"), F.col("parent").alias("rep")).agg(F.count("*").alias("children"))
    ends = joined_digests(members.where((F.col("pos") == F.col("len")) & (F.col("n") > 1)))

    own_end = lambda c: F.when(F.col("pos") == F.col("len"), F.sha2(c.cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    one = F.col("n_convs") == 1
    goes_on = (F.col("pos") < F.col("len")).cast("long")
    shared = nodes.join(children, node, "left").join(ends, node, "left").select(
        F.col("rep").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.when(one, goes_on).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.when(one, own_end(F.col("rep"))).otherwise(F.coalesce("ends_sha256", F.lit(EMPTY))).alias("ends_sha256"),
    )
    number = lambda v, name: F.lit(v).cast("long").alias(name)
    chains = said.select("conv_id", "pos").join(convs, "conv_id").where("pos > last").select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), number(1, "n_convs"), goes_on.alias("n_children"), number(1, "n_leaves"), number(0, "saved_tokens"), own_end(F.col("conv_id")).alias("ends_sha256")
    )
    return shared.unionByName(chains)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))


SQL = {
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id, turn, substr(sha256(strlen(r)::VARCHAR || ':' || r || x), 1, 32) AS dig, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words
                   FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations) WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 20 AS p, conv_id::VARCHAR AS s, list(dig ORDER BY turn NULLS FIRST, dig) AS d, list(words ORDER BY turn NULLS FIRST, dig) AS w FROM t GROUP BY conv_id),
        z AS (SELECT *, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ascii(s[i])::UBIGINT)), lambda a, b:
                  list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: 0::UBIGINT)), lambda y, k: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT) % 4)::INT AS h FROM c),
        r AS (SELECT z.conv_id, list_concat(coalesce(list_slice(b.d, 1, z.h), []), list_slice(z.d, z.h + 1, len(z.d))) AS d,
                     list_concat(coalesce(list_slice(b.w, 1, z.h), []), list_slice(z.w, z.h + 1, len(z.w))) AS w FROM z LEFT JOIN c b ON b.conv_id = z.p),
        m AS (SELECT conv_id, depth, array_to_string(list_slice(d, 1, depth), '') AS path, coalesce(w[depth], 0) AS words, len(d) AS turns
              FROM r, unnest(range(0, len(d) + 1)) u(depth)),
        n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, max(turns) = depth AS leaf,
                     sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256 FROM m GROUP BY path, depth),
        up AS (SELECT left(path, 32 * above) AS path, above, depth, leaf, n_convs, words FROM n, unnest(range(0, depth + 1)) u(above)),
        s AS (SELECT path, count(*) FILTER (WHERE depth = above + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM up GROUP BY path)
        SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN s ON s.path = n.path LEFT JOIN n q ON q.depth = n.depth - 1 AND q.path = left(n.path, 32 * (n.depth - 1))"""
}
