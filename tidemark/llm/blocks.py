"""Documents as blocks of word numbers, and an exchange of keys between blocks and shards.

Some operators need, for every n-gram of every document, something that only the whole
corpus tells, such as how often it stands there.  As rows these would be many times the
corpus.  Here a task turns a bounded number of documents into one block: the distinct
words, and a number for each word.  A block's distinct keys go, packed, to the shards
into which a hash of the keys deals them, and each shard answers every block in the same
order.  A key that is very common costs one entry for each block.

A block sends at most ``FAN`` pieces, so a piece holds thousands of keys however large the
corpus is.  Where there are more shards than that, pieces that go the same way are merged
into rows as large as a block and dealt again, ``FAN`` ways at each level, and the answers
come back the same way.  Equal keys are added up where they are merged, so a very common key is
one entry for each merged row, and what merges go to one range is split among tasks.  So what is sent for a document grows with the number of levels,
the logarithm of the number of shards, and not with that number.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

#: Words of a block, and keys of a shard.  A longer document is a block of its own.
BLOCK_WORDS, SHARD_KEYS = 400_000, 1_000_000
#: Pieces into which a block's keys are dealt at most, and keys of a row of merged pieces.
FAN, MERGED_KEYS = 512, 400_000
#: Shards of the last level whose keys one task merges, about.
MERGED_SHARDS = 64
#: The "row" under which a shard reports about itself.
REPORT = -1
PIECES = "row long, shard long, n long, data binary"
ANSWERS = "row long, shard long, keys long, total long, replies binary"
SCHEMA = "block long, ids array<long>, lengths binary, words binary, vocabulary binary, n_words long, texts binary"


def planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, the high ones left out while they are zero."""
    raw = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    used = max([k + 1 for k in range(8) if raw[k].any()], default=0)
    return bytes([used]) + zstandard.compress(raw[:used].tobytes(), 1)


def unplanes(data: bytes, n: int) -> np.ndarray:
    raw = np.zeros((8, n), np.uint8)
    raw[: data[0]] = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(np.uint64)


class Block:
    """ids: of the documents; lengths: words in each; words: numbers into vocabulary, a list of bytes."""

    def __init__(self, row: dict):
        self.ids, self.number = row["ids"], row["block"]
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.words = unplanes(row["words"], int(self.lengths.sum())).astype(np.uint32)
        vocabulary = zstandard.decompress(row["vocabulary"])
        self.vocabulary = vocabulary.split(b"\n") if vocabulary else []
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        return own[self.words]

    def document(self) -> np.ndarray:
        """The place of each word's document."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x (Stafford's variant 13)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each place; the last n - 1 places are left out."""
    with np.errstate(over="ignore"):
        x = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for j in range(n):
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(x)]) if n <= 8 else x * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + len(x)] ^ (h[j : j + len(x)] >> np.uint64(29)))
    return mixed(x)


def within(block: Block, n: int) -> np.ndarray:
    """Places at which n words of one document start."""
    keep = np.zeros(len(block.words) + 1, np.int32)
    long = block.lengths >= n
    np.add.at(keep, block.starts[long], 1)
    np.add.at(keep, block.ends[long] - n + 1, -1)
    return np.flatnonzero(np.cumsum(keep[:-1]) > 0)


def blocks(docs: DataFrame, id_col: str, text_col: str, lower: bool = False) -> DataFrame:
    """The documents as a written table of blocks.  Null text has no words.

    texts: a 64-bit hash of each document's words in their order.
    """

    def numbered() -> defaultdict:
        """Gives each word that is looked up the next number."""
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        return known

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        known = numbered()
        ids: list = []
        parts: list = []
        texts: list = []
        held = 0

        def flush():
            nonlocal known, ids, parts, texts, held, made
            row = {
                "block": (task << 32) + made,
                "ids": ids,
                "lengths": np.array([len(p) for p in parts], np.uint32).tobytes(),
                "words": planes(np.concatenate(parts)),
                "vocabulary": zstandard.compress(b"\n".join(known), 1),
                "n_words": held,
                "texts": np.array(texts, np.uint64).tobytes(),
            }
            known, ids, parts, texts, held, made = numbered(), [], [], [], 0, made + 1
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema)

        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("vocabulary", pa.binary()), ("n_words", pa.int64()), ("texts", pa.binary())])
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer()
                raw = bytes(raw) if raw is not None else b""
                words = (raw.lower() if lower else raw).split()
                if held and held + len(words) > BLOCK_WORDS:
                    yield flush()
                ids.append(i)
                parts.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
                texts.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                held += len(words)
                if len(ids) >= 50_000:
                    yield flush()
        if ids:
            yield flush()

    return written(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA), "blocks")


def rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k].as_py() for j, name in enumerate(batch.schema.names)}


HEAD = "<?II"


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers, one or several to a row; one that ascends is stored by its gaps."""
    out = []
    for c in columns:
        wide = c.shape[1] if c.ndim > 1 else 0
        c = c.astype(np.uint64).reshape(-1)
        up = bool(not wide and len(c) > 1 and (c[1:] >= c[:-1]).all())
        body = planes(np.diff(c, prepend=np.uint64(0)) if up else c)
        out.append(struct.pack(HEAD, up, wide, len(body)) + body)
    return b"".join(out)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        up, wide, size = struct.unpack_from(HEAD, data, at)
        at += struct.calcsize(HEAD)
        c = unplanes(data[at : at + size], n * max(1, wide))
        out.append(np.cumsum(c, dtype=np.uint64) if up else c.reshape(n, wide) if wide else c)
        at += size
    return out


class Route:
    """Which shard each key goes to, at one level: hash_of(columns) is dealt into ``fan`` equal ranges."""

    def __init__(self, hash_of: Callable, shards: int, level: int = 0):
        self.hash_of, self.shards, self.level, self.fan = hash_of, shards, level, min(shards, FAN)

    def below(self) -> Route:
        return Route(self.hash_of, -(-self.shards // FAN), self.level + 1)

    def number(self) -> int:
        """How many shards there are at the last level."""
        return self.fan * (self.below().number() if self.shards > FAN else 1)

    def shard(self, columns: list[np.ndarray]) -> np.ndarray:
        h = self.hash_of(columns)
        if self.level:
            with np.errstate(over="ignore"):
                h = mixed(h + np.uint64(self.level))
        return ((h >> np.uint64(32)) * np.uint64(self.fan) >> np.uint64(32)).astype(np.int64)

    def pieces(self, row: int, above: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        shard = self.shard(columns)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.fan + 1))
        columns = [c[order] for c in columns]
        some = np.flatnonzero(np.diff(cuts))
        data = [pack([c[cuts[k] : cuts[k + 1]] for c in columns]) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row)), pa.array(above * self.fan + some), pa.array(np.diff(cuts)[some]), pa.array(data, pa.binary())], ["row", "shard", "n", "data"])

    def returned(self, parts, columns: list[np.ndarray], above: int = 0) -> list[np.ndarray]:
        """The answers to the keys in these columns, in their order; none if there are no keys."""
        shard = self.shard(columns)
        order, sizes = np.argsort(shard, kind="stable"), np.bincount(shard, minlength=self.fan)
        replies = {p["shard"] - above * self.fan: p["replies"] for p in parts or []}
        got = [unpack(replies[k], int(sizes[k])) for k in np.flatnonzero(sizes).tolist()]
        out = []
        for column in zip(*got, strict=True):
            out.append(np.empty(len(order), np.uint64))
            out[-1][order] = np.concatenate(column)
        return out


def exchange(table: DataFrame, request: Callable, route: Route, answer: Callable, label: str, keys: int = 0) -> DataFrame:
    """Answers to what blocks ask: row (the block), shard and replies, for with_replies() and Route.returned().

    request(row of a block) -> columns of numbers that hold the block's distinct keys and what it
    tells of them; answer(columns, shard) -> (columns of replies, keys, total, report), for
    all that reaches a shard.  The last three are kept in a row of their own (REPORT).

    keys: how many of the first columns are the key, if equal keys may be added up on the way: the
    column after them is a count, and further ones are the same for equal keys.  With 0
    all entries reach their shard.
    """

    def spread(batches):
        for row in rows_of(batches):
            yield route.pieces(row["block"], 0, request(row))

    return answered(table.mapInArrow(spread, PIECES), route, answer, label, keys)


def answered(sent: DataFrame, route: Route, answer: Callable, label: str, keys: int) -> DataFrame:
    if route.shards > FAN:
        return answered_below(sent, route, answer, label, keys)

    def serve(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        columns = [np.concatenate(c) for c in zip(*(unpack(d.as_py(), k) for d, k in zip(rows.column("data"), n.tolist(), strict=True)), strict=True)]
        shard = rows.column("shard")[0].as_py()
        replies, n_keys, total, report = answer(columns, shard)
        ends = np.cumsum(n)
        data = [pack([r[a:b] for r in replies]) for a, b in zip(ends - n, ends, strict=True)]
        none = [None] * len(n)
        return pa.table(
            {
                "row": pa.array([*rows.column("row").to_pylist(), REPORT], pa.int64()),
                "shard": pa.array([shard] * (len(n) + 1), pa.int64()),
                "keys": pa.array([*none, n_keys], pa.int64()),
                "total": pa.array([*none, total], pa.int64()),
                "replies": pa.array([*data, report], pa.binary()),
            }
        )

    return written(sent.groupBy("shard").applyInArrow(serve, ANSWERS), label)


def answered_below(sent: DataFrame, route: Route, answer: Callable, label: str, keys: int) -> DataFrame:
    """The same by way of rows that merge what goes to one range of shards."""
    below = route.below()

    def merge(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: list[dict] = []

        def flush():
            nonlocal made
            columns = [np.concatenate(c) for c in zip(*(unpack(r["data"], r["n"]) for r in held), strict=True)]
            which = None
            if keys:
                at, total, which = totals(columns[:keys], columns[keys])
                columns = [total if k == keys else c[at] for k, c in enumerate(columns)]
                which = pack([which])
            row = {"row": (task << 32) + made, "shard": held[0]["shard"], "members": [r["row"] for r in held], "sizes": [r["n"] for r in held], "n": len(columns[0]), "data": pack(columns), "which": which}
            made += 1
            held.clear()
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema)

        schema = pa.schema([("row", pa.int64()), ("shard", pa.int64()), ("members", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("data", pa.binary()), ("which", pa.binary())])
        for row in rows_of(batches):
            if held and (row["shard"] != held[0]["shard"] or sum(r["n"] for r in held) + row["n"] > MERGED_KEYS):
                yield flush()
            held.append(row)
        if held:
            yield flush()

    def again(batches):
        for row in rows_of(batches):
            yield below.pieces(row["row"], row["shard"], unpack(row["data"], row["n"]))

    def back(batches):
        for row in rows_of(batches):
            replies = below.returned(row["parts"], unpack(row["data"], row["n"]), row["shard"])
            ends = np.cumsum(row["sizes"])
            if row["which"] is not None:  # to each entry what its key got
                which = unpack(row["which"], int(ends[-1]))[0].astype(np.int64)
                replies = [r[which] for r in replies]
            data = [pack([r[b - n : b] for r in replies]) for b, n in zip(ends, row["sizes"], strict=True)]
            none = pa.nulls(len(data), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(row["members"], pa.int64()), pa.array([row["shard"]] * len(data), pa.int64()), none, none, pa.array(data, pa.binary())], ["row", "shard", "keys", "total", "replies"])

    salts = -(-below.shards // MERGED_SHARDS)
    merged = sent.repartition("shard", F.pmod(F.xxhash64("row"), F.lit(salts))).sortWithinPartitions("shard")
    merged = written(merged.mapInArrow(merge, "row long, shard long, members array<long>, sizes array<long>, n long, data binary, which binary"), f"{label}-merged")
    got = answered(merged.select("row", "shard", "n", "data").mapInArrow(again, PIECES), below, answer, label, keys)
    out = with_replies(merged, {"parts": got}, "row").mapInArrow(back, ANSWERS).unionByName(got.where(F.col("row") == REPORT))
    out = written(out, label)
    discard(merged, got)
    return out


def with_replies(table: DataFrame, replies: dict[str, DataFrame], row: str = "block") -> DataFrame:
    """The blocks, each with its answers as arrays of (shard, replies), one column for each name."""
    out = table
    for name, df in replies.items():
        mine = df.where(F.col("row") != REPORT).select("row", "shard", "replies").groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("shard", "replies")).alias(name))
        out = out.join(mine, row, "left")
    return out


def joined(keys: list[np.ndarray]) -> list[np.ndarray]:
    """The same keys, in the same order, in fewer columns where the bits of two fit into one."""
    out = []
    for k in keys:
        k = k.astype(np.uint64)
        width = int(k.max()).bit_length() if len(k) else 0
        if out and int(out[-1].max() if len(k) else 0).bit_length() + width <= 64 and width < 64:
            out[-1] = (out[-1] << np.uint64(width)) | k
        else:
            out.append(k)
    return out


def totals(keys: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of one entry of each distinct key in order of keys, its total count, each entry's key number)."""
    keys = joined(keys)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    total = np.add.reduceat(count[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[first], total, which


def corpus_counts(columns: list[np.ndarray], shard: int):
    """An answer to (keys, counts): each key's count over all blocks."""
    _, total, which = totals(columns[:1], columns[1])
    return [total[which].astype(np.uint64)], int((total > 0).sum()), int(total.sum()), None


def word_hashes(block: Block, *others: bytes) -> np.ndarray:
    """A hash for each word of the vocabulary, and for other words."""
    words = [*block.vocabulary, *others]
    return mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def first_column(columns: list[np.ndarray]) -> np.ndarray:
    return columns[0]


def numbers(shards: int) -> Callable:
    """An answer that numbers a shard's words by how frequent they are: number and count of each."""

    def answer(columns, shard):
        at, total, which = totals(columns[:1], columns[1])
        rank = np.empty(len(total), np.int64)
        rank[np.lexsort((columns[0][at], -total))] = np.arange(len(total))
        return [(rank * shards + shard)[which], total[which]], int((total > 0).sum()), int(total.sum()), None

    return answer
