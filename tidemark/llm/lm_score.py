"""Language-model scores from an Elias-Fano n-gram trie of the training corpus.

Every word gets a number (blocks.exchange), small for frequent words; words are told apart by
64-bit hashes, so two words share a number only if their hashes are equal.
The distinct pairs, and then the triples, of each block of documents are sent to the shards
that hold the trie's second and third level, dealt by a hash of context and next word, so
that the successors of a very common context lie in many shards.  A shard adds up how often
each n-gram stands in training documents and compiles those that do into its part of the
trie: the distinct first words, then for each level the sorted successors of each context,
shifted by the end of the context before so that a level is one increasing sequence in
Elias-Fano form, increasing pointers to the next level in the same form, and quantised
probabilities at the last.  A part is one buffer and is used as mapped views on it; it can
be kept in the shared folder.  Every n-gram of every document,
held out or not, is looked up there: a context's successor is found by searching its shifted
word in the level's sequence.

Smoothing: with c counts, P1(z) = (c(z) + 0.5) / (N + 0.5 (V + 1)), the same as the base
score; P2(z|y) = (c(yz) + a P1(z)) / (c(y) + a); P3(z|xy) = (c(xyz) + b P2(z|y)) / (c(xy) + b).
The trie holds the first part of each sum, c(yz) / (c(y) + a) or c(xyz) / (c(xy) + b).
Every text ends with an end token, and n-grams do not cross texts.

Defined cases: null or empty text is the end token alone; a text of any length is one row;
a null id is held out; a word never seen in training gets the probability of one unseen
word; without training documents every probability is that of one unseen word among none;
rows may repeat, and each counts; other columns, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import REPORT, SHARD_KEYS, Block, Route, blocks, exchange, first_column, mixed, numbers, pack, planes, rows_of, totals, unpack, unplanes, with_replies, word_hashes
from .shared import discard, load, written

#: Smoothing masses; the README says how they were chosen.
PAIR_MASS, TRIPLE_MASS = 2000.0, 10.0
STEP = 1 / 4096  # of quantised log10 values
STRETCH = 1 << 17  # n-grams that are looked up at a time
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width numbers one after the other in 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.int64) * width
        shift = (at & 63).astype(np.uint64)
        word = at >> 6
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
        if len(first):
            out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        spill = (shift + np.uint64(width)) > 64  # at most one value of a word
        out[word[spill] + 1] |= values[spill] >> (np.uint64(64) - shift[spill])
    return out


def read_bits(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * width
    shift = (at & 63).astype(np.uint64)
    low = words[at >> 6] >> shift
    high = np.where(shift > 0, words[(at >> 6) + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


#: Place of the k-th one in each byte.
SELECT = np.argsort(~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool), axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """An increasing sequence: low bits at fixed width, high bits in unary with a count for each byte."""

    def __init__(self, values: np.ndarray, store):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, ((top + 1) // max(self.n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        self.buckets = (top >> self.width) + 1
        bits = np.zeros((self.n + self.buckets) // 8 * 8 + 16, np.uint8)
        bits[high + np.arange(self.n)] = 1
        packed = np.packbits(bits, bitorder="little")
        count = np.bitwise_count(packed).astype(np.int64)
        self.low = store(pack_bits(values & np.uint64((1 << self.width) - 1), self.width))
        self.high = store(packed)
        self.before = store((np.cumsum(count) - count).astype(np.uint32))

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero among the high bits."""
        before = self.before if ones else np.arange(len(self.before), dtype=np.uint32) * np.uint32(8) - self.before
        byte = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        raw = self.high[byte] if ones else ~self.high[byte]
        return byte * 8 + SELECT[raw, k - before[byte]]

    def get(self, index: np.ndarray) -> np.ndarray:
        high = (self._select(index, True) - index).astype(np.uint64)
        return (high << np.uint64(self.width)) | read_bits(self.low, self.width, index)

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value, or -1: the values of one high part are searched by their low bits."""
        bucket = (value >> np.uint64(self.width)).astype(np.int64)
        inside = np.flatnonzero(bucket < self.buckets)
        out = np.full(len(value), -1)
        if not self.n or not len(inside):
            return out
        b = bucket[inside]
        lo = np.zeros(len(inside), np.int64)
        some = b > 0
        lo[some] = self._select(b[some] - 1, False) - (b[some] - 1)
        end = self._select(b, False) - b
        low = value[inside] & np.uint64((1 << self.width) - 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = read_bits(self.low, self.width, mid) < low[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        there = np.flatnonzero(lo < end)
        there = there[read_bits(self.low, self.width, lo[there]) == low[there]]
        out[inside[there]] = lo[there]
        return out


class Level:
    """Successors of the contexts of a level, with values for each of them."""

    def __init__(self, context: np.ndarray, word: np.ndarray, contexts: int, store, **values):
        sizes = np.bincount(context, minlength=contexts)
        pointer = np.concatenate([[0], np.cumsum(sizes)])
        last = np.zeros(contexts, np.int64)
        last[sizes > 0] = word[pointer[1:][sizes > 0] - 1] + 1
        shift = np.cumsum(last) - last
        self.pointer = EliasFano(pointer, store)
        self.words = EliasFano((word + shift[context]).astype(np.uint64), store)
        for k, v in values.items():
            setattr(self, k, store(v))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of the word among the successors of the context, or -1 (also for context -1)."""
        out = np.full(len(context), -1)
        for at in range(0, len(context) if self.words.n else 0, STRETCH):
            known = at + np.flatnonzero(context[at : at + STRETCH] >= 0)
            if len(known):
                out[known] = self._find(context[known].astype(np.int64), word[known].astype(np.uint64))
        return out

    def _find(self, context, word):
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))  # a context's words are asked for together
        times = np.diff(np.append(first, len(context)))
        start = self.pointer.get(context[first]).astype(np.int64)
        end = self.pointer.get(context[first] + 1).astype(np.int64)
        shift = np.zeros(len(first), np.uint64)
        inner = start > 0  # the context's words begin after the last value before them
        shift[inner] = self.words.get(start[inner] - 1) + np.uint64(1)
        at = self.words.find(word + np.repeat(shift, times))
        return np.where((at >= np.repeat(start, times)) & (at < np.repeat(end, times)), at, -1)


def quantised(x: np.ndarray) -> np.ndarray:
    """Negative base-10 logarithms in steps."""
    return np.clip(np.rint(-np.log10(x) / STEP), 0, 65534).astype(np.uint16)


class Buffer:
    """Arrays one after the other in one buffer, each at a multiple of eight bytes."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.size = 0

    def __call__(self, array: np.ndarray) -> tuple:
        place = (self.size, array.dtype.str, len(array))
        raw = array.tobytes()
        self.parts.append(raw + bytes(-len(raw) % 8))
        self.size += len(self.parts[-1])
        return place


def mapped(thing, buffer: bytes):
    """Replaces the places of arrays in a part of the trie by views on its buffer."""
    for name, value in vars(thing).items():
        if isinstance(value, tuple):
            setattr(thing, name, np.frombuffer(buffer, value[1], value[2], value[0]))
        elif isinstance(value, (EliasFano, Level)):
            mapped(value, buffer)
        elif isinstance(value, list):
            for x in value:
                mapped(x, buffer)
    return thing


class Part:
    """One shard's part of the trie: n-grams as columns of words, sorted and distinct, each with a value."""

    def __init__(self, columns: list[np.ndarray], value: np.ndarray):
        store = Buffer()
        new = np.ones(len(value), bool)
        new[1:] = columns[0][1:] != columns[0][:-1]
        node = np.cumsum(new) - 1
        self.first, self.levels, contexts = EliasFano(columns[0][new], store), [], int(new.sum())
        for k, words in enumerate(columns[1:], start=1):
            new = np.ones(len(words), bool)
            new[1:] = (node[1:] != node[:-1]) | (words[1:] != words[:-1])
            self.levels.append(Level(node[new], words[new].astype(np.int64), contexts, store, **({"value": value} if k + 1 == len(columns) else {})))
            node, contexts = np.cumsum(new) - 1, int(new.sum())
        self.buffer = b"".join(store.parts)
        mapped(self, self.buffer)

    def values(self, columns: list[np.ndarray]) -> np.ndarray:
        """1 + the value of each n-gram, 0 of those that are not in the trie."""
        node = self.first.find(columns[0])
        for level, words in zip(self.levels, columns[1:], strict=True):
            node = level.find(node, words)
        hit = node >= 0
        out = np.zeros(len(node), np.uint64)
        out[hit] = self.levels[-1].value[node[hit]].astype(np.uint64) + np.uint64(1)
        return out


#: Blocks whose words have numbers: the sequence of words with end tokens, and number and training count of each word.
CODED = "block long, ids array<long>, lengths binary, seq binary, size long, words binary"


class Grams:
    """The distinct words, pairs and triples of a block, and where they stand."""

    def __init__(self, ids: list, lengths: np.ndarray, seq: np.ndarray, size: int, is_held_out):
        self.ids, self.lengths, self.seq, self.size = ids, lengths, seq, size
        self.starts = np.cumsum(lengths) - lengths
        self.held_out = np.array([is_held_out(i) for i in ids], bool)
        self.train = np.repeat(~self.held_out, lengths)

    @classmethod
    def of_block(cls, block: Block, is_held_out) -> Grams:
        size, lengths = len(block.vocabulary) + 1, block.lengths + 1
        seq = np.full(int(lengths.sum()), size - 1, np.int32)
        inner = np.ones(len(seq), bool)
        inner[np.cumsum(lengths) - 1] = False
        seq[inner] = block.words
        out = cls(block.ids, lengths, seq, size, is_held_out)
        out.own = word_hashes(block, b"\n")
        return out

    @classmethod
    def of_row(cls, row: dict, is_held_out) -> Grams:
        lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        out = cls(row["ids"], lengths, unplanes(row["seq"], int(lengths.sum())).astype(np.int32), row["size"], is_held_out)
        out.number, c1 = unpack(row["words"], out.size)
        out.c1 = c1.astype(np.int64)
        return out

    def row(self, number: int) -> dict:
        return {"block": number, "ids": self.ids, "lengths": self.lengths.astype(np.uint32).tobytes(), "seq": planes(self.seq), "size": self.size, "words": pack([self.number, self.c1])}

    def word_columns(self) -> list[np.ndarray]:
        """Sorted hashes of the block's words, and how often each stands in training documents."""
        self.order = np.argsort(self.own)
        return [self.own[self.order], np.bincount(self.seq[self.train], minlength=self.size)[self.order]]

    def numbered(self, number: np.ndarray, count: np.ndarray) -> None:
        """Takes the words' numbers and training counts, in the order of word_columns(); words stand in the order of their numbers from now on."""
        by_number = np.argsort(number)
        rank = np.empty(self.size, np.int32)
        rank[self.order[by_number]] = np.arange(self.size, dtype=np.int32)
        self.seq = rank[self.seq]
        self.number, self.c1 = number[by_number], count[by_number].astype(np.int64)

    def pairs(self) -> list[np.ndarray]:
        """Words y, z of the distinct pairs, their training count in the block, and the corpus-wide one of y."""
        place = np.arange(len(self.seq)) - np.repeat(self.starts, self.lengths)
        self.second, self.third = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        key, self.pair_of = np.unique(self.seq[self.second - 1] * np.int64(self.size) + self.seq[self.second], return_inverse=True)
        self.pair_of = self.pair_of.astype(np.int32)
        self.y, self.z = (key // self.size).astype(np.int32), (key % self.size).astype(np.int32)
        n = np.bincount(self.pair_of[self.train[self.second]], minlength=len(key))
        return [self.number[self.y], self.number[self.z], n, self.c1[self.y]]

    def paired(self, count: np.ndarray, value: np.ndarray) -> None:
        self.c2, self.value2 = count.astype(np.int64), value.astype(np.int64)

    def triples(self) -> list[np.ndarray]:
        """Words x, y, z of the distinct triples, their training count in the block, and the corpus-wide one of x, y."""
        at = np.zeros(len(self.seq), np.int32)
        at[self.second] = self.pair_of
        key, self.triple_of = np.unique(at[self.third - 1] * np.int64(self.size) + self.seq[self.third], return_inverse=True)
        self.triple_of = self.triple_of.astype(np.int32)
        self.xy = (key // self.size).astype(np.int32)
        n = np.bincount(self.triple_of[self.train[self.third]], minlength=len(key))
        return [self.number[self.y[self.xy]], self.number[self.z[self.xy]], self.number[key % self.size], n, self.c2[self.xy]]

    def scores(self, value3: np.ndarray, tokens: int, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, score) of each document; value3 in the order of triples()."""
        p1 = (self.c1 + 0.5) / (tokens + 0.5 * (kinds + 1))
        p = p1[self.seq]
        p2 = held(self.value2) + PAIR_MASS / (self.c1[self.y] + PAIR_MASS) * p1[self.z]
        p[self.second] = p2[self.pair_of]
        lower = p[self.third]
        back = TRIPLE_MASS / (self.c2[self.xy] + TRIPLE_MASS)
        p[self.third] = held(value3.astype(np.int64))[self.triple_of] + back[self.triple_of] * lower
        add = lambda x: np.add.reduceat(x, self.starts)  # noqa: E731  every document has its end token
        return add((self.c1[self.seq] > 0).astype(np.int64)), add(np.log10(p1)[self.seq]), add(np.log10(p))


def held(value: np.ndarray) -> np.ndarray:
    """The probabilities that Part.values() stand for."""
    return np.where(value > 0, 10.0 ** (-STEP * (value - 1.0)), 0.0)


def pair_hash(columns: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(columns[0]) * SPREAD + columns[1])


def triple_hash(columns: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(pair_hash(columns) * SPREAD + columns[2])


def part_of_trie(words: int, mass: float, tell_counts: bool, keep: bool):
    """An answer that compiles a shard's part of the trie and looks every n-gram up in it; keep: also report the part."""

    def answer(columns, shard):
        at, total, which = totals(columns[:words], columns[words])
        keys = [c[at] for c in columns[:words]]
        seen = total > 0
        part = Part([k[seen] for k in keys], quantised(total[seen] / (columns[words + 1][at][seen] + mass)))
        replies = [part.values(keys)[which]]
        return [total[which], *replies] if tell_counts else replies, int(seen.sum()), int(total.sum()), part.buffer if keep else None

    return answer


def score(docs: DataFrame, modulus: int = 5, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_trie: bool = False) -> DataFrame:
    """One row for each document with its base score and its score under the trie.

    keep_trie: leave the tables "lm-pairs" and "lm-triples", whose REPORT rows are the parts
    of the trie, in the shared folder; they take more than twice the room of the texts.
    """
    table = blocks(docs, id_col, text_col, lower=True)
    total = (table.agg(F.sum("n_words")).first()[0] or 0) + 1

    def is_held_out(i) -> bool:
        return i is None or zlib.crc32(str(i).encode()) % modulus == remainder

    by_word = Route(first_column, -(-(total // 4 + 1) // SHARD_KEYS))
    by_pair = Route(pair_hash, -(-total // (2 * SHARD_KEYS)))
    by_triple = Route(triple_hash, -(-total // SHARD_KEYS))

    def coded(batches):
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("seq", pa.binary()), ("size", pa.int64()), ("words", pa.binary())])
        for row in rows_of(batches):
            g = Grams.of_block(Block(row), is_held_out)
            g.numbered(*by_word.returned(row["words_back"], g.word_columns()))
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in g.row(row["block"]).items()}, schema)

    def with_pairs(row: dict) -> Grams:
        g = Grams.of_row(row, is_held_out)
        got = by_pair.returned(row["pairs_back"], g.pairs())
        g.paired(*(got or np.zeros((2, 0))))
        return g

    words = exchange(table, lambda row: Grams.of_block(Block(row), is_held_out).word_columns(), by_word, numbers(by_word.number()), "lm-words", keys=1)
    sums = words.where(F.col("row") == REPORT).agg(F.sum("keys"), F.sum("total")).first()
    kinds, tokens = (x or 0 for x in sums)
    table_1 = written(with_replies(table, {"words_back": words}).mapInArrow(coded, CODED), "lm-blocks")
    discard(table, words)
    pairs = exchange(table_1, lambda row: Grams.of_row(row, is_held_out).pairs(), by_pair, part_of_trie(2, PAIR_MASS, True, keep_trie), "lm-pairs", keys=2)
    table_2 = written(with_replies(table_1, {"pairs_back": pairs}), "lm-blocks")
    discard(table_1, *([] if keep_trie else [pairs]))
    triples = exchange(table_2, lambda row: with_pairs(row).triples(), by_triple, part_of_trie(3, TRIPLE_MASS, False, keep_trie), "lm-triples", keys=3)

    def scored(row: dict) -> pa.RecordBatch:
        g = with_pairs(row)
        got = by_triple.returned(row["triples_back"], g.triples())
        known, base, model = g.scores(got[0] if got else np.zeros(0), tokens, kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(g.held_out), pa.array(g.lengths), pa.array(known), pa.array(np.full(len(known), tokens, np.int64)), pa.array(base), pa.array(model)],
            [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    def run(batches):
        for row in rows_of(batches):
            yield scored(row)

    return with_replies(table_2, {"triples_back": triples}).mapInArrow(run, f"{id_col} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"))


SQL: dict = {}
