"""A kept n-gram trie: fitted once, left in a folder, and mapped by whoever scores other documents.

fit() counts the words, pairs and triples of a training corpus as lm_score does and writes each shard's
part of the trie as one file, in a folder that all executors reach.  A file is a description of
its arrays and then the arrays; a reader maps it, so that a look-up reads the pages it touches.
A path with another scheme is opened through pyarrow's file systems, and its parts are read whole.
Files are renamed when complete, and a repeated task writes the same bytes again.

score_with() numbers the words of other documents by the kept words and looks their pairs and triples
up in the kept parts.  Its keys are dealt to as many tasks as these documents need, however many
parts the trie has; a task opens the parts that its keys lie in.  Scores are those that lm_score.score gives
to held-out documents after training on the same corpus.

Defined cases: those of lm_score; every row of the training table trains, also one without an id;
a trie of no documents gives every word the probability of one unseen word among none.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import FAN, REPORT, SHARD_KEYS, Block, Route, blocks, exchange, first_column, numbers, rows_of, totals, with_replies
from .lm_score import CODED, PAIR_MASS, TRIPLE_MASS, Buffer, EliasFano, Grams, Level, Part, mapped, pair_hash, quantised, triple_hash
from .shared import discard, scratch_root, written

#: The number of a word that the trie does not hold: above all others, and far enough from 2^64 to be shifted.
UNKNOWN = np.uint64(1 << 62)
COUNT_BITS = np.uint64(16)  # a pair's value is its quantised probability and, above these bits, its count


class Words:
    """One shard's words: sorted hashes, with number and count of each."""

    def __init__(self, hashes: np.ndarray, number: np.ndarray, count: np.ndarray):
        store = Buffer()
        self.hashes, self.number, self.count = (store(x.astype(np.uint64)) for x in (hashes, number, count))
        self.buffer = b"".join(store.parts)
        mapped(self, self.buffer)

    def look_up(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, columns[0]), len(self.hashes) - 1)
        hit = self.hashes[at] == columns[0]
        return [np.where(hit, self.number[at], UNKNOWN), np.where(hit, self.count[at], np.uint64(0))]


def described(thing, base: int):
    """The attributes of a part as JSON; arrays by their place in its buffer."""
    if isinstance(thing, np.ndarray):
        return {"array": [thing.ctypes.data - base if len(thing) else 0, thing.dtype.str, len(thing)]}
    if isinstance(thing, list):
        return [described(x, base) for x in thing]
    if isinstance(thing, (Words, Part, EliasFano, Level)):
        return {"class": type(thing).__name__, "has": {k: described(v, base) for k, v in vars(thing).items() if k != "buffer"}}
    return int(thing)


def revived(form, buffer):
    """What described() was made from, with arrays as views on the buffer."""
    if isinstance(form, list):
        return [revived(x, buffer) for x in form]
    if not isinstance(form, dict):
        return form
    if "array" in form:
        at, dtype, n = form["array"]
        return np.frombuffer(buffer, dtype, n, at)
    kind = {c.__name__: c for c in (Words, Part, EliasFano, Level)}[form["class"]]
    thing = kind.__new__(kind)
    vars(thing).update({k: revived(v, buffer) for k, v in form["has"].items()})
    return thing


def place(path: str):
    """pyarrow's file system for a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def put(path: str, *parts: bytes) -> None:
    files, path = place(path)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    unfinished = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(unfinished) as out:
        for part in parts:
            out.write(part)
    files.move(unfinished, path)


def keep(path: str, part: Words | Part) -> None:
    base = np.frombuffer(part.buffer, np.uint8).ctypes.data
    head = json.dumps(described(part, base)).encode()
    head += b" " * (-len(head) % 8)
    put(path, len(head).to_bytes(8, "little"), head, part.buffer)


def kept(path: str) -> Words | Part | None:
    """The part in a file; None if there is no file, since no key of the corpus went to that shard."""
    from pyarrow import fs

    files, path = place(path)
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return None
    if isinstance(files, fs.LocalFileSystem):
        raw = pa.memory_map(path).read_buffer()
    else:
        with files.open_input_file(path) as file:
            raw = file.read_buffer()
    size = int.from_bytes(raw.slice(0, 8).to_pybytes(), "little")
    return revived(json.loads(raw.slice(8, size).to_pybytes()), raw.slice(8 + size))


def shard_of(route: Route, columns: list[np.ndarray]) -> np.ndarray:
    """The shard, at the route's last level, to which each key was dealt."""
    out = route.shard(columns)
    while route.shards > FAN:
        route = route.below()
        out = out * route.fan + route.shard(columns)
    return out


def from_parts(folder: str, route: Route, width: int, look_up, absent: tuple):
    """An answer from kept parts: look_up(part, columns) gives the replies, ``absent`` those of keys without a part."""

    def answer(columns, shard):
        at, _, which = totals(columns[:width], np.zeros(len(columns[0]), np.int64))
        keys = [c[at] for c in columns[:width]]
        replies = [np.full(len(at), x, np.uint64) for x in absent]
        shards = shard_of(route, keys)
        order = np.argsort(shards, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(shards[order])) + 1) if len(order) else []:
            part = kept(f"{folder}/{int(shards[group[0]])}")
            if part is not None:
                for reply, got in zip(replies, look_up(part, [k[group] for k in keys]), strict=True):
                    reply[group] = got
        return [r[which] for r in replies], len(at), 0, None

    return answer


def keeping_words(folder: str, shards: int):
    """An answer that numbers a shard's words, as lm_score does, and keeps them."""
    numbered = numbers(shards)

    def answer(columns, shard):
        replies, keys, total, _ = numbered(columns, shard)
        at, _, _ = totals(columns[:1], columns[1])
        keep(f"{folder}/{shard}", Words(columns[0][at], replies[0][at], replies[1][at]))
        return replies, keys, total, None

    return answer


def keeping_grams(folder: str, words: int, mass: float):
    """An answer that keeps a shard's part of the trie and tells counts of pairs, which triples need."""

    def answer(columns, shard):
        at, total, which = totals(columns[:words], columns[words])
        value = quantised(total / (columns[words + 1][at] + mass))
        if words == 2:
            value = (total.astype(np.uint64) << COUNT_BITS) | value.astype(np.uint64)
        keep(f"{folder}/{shard}", Part([c[at] for c in columns[:words]], value))
        return [total[which]] if words == 2 else [], len(at), int(total.sum()), None

    return answer


def routes(words: int) -> tuple[Route, Route, Route]:
    """How the words, pairs and triples of a corpus of that many words are dealt."""
    return Route(first_column, -(-(words // 4 + 1) // SHARD_KEYS)), Route(pair_hash, -(-words // (2 * SHARD_KEYS))), Route(triple_hash, -(-words // SHARD_KEYS))


def n_words(table: DataFrame) -> int:
    return (table.agg(F.sum("n_words")).first()[0] or 0) + 1


def with_numbers(table: DataFrame, words: DataFrame, by_word: Route, held_out: bool) -> DataFrame:
    """The blocks as sequences of word numbers, written."""

    def coded(batches):
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("seq", pa.binary()), ("size", pa.int64()), ("words", pa.binary())])
        for row in rows_of(batches):
            g = Grams.of_block(Block(row), lambda i: held_out)
            g.numbered(*by_word.returned(row["words_back"], g.word_columns()))
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in g.row(row["block"]).items()}, schema)

    return written(with_replies(table, {"words_back": words}).mapInArrow(coded, CODED), "lm-blocks")


def fit(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Trains on all rows; gives the folder (by default one in the shared folder) that score_with() takes."""
    folder = folder or f"{scratch_root(docs.sparkSession)}/tidemark/trie-{uuid.uuid4().hex}"
    table = blocks(docs, id_col, text_col, lower=True)
    total = n_words(table)
    by_word, by_pair, by_triple = routes(total)

    def grams(row: dict) -> Grams:
        return Grams.of_row(row, lambda i: False)

    def triples_of(row: dict):
        g = grams(row)
        (count,) = by_pair.returned(row["pairs_back"], g.pairs()) or np.zeros((1, 0))
        g.paired(count, count)
        return g.triples()

    words = exchange(table, lambda row: Grams.of_block(Block(row), lambda i: False).word_columns(), by_word, keeping_words(f"{folder}/words", by_word.number()), "lm-words", keys=1)
    kinds, tokens = (x or 0 for x in words.where(F.col("row") == REPORT).agg(F.sum("keys"), F.sum("total")).first())
    coded = with_numbers(table, words, by_word, False)
    discard(table, words)
    pairs = exchange(coded, lambda row: grams(row).pairs(), by_pair, keeping_grams(f"{folder}/pairs", 2, PAIR_MASS), "lm-pairs", keys=2)
    triples = exchange(with_replies(coded, {"pairs_back": pairs}), triples_of, by_triple, keeping_grams(f"{folder}/triples", 3, TRIPLE_MASS), "lm-triples", keys=3)
    discard(coded, pairs, triples)
    put(f"{folder}/model.json", json.dumps({"words": total, "tokens": tokens, "kinds": kinds}).encode())
    return folder


def score_with(folder: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: n_tokens, n_known, train_tokens, base_score and score under the kept trie."""
    files, path = place(f"{folder}/model.json")
    with files.open_input_file(path) as file:
        model = json.loads(file.read())
    kept_routes = routes(model["words"])
    table = blocks(docs, id_col, text_col, lower=True)
    by_word, by_pair, by_triple = routes(n_words(table))
    tokens, kinds = model["tokens"], model["kinds"]

    def with_pairs(row: dict) -> Grams:
        g = Grams.of_row(row, lambda i: True)
        (got,) = by_pair.returned(row["pairs_back"], g.pairs()) or np.zeros((1, 0), np.uint64)
        value = got - (got > 0).astype(np.uint64)  # 0 stands for an unseen pair
        g.paired(value >> COUNT_BITS, np.where(got > 0, (value & np.uint64(0xFFFF)) + np.uint64(1), np.uint64(0)))
        return g

    def values(part, columns):
        return [part.values(columns)]

    words = exchange(table, lambda row: Grams.of_block(Block(row), lambda i: True).word_columns(), by_word, from_parts(f"{folder}/words", kept_routes[0], 1, Words.look_up, (UNKNOWN, 0)), "lm-words", keys=1)
    coded = with_numbers(table, words, by_word, True)
    discard(table, words)
    pairs = exchange(coded, lambda row: Grams.of_row(row, lambda i: True).pairs(), by_pair, from_parts(f"{folder}/pairs", kept_routes[1], 2, values, (0,)), "lm-pairs", keys=2)
    paired = written(with_replies(coded, {"pairs_back": pairs}), "lm-blocks")
    discard(coded, pairs)
    triples = exchange(paired, lambda row: with_pairs(row).triples(), by_triple, from_parts(f"{folder}/triples", kept_routes[2], 3, values, (0,)), "lm-triples", keys=3)

    def run(batches):
        for row in rows_of(batches):
            g = with_pairs(row)
            got = by_triple.returned(row["triples_back"], g.triples())
            known, base, score = g.scores(got[0] if got else np.zeros(0), tokens, kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(g.lengths), pa.array(known), pa.array(np.full(len(known), tokens, np.int64)), pa.array(base), pa.array(score)],
                [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return with_replies(paired, {"triples_back": triples}).mapInArrow(run, f"{id_col} long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
