"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task first turns its texts into pieces, the stretches between single spaces, and
keeps each distinct piece once.  The distinct pre-tokens of all new pieces lie one
after the other in one array of symbols.  An index maps each merge rank to all
positions at which its pair stands; ranks that are active are applied in ascending
order, each to all its positions at once, and only the lists of the pairs that
appear beside a merged position are updated.  Texts are then put together from the
ids of their pieces.

The result equals that of the public tokenizers library for the same file, with
add_special_tokens=False and without truncation or padding.

Defined cases: a null text is encoded as the empty text, to no ids; ids that the
vocabulary lacks decode to nothing; a text of any length is one row; repeated rows stay
and are coded alike; an empty table gives an empty result; extra columns pass through,
and a column that already has the result's name is an error.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import load

#: How the byte-level pre-tokenizer splits text (a fixed value of the file format).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's \s has it.
SPACE = "[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]"
#: Distinct pieces that a task keeps between batches, and ids or characters that it assembles at a time.
KEPT_PIECES, STRETCH = 100_000, 300_000
#: Rows whose new pieces are merged together.
ROWS = 1000
NEVER = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a vocabulary file."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of a tokenizer file as arrays, small enough to broadcast."""

    def __init__(self, text: str):
        model, letters = (spec := json.loads(text))["model"], byte_letters()
        ids, value = model["vocab"], {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        keys = np.array([ids[a] * (self.size + 1) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.left, self.right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.of_byte = np.array([ids[c] for c in letters], np.int64)
        tokens = [b""] * (self.size + 1)
        for t, i in ids.items():
            tokens[i] = bytes(value[c] for c in t)
        for t, i in self.special.items():
            tokens[i] = t.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)


def merge(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each word has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64), lengths
    ends = np.cumsum(lengths)
    wall, dead = v.size, -1
    symbol = np.append(v.of_byte[np.frombuffer(b"".join(words), np.uint8)], wall).astype(np.int32)
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends[lengths > 0] - 1] = n
    before[(ends - lengths)[lengths > 0]] = n

    def rank(at):
        key = symbol[at] * np.int64(v.size + 1) + symbol[after[at]]
        j = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        return np.where(v.keys[j] == key, v.ranks[j], NEVER)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at):
        r = rank(at)
        at, r = at[r < NEVER], r[r < NEVER]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(r)], strict=True):
            if hi > lo:
                k = int(r[lo])
                if k not in index:
                    index[k] = []
                    heapq.heappush(active, k)
                index[k].append(at[lo:hi])

    for lo in range(0, n, 500_000):
        note(np.arange(lo, min(n, lo + 500_000), dtype=np.int32))
    while active:
        k = heapq.heappop(active)
        lists = index.pop(k)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = v.left[k], v.right[k]
        at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
        if a == b and len(at) > 1:  # of overlapping pairs the leftmost counts
            chosen, taken = [], -1
            for p in np.sort(at).tolist():
                if p != taken:
                    chosen.append(p)
                    taken = int(after[p])
            at = np.array(chosen, np.int32)
        if not len(at):
            continue
        gone = after[at]
        then = after[gone]
        symbol[at], symbol[gone] = v.made[k], dead
        after[at], before[then] = then, at
        ahead = before[at]
        note(np.unique(np.concatenate([ahead[ahead < n], at])))
    alive = symbol[:n] != dead
    total = np.concatenate([[0], np.cumsum(alive)])
    return symbol[:n][alive], total[ends] - total[ends - lengths]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of every stretch, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """Encodes the texts of one task; it remembers the pieces that it has met."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.pretoken = regex.compile(PRETOKEN).findall
        self.doubled = regex.compile(SPACE + SPACE).search
        self.single = regex.compile(f"(?<!{SPACE}) (?!{SPACE})").split
        self.special = regex.compile("|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) or "(?!)")
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, text: str) -> np.ndarray:
        """A number for each piece.  A piece that follows a space keeps it; a special token is \\0 and its text."""
        pieces = []
        at = 0
        for m in [*self.special.finditer(text), None] if self.v.special else [None]:
            part = text[at : m.start()] if m else text[at:] if at else text
            if part:
                split = self.single(part) if self.doubled(part) else part.split(" ")
                pieces.append(split[0])
                pieces += [" " + p for p in split[1:]]
            if m:
                pieces.append("\0\0" + m[0])
                at = m.end()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
        except KeyError:
            for p in pieces:
                if p not in known:
                    known[p] = len(known)
            return np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))

    def learn(self) -> None:
        """Ids for the pieces that are new since the last call."""
        fresh = list(self.known)[len(self.starts) :]
        if not fresh:
            return
        words: dict[str, int] = {}
        parts, per_piece = [], np.zeros(len(fresh), np.int64)
        for i, p in enumerate(fresh):
            found = [p] if p.startswith("\0\0") and p[2:] in self.v.special else self.pretoken(p)
            per_piece[i] = len(found)
            parts += [words.setdefault(w, len(words)) for w in found]
        specials = [(k, self.v.special[w[2:]]) for w, k in words.items() if w.startswith("\0\0") and w[2:] in self.v.special]
        listed = [w.encode() for w in words]
        for k, _ in specials:
            listed[k] = b""
        ids, counts = merge(self.v, listed)
        if specials:
            at = np.array([k for k, _ in specials])
            ids = np.insert(ids, (np.cumsum(counts) - counts)[at], [i for _, i in specials])
            counts[at] = 1
        word_starts, parts = np.cumsum(counts) - counts, np.array(parts, np.int64)
        flat = ids[gather(word_starts[parts], counts[parts])].astype(np.int32)
        cum = np.concatenate([[0], np.cumsum(counts[parts])])
        ends = np.cumsum(per_piece)
        piece_counts = cum[ends] - cum[ends - per_piece]
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(piece_counts) - piece_counts])
        self.counts = np.concatenate([self.counts, piece_counts])
        self.ids = np.concatenate([self.ids, flat])

    def batch(self, texts: pa.Array):
        """(first row, ids as a list array) for stretches of the texts."""
        if len(self.known) > KEPT_PIECES:
            self.forget()
        codes = [self.codes(t.as_py() or "") for t in texts]
        self.learn()
        first, held = 0, 0
        for i, c in enumerate(codes):
            held += len(c)
            if held >= STRETCH // 3 or i + 1 == len(codes):
                every = np.concatenate(codes[first : i + 1])
                counts = self.counts[every]
                values = self.ids[gather(self.starts[every], counts)]
                cum = np.concatenate([[0], np.cumsum(counts)])
                offsets = cum[np.concatenate([[0], np.cumsum([len(x) for x in codes[first : i + 1]])])]
                yield first, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                first, held = i + 1, 0


def _vocabulary(spark: SparkSession, path: str | None):
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        # as bytes that hold the class too, since executors need not have this package
        return spark.sparkContext.broadcast(cloudpickle.dumps(Vocabulary(f.read())))


def new_name(rows: DataFrame, name: str) -> None:
    if name.lower() in map(str.lower, rows.columns):
        raise ValueError(f"the column {name!r} exists; give another name for the result")


def encoded(v: Vocabulary, batches, kept: list[str], text_col: str, ids_col: str):
    encoder = Encoder(v)
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            rest = [part.column(c) for c in kept]
            for first, ids in encoder.batch(part.column(text_col)):
                yield pa.RecordBatch.from_arrays([c.slice(first, len(ids)) for c in rest] + [ids], [*kept, ids_col])


def decoded(v: Vocabulary, batches, ids_col: str, text_col: str):
    for batch in batches:
        lists = batch.column(ids_col)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        first = 0
        while first < len(lists):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + STRETCH, side="right")) - 1)
            part = values[bounds[first] : bounds[last]]
            part = np.where((part >= 0) & (part < v.size), part, v.size)
            raw = v.bytes[gather(v.starts[part], v.lengths[part])].tobytes()
            at = np.concatenate([[0], np.cumsum(v.lengths[part])])[bounds[first : last + 1] - bounds[first]]
            texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in batch.columns] + [pa.array(texts, pa.string())], [*batch.schema.names, text_col])
            first = last


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the text column replaced by its token ids (array<int>); ids_col must be a new name."""
    new_name(docs, ids_col)
    shared = _vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if c != text_col]
    return docs.mapInArrow(lambda batches: encoded(cloudpickle.loads(shared.value), batches, kept, text_col, ids_col), T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids_col: str = "ids", text_col: str = "text", path: str | None = None) -> DataFrame:
    """rows with the text of their token ids in the new column text_col; bytes that are no UTF-8 become U+FFFD."""
    new_name(rows, text_col)
    shared = _vocabulary(rows.sparkSession, path)
    return rows.mapInArrow(lambda batches: decoded(cloudpickle.loads(shared.value), batches, ids_col, text_col), T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """docs with token ids and, as the text, what they decode to; one Python worker does both."""
    new_name(docs, ids_col)
    shared = _vocabulary(docs.sparkSession, path)
    kept = [c for c in docs.columns if c != text_col]

    def run(batches):
        v = cloudpickle.loads(shared.value)
        return decoded(v, encoded(v, batches, kept, text_col, ids_col), ids_col, text_col)

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(text_col, T.StringType())]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode, and describe both by digests."""
    both = round_trip(docs.select(id_col, text_col), text_col, "__tm_ids")
    ids = F.array_join(F.transform("__tm_ids", lambda x: x.cast("string")), ",")
    return both.select(id_col, F.size("__tm_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(text_col, 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(load(spark, sf_dir, "documents"))


SQL: dict = {}
