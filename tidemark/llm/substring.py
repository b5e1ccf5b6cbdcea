"""Substring deduplication by automata of recurring phrases.

A window is ``WINDOW`` consecutive words of one document.  A window recurs if its words also
start anywhere else, in the same document too.

Confirming candidates: each window has an anchor, the ``ANCHOR`` consecutive words inside it
with the least hash.  Equal windows have equal anchors, and neighbouring windows mostly share
one, so there is about one anchor for nine words.  Anchors are counted over the whole corpus
(blocks.exchange); a window whose anchor does not recur cannot recur.

Locating: the words around every occurrence of a recurring anchor, from whichever document,
go to the shard of that anchor, as numbers that the exchange gives to words exactly.  A shard
confirms the windows that stand there at least twice, compiles them into Aho-Corasick
automata of at most ``PHRASES`` phrases, and streams all that was sent to it through these.
What is located at two places or more, word by word, recurs.  Of a stretch's recurring
windows, which overlap, the first and the last are phrases; they cover the words of all.

An anchor that stands more than ``HOT`` times sends each of its windows to a shard of its own
instead, so that the contexts of a widespread passage do not meet in one task.  Equal
stretches of a block are sent once with their number.

Defined cases: null or empty text has no words and keeps the empty text; a document shorter
than a window loses nothing; a text of any length is one block; rows with the same or no id
are separate documents; windows are judged on the input, so all copies of a passage go;
other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import REPORT, SHARD_KEYS, Block, Route, blocks, corpus_counts, exchange, first_column, mixed, ngrams, numbers, rows_of, totals, with_replies, within, word_hashes
from .shared import discard, load, written

WINDOW, PHRASES, HOT, SHARD_STRETCHES = 35, 20_000, 5_000, 50_000


def anchor_words(n: int) -> int:
    return n // 2 + 1


def word_columns(block: Block) -> list[np.ndarray]:
    """Sorted hashes of the words, and a count of each."""
    own = word_hashes(block)
    order = np.argsort(own)
    return [own[order], np.bincount(block.words, minlength=len(own))[order]]


class Stretches:
    """The windows of a block in stretches: those next to each other that have one anchor."""

    def __init__(self, block: Block, n: int):
        self.block, self.n, self.wide = block, n, 2 * n - anchor_words(n)
        h = block.hashes()
        self.at = within(block, n)
        self.windows = ngrams(h, n)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        if not len(self.at):
            self.first = self.last = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
        else:
            inner = ngrams(h, anchor_words(n))
            near = np.lib.stride_tricks.sliding_window_view(inner, n - anchor_words(n) + 1)
            anchor = np.concatenate([self.at[lo : lo + 50_000] + near[self.at[lo : lo + 50_000]].argmin(1) for lo in range(0, len(self.at), 50_000)])
            new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            self.first, self.last = new, np.append(new[1:], len(anchor)) - 1  # windows, by their number
            self.key = inner[anchor[new]]

    def anchors(self) -> list[np.ndarray]:
        distinct, self.anchor_of, count = np.unique(self.key, return_inverse=True, return_counts=True)
        return [distinct, count]

    def requests(self, times: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        """Key, windows, copies and words of the distinct stretches whose anchors recur.

        times: of the anchors, in the order of anchors(); number: of the words, in that of word_columns().
        """
        number = number[np.argsort(np.argsort(word_hashes(self.block)))] + np.uint64(1)
        each = times[self.anchor_of] if len(self.key) else np.zeros(0, np.int64)
        whole, apart = np.flatnonzero((each > 1) & (each <= HOT)), np.flatnonzero(each > HOT)
        long = self.last[apart] - self.first[apart] + 1
        single = np.repeat(self.first[apart], long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        first, last = np.append(self.first[whole], single), np.append(self.last[whole], single)
        key = np.append(self.key[whole], mixed(self.windows[single]))
        place, copies, self.of = totals([key, self.windows[first], self.windows[last]], np.ones(len(first), np.int64))
        self.sent = first
        start, length = self.at[first[place]], last[place] - first[place] + self.n
        inside = np.arange(self.wide) < length[:, None]
        words = np.where(inside, number[self.block.words[np.minimum(start[:, None] + np.arange(self.wide), len(self.block.words) - 1)]] if len(start) else 0, 0)
        return [key[place], length - self.n + 1, copies, words.reshape(-1, self.wide)]

    def covered(self, found: np.ndarray) -> np.ndarray:
        """Which words of the block recurring windows cover; found: bits of the windows of each stretch that was sent."""
        cover = np.zeros(len(self.block.words) + 1, np.int64)
        for k in range(self.n - anchor_words(self.n) + 1):
            hit = self.at[self.sent[(found[self.of] >> np.uint64(k) & np.uint64(1)) > 0] + k]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + self.n, -1)
        return np.cumsum(cover[:-1]) > 0


def machine(phrases: np.ndarray) -> ahocorasick.Automaton:
    """An automaton of rows of letters, each with its number."""
    out = ahocorasick.Automaton()
    for k, p in enumerate(phrases):
        out.add_word(p.tobytes().decode("utf-32-le"), k)
    out.make_automaton()
    return out


def letters(codes: np.ndarray) -> np.ndarray:
    """Characters for small numbers, leaving out those that are no letters of their own."""
    return np.where(codes < 0xD800, codes, codes + 0x800).astype(np.uint32)


def located(words: np.ndarray, windows: np.ndarray, copies: np.ndarray, n: int) -> np.ndarray:
    """Bits of the recurring windows of each stretch, the first and last of every run at least."""
    most = words.shape[1] - n + 1
    there = np.arange(most) < windows[:, None]
    hashes = [np.stack([window_hash(words[:, k : k + n], seed) for k in range(most)], 1)[there] for seed in (1, 2)]
    row, k = np.nonzero(there)
    place, total, which = totals(hashes, copies[row])
    again = np.zeros((len(words), most + 2), bool)
    again[row, k + 1] = total[which] > 1
    edge = again[:, 1:-1] & ~(again[:, :-2] & again[:, 2:])
    phrases = np.unique(which[edge[row, k]])
    found = np.zeros(len(words), np.uint64)
    if not len(phrases):
        return found
    spelt = words[row[place[phrases]][:, None], k[place[phrases]][:, None] + np.arange(n)]
    alphabet = np.unique(spelt)
    code = np.searchsorted(alphabet, words)
    code = letters(np.where(alphabet[np.minimum(code, len(alphabet) - 1)] == words, code + 1, 0))
    finder = machine(letters(np.searchsorted(alphabet, spelt) + 1))
    hits = []
    for i, (c, w) in enumerate(zip(code, windows.tolist(), strict=True)):
        if w > 0:
            hits += [(i, end - n + 1, p) for end, p in finder.iter(c[: w + n - 1].tobytes().decode("utf-32-le"))]
    if hits:
        stretch, at, phrase = np.array(hits).T
        places = np.bincount(phrase, copies[stretch], len(phrases))
        sure = places[phrase] > 1
        np.bitwise_or.at(found, stretch[sure], np.uint64(1) << at[sure].astype(np.uint64))
    return found


def window_hash(words: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.full(len(words), seed, np.uint64)
        for k in range(words.shape[1]):
            x = x * np.uint64(0x9E3779B97F4A7C15) + mixed(words[:, k] + np.uint64(seed << 40)) if k % 8 else mixed(x + words[:, k])
        return mixed(x)


def find(n: int):
    """An answer that streams a shard's stretches through automata of what recurs among them."""

    def answer(columns, shard):
        key, windows, copies, words = columns
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        out, first, count = np.zeros(len(key), np.uint64), 0, 0
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
            if b - first > PHRASES // 2 and a > first:  # a stretch has two phrases for each run, mostly
                part = order[first:a]
                out[part] = located(words[part], windows[part].astype(np.int64), copies[part].astype(np.int64), n)
                first = a
        part = order[first:]
        out[part] = located(words[part], windows[part].astype(np.int64), copies[part].astype(np.int64), n)
        return [out], len(key), int(copies.sum()), None

    return answer


def recurring(columns, shard):
    """An answer that tells how often an anchor stands, at most HOT + 1; in total, places of recurring ones."""
    (every,), keys, _, report = corpus_counts(columns, shard)
    return [np.minimum(every, HOT + 1)], keys, int(columns[1][every > 1].sum()), report


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and the kept text of every document; a window has at most 126 words."""
    table = blocks(docs, id_col, text_col)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    by_word = Route(first_column, -(-(total // 4 + 1) // SHARD_KEYS))
    by_anchor = Route(first_column, -(-(total // (n // 4 + 1) + 1) // SHARD_KEYS))
    anchors = exchange(table, lambda row: Stretches(Block(row), n).anchors(), by_anchor, recurring, "anchors", keys=1)
    places = anchors.where(F.col("row") == REPORT).agg(F.sum("total")).first()[0] or 0
    words = exchange(table, lambda row: word_columns(Block(row)), by_word, numbers(by_word.number()), "word-numbers", keys=1)
    by_stretch = Route(first_column, -(-(places + 1) // SHARD_STRETCHES))
    both = written(with_replies(table, {"times": anchors, "numbers": words}), "anchored-blocks")
    discard(table, anchors, words)

    def asked(row: dict) -> tuple[Stretches, list[np.ndarray]]:
        s = Stretches(Block(row), n)
        times = by_anchor.returned(row["times"], s.anchors())
        number = by_word.returned(row["numbers"], word_columns(s.block))
        return s, s.requests(times[0].astype(np.int64) if times else np.zeros(0, np.int64), number[0] if number else np.zeros(0, np.uint64))

    found = exchange(both, lambda row: asked(row)[1], by_stretch, find(n), "located")

    def clean(batches):
        for row in rows_of(batches):
            s, columns = asked(row)
            got = by_stretch.returned(row["found"], columns)
            yield from kept(s.block, ~s.covered(got[0] if got else np.zeros(0, np.uint64)), id_col)

    return with_replies(both, {"found": found}).mapInArrow(clean, f"{id_col} long, n_words long, n_removed long, kept_text string")


def kept(block: Block, keep: np.ndarray, id_col: str):
    """Batches of id, n_words, n_removed and kept text of a block's documents."""
    word, before = block.vocabulary, np.concatenate([[0], np.cumsum(keep)])
    removed = block.lengths - (before[block.ends] - before[block.starts])
    for lo in range(0, len(block.ids), 2000):
        hi = min(lo + 2000, len(block.ids))
        texts = [b" ".join([word[w] for w in block.words[a:b][keep[a:b]].tolist()]).decode() for a, b in zip(block.starts[lo:hi].tolist(), block.ends[lo:hi].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(block.ids[lo:hi], pa.int64()), pa.array(block.lengths[lo:hi]), pa.array(removed[lo:hi]), pa.array(texts, pa.string())], [id_col, "n_words", "n_removed", "kept_text"])


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        place AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        windows AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM place),
        recurring AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1),
        covered AS (SELECT DISTINCT r, i + k AS j FROM recurring, range(35) AS t(k)),
        word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
        kept AS (SELECT r, list(x ORDER BY j) AS k FROM word ANTI JOIN covered USING (r, j) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(len(k), 0) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)"""
}
