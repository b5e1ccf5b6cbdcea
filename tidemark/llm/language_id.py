"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text holds every string that stands in that
text.  A document is cut into phrases by each of them: the longest match from where the last
phrase ended, and so on.  The more of a document a language's text already says, the fewer
phrases are needed.  A phrase is a pointer into the language's text, so phrases are weighted
by the logarithm of its length, and divided by the length of what was cut: bits for each
letter.  The language with the fewest wins; the score is its share when bits are taken as
negative log likelihoods of ``SHARE`` letters.

Texts are reduced to letters: lower case, and one space for each run of anything that is no
letter or mark.  The ``ALPHABET`` most frequent letters of the labelled texts are symbols of
their own, others share ``SHARED`` symbols.  A document is cut at every ``PIECE`` symbols, so
that thousands of pieces go through all automata in step, as one look-up of an array for
each position; a cut adds at most one phrase to each language.  Whole texts are read.

Bounds: a language is learned from at most ``LEARNED`` symbols of its labelled texts, fewer if
there are more than ``LANGUAGES`` languages.  They come from documents with the least hashes
of text, at most ``SHARE_OF_ONE`` code points of each, so the fit does not depend on the
layout of the table.

Defined cases: null text, and text without a letter, is ``und`` with score 0; without labelled
text all are; a null id is held out, a null lang teaches nothing; of languages that need
equally many phrases the first by code point is taken; the only language has score 1;
rows may repeat, and each is judged alike; a text of any length is cut to its end; other
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import held_out, load

UNKNOWN = "und"
LEARNED, SHARE_OF_ONE, LANGUAGES = 20_000, 1_000, 8
ALPHABET, SHARED, PIECE, SHARE = 60, 4, 256, 40
#: Code points that a task parses together.
AT_ONCE = 2_000_000
#: Marks an entry of the table that begins a phrase.
PHRASE = np.int32(1 << 30)


def kinds() -> np.ndarray:
    """For each code point 0, 1 if it is a mark and 2 if it is a letter."""
    first = (unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    return np.fromiter(({"M": 1, "L": 2}.get(k, 0) for k in first), np.uint8, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Symbols:
    """A number for each code point: 0 for what parts words, then the alphabet, then those that others share."""

    def __init__(self, samples: list[str]):
        self.kind = kinds()
        count = Counter(c for s in samples for c in s.lower() if self.kind[ord(c)])
        alphabet = "".join(c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])
        self.size = 1 + len(alphabet) + SHARED
        number = 1 + len(alphabet) + np.arange(len(self.kind)) % SHARED
        number[code_points(alphabet)] = 1 + np.arange(len(alphabet))
        self.number = np.where(self.kind > 0, number, 0).astype(np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        """Symbols of lower-cased code points; one 0 for each run between words."""
        out = self.number[points]
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] > 0) | (out[:-1] > 0)
        return out[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The states' transitions; state 0 is the root, and every string in the text is a path from it."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


def moves(step: list[dict[int, int]], size: int, offset: int) -> np.ndarray:
    """Where each state goes by each symbol, as a place in the table; PHRASE where that begins a phrase.

    A symbol that does not go on from a state begins a phrase at the root; one that the root
    lacks is a phrase of its own.
    """
    root = np.full(size, offset, np.int32)
    for c, to in step[0].items():
        root[c] = offset + to * size
    out = np.tile(root | PHRASE, (len(step), 1))
    for state, ways in enumerate(step[1:], start=1):
        for c, to in ways.items():
            out[state, c] = offset + to * size
    return out.ravel()


class Languages:
    """What is learned: names, bits of a phrase, the alphabet, the table of moves and each root's place in it."""

    def __init__(self, samples: dict[str, list[str]]):
        symbols = Symbols([s for texts in samples.values() for s in texts])
        most = min(LEARNED, LEARNED * LANGUAGES // max(1, len(samples)))
        self.symbols, self.names, parts, roots, bits, at = symbols, sorted(samples), [], [], [], 0
        for name in self.names:
            learned = symbols.of(code_points(" ".join(samples[name]).lower()))[:most]
            parts.append(moves(suffix_automaton(learned.tolist()), symbols.size, at))
            roots.append(at)
            bits.append(np.log2(len(learned) + 2))
            at += len(parts[-1])
        self.moves, self.roots, self.bits = np.concatenate(parts), np.array(roots, np.int32), np.array(bits)


def phrases(symbols: np.ndarray, ends: np.ndarray, moves: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Phrases that each language (column) needs for each document (row).

    symbols: of all documents, one after the other; ends: where each document ends.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    pieces = -(-(ends - starts) // PIECE)
    doc = np.repeat(np.arange(len(ends)), pieces)
    begin = starts[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    size = np.minimum(begin + PIECE, ends[doc]) - begin
    order = np.argsort(-size, kind="stable")  # the pieces that go on are always the first ones
    begin, size, doc = begin[order], size[order], doc[order]
    count = np.zeros((len(roots), len(doc)), np.int32)
    state = np.repeat(roots[:, None], len(doc), 1)
    going = np.searchsorted(-size, -np.arange(1, PIECE + 1), side="right")
    for j in range(PIECE if len(doc) else 0):
        n = going[j]
        if not n:
            break
        to = moves[state[:, :n] + symbols[begin[:n] + j]]
        count[:, :n] += to >> 30
        state[:, :n] = to & (PHRASE - np.int32(1))
    out = np.zeros((len(ends), len(roots)))
    np.add.at(out, doc, count.T)
    return out


class Judge:
    """Finds the languages of texts."""

    def __init__(self, languages: Languages):
        self.languages = languages

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known, symbols, parts, has_letter = self.languages, self.languages.symbols, [], []
        for text in texts:
            points = code_points((text or "").lower())
            has_letter.append(bool((symbols.kind[points] == 2).any()))
            parts.append(symbols.of(points))
        ends = np.cumsum([len(p) for p in parts])
        needed = phrases(np.concatenate(parts), ends, known.moves, known.roots)
        bits = needed * known.bits / np.maximum(1, np.diff(ends, prepend=0))[:, None]
        best = bits.argmin(1)
        odds = np.exp2(-SHARE * (bits - bits.min(1, keepdims=True)))
        score = np.where(has_letter, 1 / odds.sum(1), 0.0)
        return [known.names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has_letter, strict=True)], score


def samples(docs: DataFrame, modulus: int, remainder: int, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """For each language parts of its labelled texts, at most about twice as much as is learned."""
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col, modulus, remainder))
    some = some.select(F.col(lang_col).alias("name"), F.xxhash64(text_col, F.lit(13)).alias("h"), F.col(text_col).alias("t"))
    distinct = some.groupBy("name", "h").agg(F.max(F.least(F.length("t"), F.lit(SHARE_OF_ONE))).alias("n"))
    total = {r["name"]: r["n"] for r in distinct.groupBy("name").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return {}
    share = F.lit(0.0)
    for name, n in total.items():
        share = F.when(F.col("name") == name, min(1.0, 2.0 * LEARNED / max(n, 1))).otherwise(share)
    chosen = some.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30) + 1)
    before = Window.partitionBy("name").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)
    chosen = chosen.select("name", "h", F.substring("t", 1, SHARE_OF_ONE).alias("t")).distinct()
    chosen = chosen.withColumn("before", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(F.col("before") < 2 * LEARNED)
    out: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["h"], r["t"])):
        out.setdefault(r["name"], []).append(r["t"])
    return out


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred and score for every document."""
    learned = {k: v for k, v in samples(docs, modulus, remainder, id_col, text_col, lang_col).items() if v}
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, modulus, remainder).alias("held_out"), F.col(text_col).alias("t"))
    names = [F.col("id").alias(id_col), "held_out", "lang_pred", "score"]
    if not learned:
        return rows.select("id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")).select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(Languages(learned))

    def run(batches):
        judge = Judge(shared.value)
        for batch in batches:
            group = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("t")), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    part = batch.slice(lo, hi - lo)
                    lang, score = judge(part.column("t").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["id", "held_out", "lang_pred", "score"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").select(*names)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


SQL: dict = {}
