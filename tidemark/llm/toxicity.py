"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

A text is cut into sentences, and a sentence into units: its words without fillers, long
ones as overlapping windows, and what neighbouring fragments of up to ``FRAGMENT`` letters
spell together ("cl own", "i d i o t").  Strings are compared by the gap-weighted
subsequence kernel: common subsequences of ``ORDER`` characters, each weighted by ``DECAY``
to the power of the stretch that it spans in either string, so characters that are left
out, doubled or put in between lower the likeness but do not end it.

Labels are of documents, so which sentences are toxic is found as in multiple-instance
learning.  A sentence of a toxic document counts as toxic if it has a witness, a unit that
stands in far more toxic documents than clean ones by a likelihood-ratio test; the witness is
the string by which the machine learns of that sentence.  A clean document has no toxic
sentence, so any of its units may stand for them: some at first, and after each fit those
with the highest margins.  Variants of the clearest witnesses, with letters put in, doubled,
replaced and left out at random, teach the machine how much a gap may cost.

Features of a string are its kernel values at the landmarks, whitened by the landmarks' own
kernel matrix.  In the end the machine is a weight for each subsequence that a landmark
has, so scoring a unit is an exact sum over its subsequences: nothing is left out, however
unlike the landmarks a unit is.  A logistic curve turns the margins of a text's
distinct units (a soft count of the toxic ones for the number of sentences, and one of the
clearly toxic ones) into a probability.  It is fitted to the labelled documents and to their labelled sentences, each
alone as a text, so it also holds for a single sentence; both together weigh the same.

Strings are words, joined fragments and windows of long words: an insult made of several
words that are each harmless is not learned.

Bounds: the fit reads at most ``FIT_DOCS`` labelled documents outside the held-out fold,
chosen by a hash of their ids, and takes every unit of them that passes the test.  There are
at most ``TOXIC_LANDMARKS`` + ``CLEAN_LANDMARKS`` landmarks and at most ``LETTERS`` distinct
characters in their subsequences; other characters match nothing.  Of each document the curve
sees at most ``OF_ONE`` different sentences.  The fit does not depend on the table's layout.

Defined cases: null or empty text scores as a text without any unit; a word of any length
is compared window by window, and repeated rows are scored alike; a null id is held out;
without toxic or clean examples every score is 0; columns of any name pass through
drop_toxic; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, held_out, load, written

ORDER, DECAY, WINDOW, FRAGMENT, SENTENCE = 3, 0.6, 24, 3, 24
FIT_DOCS, TOXIC_LANDMARKS, CLEAN_LANDMARKS, LETTERS = 12_000, 128, 400, 120
#: Log likelihood ratio and ratio of document rates from which a unit is a witness at first.
SIGNIFICANT, PURE = 5.0, 9.0
NEGATIVES, HARD, ROUNDS = 6000, 2000, 3
#: Cost of all positive units together, and of all variants and all negative ones as multiples of it.
COST, VARIED, CLEAN = 10_000.0, 0.3, 10.0
#: Margin from which a unit counts as toxic, and as clearly toxic (that at which the machine puts its examples), and how sharply.
TURN, CLEAR, SLOPE = 0.15, 1.0, 8.0
#: Sentences of a document that the fit sees at most, and weight of all sentences together, documents having 1.
OF_ONE, AS_SENTENCES = 40, 1.0
CUT, KEPT_WORDS = 0.7, 250_000
#: Rows that the driver turns into double precision at a time, and landmarks whose values it lays out at a time.
ROWS, COLUMNS = 512, 64

FILLER = re.compile(r"[\W_]+")
ENDS = (".", "!", "?", "…")


def windows(word: str) -> list[str]:
    """The word without fillers, between marks of its ends; a long one as overlapping windows."""
    bare = FILLER.sub("", word)
    if len(bare) < 2:
        return []
    bare = f"<{bare}>"
    if len(bare) <= WINDOW:
        return [bare]
    return [bare[i : i + WINDOW] for i in range(0, len(bare) - WINDOW // 2, WINDOW // 2)]


def tokens(text: str | None) -> tuple[list[str], list[int]]:
    """The lower-cased words of a text, and where its lines end among them."""
    out: list[str] = []
    ends = []
    for line in (text or "").lower().split("\n"):
        out += line.split()
        ends.append(len(out))
    return out, ends


def joined(words: list[str]) -> list[str]:
    """What neighbouring short fragments spell: each two of them, and runs of single letters."""
    bare = [FILLER.sub("", w) for w in words]
    out, run = [], ""
    for k, b in enumerate(bare):
        if len(b) == 1:
            run += b
        if (len(b) != 1 or k + 1 == len(bare)) and run:
            if len(run) >= ORDER:
                out += windows(run)
            run = ""
        if k and 0 < len(b) <= FRAGMENT and 0 < len(bare[k - 1]) <= FRAGMENT and len(b) + len(bare[k - 1]) > FRAGMENT:
            out.append(f"<{bare[k - 1]}{b}>")
    return out


def units(text: str | None) -> set[str]:
    words, _ = tokens(text)
    return {v for w in set(words) for v in windows(w)} | set(joined(words))


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: words up to a line's end or a closing mark, SENTENCE of them at most."""
    words, lines = tokens(text)
    ends = {*lines, len(words), *(k + 1 for k, w in enumerate(words) if w.endswith(ENDS))}
    out, start = [], 0
    for end in sorted(ends):
        out += [" ".join(words[k : min(k + SENTENCE, end)]) for k in range(start, end, SENTENCE)]
        start = end
    return out


COMBINATIONS: dict[int, np.ndarray] = {}


def combinations(n: int) -> np.ndarray:
    """Places (i, j, k), i < j < k < n, as three rows."""
    if n not in COMBINATIONS:
        COMBINATIONS[n] = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], np.int64).reshape(-1, 3).T
    return COMBINATIONS[n]


class Subsequences:
    """Numbers for the subsequences over an alphabet, and sums over those of many strings."""

    def __init__(self, letters: str):
        self.size = len(letters) + 1
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.size)

    def of(self, strings: list[str], cells: int = 300_000):
        """(places in strings, subsequence numbers of each, their weights); 0 inside a number is any other character."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            at = np.flatnonzero(lengths == n)
            i, j, k = combinations(n)
            fade = (DECAY ** (k - i + 1)).astype(np.float32)
            step = max(1, cells // len(i))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                c = self.code[np.array([strings[x] for x in part], f"U{n}").view(np.uint32).reshape(len(part), n)]
                yield part, (c[:, i] * self.size + c[:, j]) * self.size + c[:, k], fade

    def inside(self) -> np.ndarray:
        """Which numbers are of subsequences wholly in the alphabet."""
        some = np.arange(self.size) > 0
        return (some[:, None, None] & some[None, :, None] & some[None, None, :]).ravel()

    def total(self, strings: list[str], weight: np.ndarray) -> np.ndarray:
        """For each string the sum of weight over its subsequences."""
        out = np.zeros(len(strings))
        for at, number, fade in self.of(strings):
            out[at] = weight[number] @ fade
        return out


class Landmarks:
    """Strings and the map into their feature space."""

    def __init__(self, strings: list[str]):
        count = Counter(c for s in strings for c in s)
        self.letters = "".join(sorted(c for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))
        self.space = Subsequences(self.letters)
        inside = self.space.inside()
        rows, columns, values = [], [], []
        for at, numbers, fade in self.space.of(strings):
            for k, number in zip(at.tolist(), numbers, strict=True):
                own, place = np.unique(number, return_inverse=True)
                some = inside[own]
                rows.append(own[some])
                columns.append(np.full(len(rows[-1]), k))
                values.append(np.bincount(place, weights=fade)[some])
        flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        number, self.columns, values = flat(rows, np.int64), flat(columns, np.int64), flat(values, np.float64)
        order = np.lexsort((self.columns, number))
        number, self.columns, values = number[order], self.columns[order], values[order]
        self.used, place = np.unique(number, return_inverse=True)
        self.rows = place + 1  # row 0: subsequences that no landmark has
        self.row = np.zeros(len(inside), np.int32)
        self.row[self.used] = np.arange(1, len(self.used) + 1)
        self.size = len(strings)
        norm = np.maximum(np.sqrt(np.bincount(self.columns, weights=values**2, minlength=self.size)), 1e-9)
        self.values = values / norm[self.columns]
        gram = np.zeros((self.size, self.size))
        for lo in range(1, len(self.used) + 1, ROWS):
            a, b = np.searchsorted(self.rows, (lo, lo + ROWS))
            part = np.zeros((ROWS, self.size))
            part[self.rows[a:b] - lo, self.columns[a:b]] = self.values[a:b]
            gram += part.T @ part
        roots, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(self.size))
        self.whiten = vectors / np.sqrt(np.maximum(roots, 1e-6))

    def table(self, lo: int, hi: int) -> np.ndarray:
        """What each subsequence weighs in the landmarks from lo to hi."""
        out = np.zeros((len(self.used) + 1, hi - lo), np.float32)
        some = (self.columns >= lo) & (self.columns < hi)
        out[self.rows[some], self.columns[some] - lo] = self.values[some]
        return out

    def features(self, strings: list[str]) -> np.ndarray:
        """In single precision; of the landmarks so many at a time that no table of all of them is made."""
        out = np.zeros((len(strings), self.size), np.float32)
        for lo in range(0, self.size, COLUMNS):
            hi = min(lo + COLUMNS, self.size)
            table = self.table(lo, hi)
            for at, number, fade in self.space.of(strings, 20_000):
                out[at, lo:hi] = np.einsum("ijk,j->ik", table[self.row[number]], fade)
        for lo in range(0, len(out), ROWS):
            out[lo : lo + ROWS] = out[lo : lo + ROWS] @ self.whiten
        return out

    def compiled(self, weights: np.ndarray) -> np.ndarray:
        """The weight of each subsequence that makes total() equal to features() @ weights."""
        out = np.zeros(len(self.row), np.float32)
        out[self.used] = np.bincount(self.rows - 1, weights=self.values * (self.whiten @ weights)[self.columns], minlength=len(self.used))
        return out


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps."""
    n = x.shape[1] + 1
    w, ridge = np.zeros(n), np.eye(n)
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        square, side = ridge.copy(), np.zeros(n)
        for lo in range(0, len(x), ROWS):
            part = np.hstack([x[lo : lo + ROWS], np.ones((len(x[lo : lo + ROWS]), 1))])
            on = y[lo : lo + ROWS] * (part @ w) < 1
            part, weight, sign = part[on], cost[lo : lo + ROWS][on], y[lo : lo + ROWS][on]
            square += 2 * (part * weight[:, None]).T @ part
            side += 2 * part.T @ (weight * sign)
        new = np.linalg.solve(square, side)
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Weights (the last is the bias) of a logistic curve, by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    loss = lambda v: (weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + ridge / 2 * (v @ v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def varied(words: list[str], seed: int = 7) -> list[str]:
    """The words with letters put in, tripled or left out."""
    rng, out = random.Random(seed), []
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for w in (x[1:-1] for x in words if len(x) >= 6):
        for gap in (1, 2, 3, 4):
            i = rng.randrange(1, len(w))
            out.append(w[:i] + "".join(rng.choices(letters, k=gap)) + w[i:])
            out.append("".join(rng.choices(letters, k=gap)).join(w))
        i = rng.randrange(1, len(w) - 1)
        out += [w[:i] + w[i - 1] * 3 + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]]
    return [f"<{v}>" for v in out if len(v) <= WINDOW - 2]


class Scorer:
    """Evidence in each text; remembers the words that it has met."""

    def __init__(self, letters: str, weight: np.ndarray, bias: float):
        self.space, self.weight, self.bias = Subsequences(letters), weight, bias
        self.forget()

    def forget(self):
        self.words: dict[str, int] = {}
        self.pairs: dict[str, float] = {}
        self.margin, self.ends, self.short = np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)

    def margins(self, strings: list[str]) -> np.ndarray:
        return self.space.total(strings, self.weight) + self.bias

    def best(self, lists: list[list[str]]) -> np.ndarray:
        """For each list of units the largest margin; the bias where there is none."""
        flat = [v for x in lists for v in x]
        out = np.full(len(lists), self.bias)
        if flat:
            np.maximum.at(out, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), self.margins(flat))
        return out

    def learn(self, fresh: list[str]) -> None:
        bare = np.array([len(FILLER.sub("", w)) for w in fresh])
        self.margin = np.append(self.margin, self.best([windows(w) for w in fresh]))
        self.ends = np.append(self.ends, [w.endswith(ENDS) for w in fresh])
        self.short = np.append(self.short, (bare > 0) & (bare <= FRAGMENT))

    def evidence(self, texts: list) -> np.ndarray:
        """Rows of EVIDENCE numbers: what the witnesses of a text's sentences say."""
        if len(self.words) > KEPT_WORDS or len(self.pairs) > KEPT_WORDS:
            self.forget()
        cut = [tokens(t) for t in texts]
        known = self.words
        before = len(known)
        places = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words, _ in cut]
        if len(known) > before:
            self.learn(list(known)[before:])
        return np.array([self._evidence(words, ends, at) for (words, ends), at in zip(cut, places, strict=True)]).reshape(-1, EVIDENCE)

    def _evidence(self, words: list[str], lines: list[int], at: np.ndarray) -> list[float]:
        n = len(at)
        if not n:
            return summary(np.zeros(0), 0)
        first = np.zeros(n + 1, bool)
        first[[0, *lines]] = True
        first[1:] |= self.ends[at]
        starts = np.flatnonzero(first[:n])
        sentences = int((-(-np.diff(np.append(starts, n)) // SENTENCE)).sum())
        found = self.margin[np.unique(at)]
        short = self.short[at]
        both = np.flatnonzero(short[:-1] & short[1:])
        if len(both):  # stretches of fragments
            cuts = np.flatnonzero(np.diff(both) > 1)
            spelt: set[str] = set()
            for a, b in zip(both[np.append(0, cuts + 1)].tolist(), both[np.append(cuts, len(both) - 1)].tolist(), strict=True):
                spelt.update(joined(words[a : b + 2]))
            fresh = [s for s in spelt if s not in self.pairs]
            self.pairs.update(zip(fresh, self.margins(fresh).tolist(), strict=True))
            found = np.append(found, [self.pairs[s] for s in spelt])
        return summary(found, sentences)


EVIDENCE = 2


def summary(margins: np.ndarray, sentences: int) -> list[float]:
    """Soft counts of the toxic units for the number of sentences, and of the clearly toxic units, as logarithms."""
    count, clear = (float((1 / (1 + np.exp(-np.clip(SLOPE * (margins - turn), -30, 30)))).sum()) for turn in (TURN, CLEAR))
    return [math.log((count + 0.2) / (sentences + 1) ** 0.7), math.log1p(clear)]


def significance(p: float, q: float, toxic: int, clean: int) -> float:
    """Log likelihood ratio of a unit in p toxic and q clean documents being tied to toxic ones; 0 if it is not."""
    rate, own = toxic / (toxic + clean), p / (p + q)
    if own <= rate:
        return 0.0
    return p * math.log(own / rate) + (q * math.log((1 - own) / (1 - rate)) if q else 0.0)


def sample(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """Labelled documents outside the held-out fold (t, y), at most about FIT_DOCS.

    Of near copies (the same least hash of three words) one stays: they would make any of
    their words look like evidence.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, modulus, remainder)).groupBy(F.col(id_col).alias("__tm_id")).agg(F.max(label_col).cast("int").alias("y"))
    share = min(1.0, FIT_DOCS / max(marks.count(), 1))
    marks = marks.where(F.pmod(F.xxhash64("__tm_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * FIT_DOCS)
    rows = docs.select(F.col(id_col).alias("__tm_id"), F.col(text_col).alias("t")).join(F.broadcast(marks), "__tm_id")
    words = F.split(F.lower(F.coalesce("t", F.lit(""))), r"\s+")
    least = F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda k: F.xxhash64(F.slice("w", k + 1, 3))))
    return written(rows.select("t", "y", words.alias("w")).select("t", "y", least.alias("m")).groupBy("m", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")).select("t", "y"), "toxicity-sample")


def tally(rows: DataFrame) -> DataFrame:
    """w, p, q: in how many toxic and clean documents of the sample each unit stands."""

    def run(batches):
        each: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                each[y].update(units(t))
        names = list(each[0].keys() | each[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([each[1][w] for w in names], pa.int64()), pa.array([each[0][w] for w in names], pa.int64())], ["w", "p", "q"])

    return written(rows.mapInArrow(run, "w string, p long, q long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("q").alias("q")), "toxicity-units")


def labelled_sentences(rows: DataFrame, grade: dict[str, float]) -> DataFrame:
    """s, y, n: sentences of clean documents, and those of toxic documents that have a witness; n of a document are alike.

    Of each document at most OF_ONE sentences are taken, those with the least hashes.
    """
    shared = rows.sparkSession.sparkContext.broadcast(frozenset(grade))

    def run(batches):
        witnesses = shared.value
        for b in batches:
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                some = sorted({s for s in sentences(t) if not y or not witnesses.isdisjoint(units(s))}, key=lambda s: (zlib.crc32(s.encode()), s))[:OF_ONE]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([y] * len(some), pa.int32())], ["s", "y"])

    return rows.mapInArrow(run, "s string, y int").distinct()


def highest(words: DataFrame, letters: str, weight: np.ndarray, bias: float, n: int) -> list[str]:
    """The n units with the highest margins."""
    shared = words.sparkSession.sparkContext.broadcast((letters, weight, bias))

    def run(batches):
        letters, weight, bias = shared.value
        space = Subsequences(letters)
        for b in batches:
            for lo in range(0, b.num_rows, 10_000):
                names = b.column("w").slice(lo, 10_000).to_pylist()
                m = space.total(names, weight) + bias
                top = np.argsort(-m, kind="stable")[:n]
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in top], pa.string()), pa.array(m[top])], ["w", "m"])

    return [r["w"] for r in words.select("w").mapInArrow(run, "w string, m double").orderBy(F.desc("m"), "w").limit(n).collect()]


def fit(docs: DataFrame, labels: DataFrame, modulus: int, remainder: int, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> tuple | None:
    """(letters, weights of subsequences, bias, logistic weights), or None without examples of both kinds."""
    rows = sample(docs, labels, modulus, remainder, label_col, id_col, text_col)
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    if not toxic or not clean:
        return None
    words = tally(rows)
    rate = F.col("p") * clean / (F.col("q") * toxic + 0.5 * clean / (toxic + clean))
    least = 2 if toxic > 3 else 1
    pure = words.where((F.col("p") >= least) & (rate > PURE)).collect()
    grade = {r["w"]: significance(r["p"], r["q"], toxic, clean) for r in pure}
    weight = {r["w"]: float(min(r["p"], 20)) for r in pure}
    bar = min(SIGNIFICANT, max(grade.values(), default=0.0))
    positive = sorted((w for w in grade if grade[w] >= bar), key=lambda w: (-grade[w], w))
    if not positive:
        return None
    negatives = words.where(F.col("p") * clean <= 2 * F.col("q") * toxic)
    easy = [r["w"] for r in negatives.select("w").orderBy(F.xxhash64("w"), "w").limit(NEGATIVES).collect()]
    negative, hard = easy, easy[:CLEAN_LANDMARKS]
    sure = positive[:TOXIC_LANDMARKS]
    extra = varied(sure[:80])
    for k in range(ROUNDS):
        marks = None  # the last round's go before new ones are made
        marks = Landmarks(sure + hard)
        x = marks.features([*positive, *extra, *negative, ""])  # the last stands for all that resembles none
        y = np.array([1.0] * (len(positive) + len(extra)) + [-1.0] * (len(negative) + 1))
        heavy = np.array([weight[w] for w in positive])
        cost = np.concatenate([COST * heavy / heavy.sum(), np.full(len(extra), VARIED * COST / max(1, len(extra))), np.full(len(negative), CLEAN * COST / max(1, len(negative))), [COST]])
        w = support_vector_machine(x, y, cost)
        compiled, bias = marks.compiled(w[:-1]), float(w[-1])
        if k + 1 < ROUNDS:
            new = highest(negatives, marks.letters, compiled, bias, HARD)
            negative = list(dict.fromkeys([*negative, *new]))
            hard = list(dict.fromkeys([*new[: CLEAN_LANDMARKS // 2], *hard]))[:CLEAN_LANDMARKS]
    machine = marks.letters, compiled, bias
    x, y, weight = [], [], []
    for part, share in ((rows.select("y", "t"), 1.0), (labelled_sentences(rows, {w: grade[w] for w in positive}).select("y", F.col("s").alias("t")), AS_SENTENCES)):
        # many texts have the same evidence, so what comes to the driver is one row for each kind of it
        seen = evidence(part, "t", machine).groupBy("y", "seen").agg(F.count("*").alias("n")).toArrow()
        n = seen.column("n").to_numpy().astype(float)
        x.append(np.frombuffer(b"".join(seen.column("seen").to_pylist())).reshape(-1, EVIDENCE))
        y.append(seen.column("y").to_numpy().astype(float))
        weight.append(n * share * (toxic + clean) / max(1.0, n.sum()))
    curve = logistic(np.vstack(x), np.concatenate(y), np.concatenate(weight))
    discard(words)
    discard(rows)
    return marks.letters, compiled, bias, curve


def evidence(rows: DataFrame, text_col: str, machine: tuple, out_col: str = "seen") -> DataFrame:
    """rows with the text column replaced by the packed evidence of its text."""
    kept = [c for c in rows.columns if c != text_col]
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        scorer = Scorer(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                seen = scorer.evidence(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array([r.tobytes() for r in seen], pa.binary())], [*kept, out_col])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + [T.StructField(out_col, T.BinaryType())]))


def scores(rows: DataFrame, model: tuple | None, text_col: str, out_col: str) -> DataFrame:
    """rows with the text column replaced by the probability that its text is toxic."""
    kept = [c for c in rows.columns if c != text_col]
    if model is None:
        return rows.select(*kept, F.lit(0.0).alias(out_col))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        *machine, curve = shared.value
        scorer = Scorer(*machine)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                logit = scorer.evidence(part.column(text_col).to_pylist()) @ curve[:-1] + curve[-1]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], [*kept, out_col])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + [T.StructField(out_col, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every document."""
    model = fit(docs, labels, modulus, remainder, id_col=id_col, text_col=text_col)
    out = scores(docs.select(id_col, text_col), model, text_col, "score")
    return out.select(id_col, held_out(id_col, modulus, remainder).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = fit(docs, labels, modulus, remainder, id_col=id_col, text_col=text_col)
    marked = scores(docs.withColumn("__tm_text", F.col(text_col)), model, "__tm_text", "__tm_score")
    return marked.where(F.col("__tm_score") < CUT).select(docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL: dict = {}
