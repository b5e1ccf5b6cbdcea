"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import zlib
from collections import Counter

LOW = {c: c + 32 for c in range(65, 91)}


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def exact(docs):
    """(id, text) -> per row (id, keep_id, size), in order of rows."""
    key = [(t or "").translate(LOW) for _, t in docs]
    size = Counter(key)
    keep = {}
    for (i, _), k in zip(docs, key, strict=True):
        if k not in keep or (i is not None and (keep[k] is None or i > keep[k])):
            keep[k] = i
    return [(i, keep[k], size[k]) for (i, _), k in zip(docs, key, strict=True)]


def repeats(docs, n=35):
    """(id, n_words, n_removed, kept text) for each row."""
    lists = [words(t) for _, t in docs]
    count = Counter(tuple(w[k : k + n]) for w in lists for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(docs, lists, strict=True):
        gone = {j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def shingles(text, n=5):
    w = words(text, lower=True)
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def components(docs):
    """id -> (size, component) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def language_model(docs, pair_mass, triple_mass):
    """id -> (n_tokens, n_known, train_tokens, base, score)."""
    seqs = {i: [*words(t, lower=True), None] for i, t in docs}
    c = Counter()
    for i, w in seqs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update((x,) for x in w)
            c.update(zip(w, w[1:], strict=False))
            c.update(zip(w, w[1:], w[2:], strict=False))
    n = sum(v for k, v in c.items() if len(k) == 1)
    v = sum(len(k) == 1 for k in c)
    one = lambda z: (c[z,] + 0.5) / (n + 0.5 * (v + 1))
    two = lambda y, z: (c[y, z] + pair_mass * one(z)) / (c[y,] + pair_mass)
    three = lambda x, y, z: (c[x, y, z] + triple_mass * two(y, z)) / (c[x, y] + triple_mass)
    out = {}
    for i, w in seqs.items():
        p = [one(z) if k == 0 else two(w[0], z) if k == 1 else three(*w[k - 2 : k + 1]) for k, z in enumerate(w)]
        out[i] = (len(w), sum(c[z,] > 0 for z in w), n, sum(math.log10(one(z)) for z in w), sum(map(math.log10, p)))
    return out


def targets(sizes):
    """source -> target: raise all targets together by weight, and stop each at its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
