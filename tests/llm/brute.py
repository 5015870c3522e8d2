"""Plain restatements of the contracts, quadratic or worse, for small inputs."""

import hashlib
from collections import defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    raw = (text or "").encode()
    return (raw.translate(LOWER) if lower else raw).split()


class Sets:
    def __init__(self, keys):
        self.up = {k: k for k in keys}

    def root(self, k):
        while self.up[k] != k:
            k = self.up[k]
        return k

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def substrings(rows, window=20):
    """doc -> (words, removed, digest of what is left), rows being (doc_id, text)."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        left = [x for x, g in zip(w, gone) if not g]
        out[doc] = (len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


def jaccard(rows, n=4):
    """doc -> (set size, component)."""
    grams = {}
    for doc, text in rows:
        w = words(text, True)
        grams[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    s = Sets(grams)
    docs = [d for d in sorted(grams) if grams[d]]
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(grams[a] & grams[b])
            if 100 * both >= 85 * (len(grams[a]) + len(grams[b]) - both):
                s.join(a, b)
    return {d: (len(g), s.root(d)) for d, g in grams.items()}


def edits(item, stretch):
    """Least word edits between the item and any part of the stretch."""
    row = [0] * (len(stretch) + 1)
    for i, w in enumerate(item):
        nxt = [i + 1]
        for j, x in enumerate(stretch):
            nxt.append(min(row[j] + (w != x), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return min(row)


def embeddings(rows, least=0.98):
    """vec -> (links, component), rows being (vec_id, embedding, label)."""
    import numpy as np

    good = {}
    for v, e, label in rows:
        if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            x = np.array(e, np.float64)
            x = x / np.abs(x).max()
            good[v] = (x / np.linalg.norm(x), label)
    links, s = defaultdict(int), Sets([v for v, _, _ in rows])
    keys = sorted(good)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and float(good[a][0] @ good[b][0]) >= least:
                links[a] += 1
                links[b] += 1
                s.join(a, b)
    return {v: (links[v], s.root(v)) for v, _, _ in rows}
