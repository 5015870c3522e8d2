"""Benchmark decontamination: CGK embedding and bit sampling find item-sized windows, edit distance decides.

The CGK walk copies a sequence with random repeats; sequences at a small edit distance give embeddings at a small Hamming
distance. Sampling a few places of the embedding gives a hash that such windows share with the item, and repetitions bring
the recall to a target that is measured on edited copies of the items themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, mix, runs_of, steps, stored

#: Share of an item's words that may be edited; recall to reach; places sampled in a repetition.
EDITS, RECALL, SAMPLED = 0.2, 0.95, 2
#: Edited copies that recall is measured on; repetitions beyond which all windows with a seed are verified instead.
PROBES, WALKS = 200, 256
#: Bytes of item texts that one pass over the documents takes along; more items take more passes.
SHARD_BYTES = 4 << 20
_SEED = 97
_ROWS = "doc_id long, item long, start long, n_words long, edits long, n_hits long"


def budget(m: int) -> int:
    """Word edits allowed in an item of m words."""
    return int(m * EDITS + 1e-9)


def seed_length(m: int) -> int:
    """By pigeonhole, within the budget at least one run of this many words of the item stays as it is."""
    return m // (budget(m) + 1)


class Walks:
    """The sampled places of R independent CGK walks over sequences of m words."""

    def __init__(self, m: int, repetitions: int):
        self.m, self.steps = m, 3 * m
        odd, places = [], []
        for r in range(repetitions):  # a walk is the same however many there are
            rng = np.random.default_rng((_SEED, m, r))
            odd.append(rng.integers(1, 1 << 63, self.steps, dtype=np.int64).astype(U64) * U64(2) + U64(1))
            # places late in a walk have drifted furthest apart, so they are sampled from the first 2m, which cover the item
            places.append(np.sort(rng.permutation(2 * m)[:SAMPLED]))
        self.odd, self.places = np.array(odd, U64), np.array(places, np.int64)

    def keys(self, x: np.ndarray, r: int) -> np.ndarray:
        """Hashes of the sampled symbols of each row of ``x`` (sequences, m) in repetition r."""
        return self.all_keys(x, [r])[0]

    def all_keys(self, x: np.ndarray, which: list[int]) -> np.ndarray:
        """(repetitions, sequences): the keys of several repetitions at once."""
        padded = np.hstack([x, np.zeros((len(x), 1), U64)]).ravel()
        first = np.arange(len(x)) * (self.m + 1)
        at, end = np.tile(first, (len(which), 1)), first + self.m
        odd, places = self.odd[which], self.places[which]
        key = np.repeat(np.array(which, U64)[:, None] + U64(1), len(x), axis=1)
        for t in range(int(places.max()) + 1):
            symbol = padded[at]
            if (now := np.flatnonzero((places == t).any(1))).size:
                key[now] = mix(key[now] * U64(31) + symbol[now])
            at = np.minimum(at + (symbol * odd[:, t : t + 1] >> U64(63)).astype(np.int64), end)
        return key


def _edited(x: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """A copy with that many random word edits, cut or filled up to its old length as a window would be."""
    y = list(x)
    for _ in range(edits):
        kind, i = rng.integers(3), int(rng.integers(max(1, len(y))))
        if kind == 0 and len(y) > 1:
            del y[i]
        elif kind == 1:
            y.insert(i, U64(rng.integers(1, 1 << 62)))
        else:
            y[i] = U64(rng.integers(1, 1 << 62))
    y += [U64(rng.integers(1, 1 << 62)) for _ in range(len(x))]
    return np.array(y[: len(x)], U64)


def repetitions(items: list[np.ndarray], m: int) -> int:
    """Repetitions that reach RECALL for items of m words at the full edit budget, or 0 where WALKS don't.

    Measured with the index's own walks on edited copies of the items: the share that any of them has found.
    """
    e = budget(m)
    if not e:
        return 1
    rng = np.random.default_rng((_SEED, m, 1))
    source = [items[i % len(items)] for i in range(PROBES)]
    x, y = np.array(source, U64), np.array([_edited(s, e, rng) for s in source], U64)
    walks, found = Walks(m, WALKS), np.zeros(PROBES, bool)
    for which in _batches(WALKS):
        for r, hit in zip(which, walks.all_keys(x, which) == walks.all_keys(y, which), strict=True):
            found |= hit
            if found.mean() >= RECALL:
                return r + 1
    return 0


def _batches(n: int) -> list[list[int]]:
    """Numbers below n, 16 at a time."""
    return [list(range(a, min(n, a + 16))) for a in range(0, n, 16)]


class Index:
    """Seeds, walks and buckets of a shard of items."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items, self.bits, self.lasts = [], [], []
        by_length: dict[int, list[int]] = {}
        for item, words in items:
            block = Words(pa.array([b" ".join(words)], pa.binary()))
            by_length.setdefault(len(words), []).append(len(self.items))
            self.items.append((item, words, block.hashes(lower=True)))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, (_, words, h) in enumerate(self.items):
            q = max(1, seed_length(len(words)))
            found.setdefault(q, []).extend((int(g), k, o) for o, g in enumerate(runs_of(h, q)))
        for q, rows in found.items():
            rows.sort()
            table = np.zeros(1 << 20, bool)
            grams = np.array([g for g, _, _ in rows], U64)
            table[(grams & U64((1 << 20) - 1)).astype(np.int64)] = True
            self.seeds[q] = (table, grams, np.array([k for _, k, _ in rows], np.int64), np.array([o for _, _, o in rows], np.int64))
        self.walks, self.buckets = {}, {}
        for m, ks in by_length.items():
            x = [self.items[k][2] for k in ks]
            n = repetitions(x, m)
            self.walks[m], self.buckets[m] = Walks(m, n), []
            for which in _batches(n):
                self.buckets[m] += [self._bucket(keys, ks) for keys in self.walks[m].all_keys(np.array(x, U64), which).tolist()]

    @staticmethod
    def _bucket(keys: list[int], ks: list[int]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for key, k in zip(keys, ks, strict=True):
            out.setdefault(key, []).append(k)
        return out

    def windows(self, h: np.ndarray, text: np.ndarray) -> dict[int, np.ndarray]:
        """By item length, rows (text, start, item) of windows that have a seed in the place where the item has it."""
        lengths = np.array([len(h_) for _, _, h_ in self.items], np.int64)
        out: dict[int, list[np.ndarray]] = {}
        for q, (table, grams, ks, offsets) in self.seeds.items():
            g = runs_of(h, q)
            at = np.flatnonzero(table[(g & U64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(grams, g[at], "left"), np.searchsorted(grams, g[at], "right")
            n = hi - lo
            place = np.repeat(at, n)
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            # a window may stick out of its text by the edit budget; it is filled up with neutral symbols there
            fits = text[place + q - 1] == text[place]
            place, entry = place[fits], entry[fits]
            item = ks[entry]
            rows = np.stack([text[place], place - offsets[entry], item], 1)
            for length in np.unique(lengths[item]):
                out.setdefault(int(length), []).append(rows[lengths[item] == length])
        return {m: np.unique(np.concatenate(r), axis=0) for m, r in out.items()}

    def candidates(self, h: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray) -> set[tuple[int, int, int]]:
        """(text, item, window start) of windows that share a bucket with an item. ``first``, ``last``: each text's word range."""
        out: set[tuple[int, int, int]] = set()
        for m, rows in self.windows(h, text).items():
            if not self.buckets[m]:
                out.update((o, k, s) for o, s, k in rows.tolist())
                continue
            pairs = np.unique(rows[:, :2], axis=0)
            block = max(64, (1 << 18) // m)
            for a in range(0, len(pairs), block):
                own, s = pairs[a : a + block].T
                idx = s[:, None] + np.arange(m)
                inside = (idx >= first[own][:, None]) & (idx < last[own][:, None])
                x = np.where(inside, h[np.clip(idx, 0, len(h) - 1)], U64(1))
                for which in _batches(len(self.buckets[m])):
                    for r, keys in zip(which, self.walks[m].all_keys(x, which), strict=True):
                        bucket = self.buckets[m][r]
                        for i in np.flatnonzero(np.isin(keys, np.fromiter(bucket, U64, len(bucket)))).tolist():
                            out.update((int(own[i]), k, int(s[i])) for k in bucket[int(keys[i])])
        return out


def edit_search(item: list[bytes], words: list[bytes]) -> tuple[int, int]:
    """(least word edits between the item and a stretch of ``words``, end of the first such stretch). Bit-parallel."""
    m = len(item)
    masks: dict[bytes, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(words):
        eq = masks.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(horizontal | plus), plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        if score < best:
            best, end = score, j + 1
    return best, end


def _finds(index: Index, texts: pa.Array) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """By (text, item): (edits, last word, end within its stretch) of each verified window."""
    words = Words(texts)
    h = words.hashes(lower=True)
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    if not len(h):
        return best
    first, last = words.bounds[:-1], words.bounds[1:]
    text = np.repeat(np.arange(len(first)), last - first)
    for owner, k, s in index.candidates(h, text, first, last):
        item = index.items[k][1]
        slack = budget(len(item))
        a, b = max(int(first[owner]), s - slack), min(int(last[owner]), s + len(item) + slack)
        stretch = [words.data[words.starts[i] : words.ends[i]].tobytes().lower() for i in range(a, b)]
        edits, end = edit_search(item, stretch)
        if edits <= slack:
            best.setdefault((owner, k), []).append((edits, a + end - int(first[owner]), end))
    return best


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in (step for batch in batches for step in steps(batch)):
            if best := _finds(index, step.column(1)):
                ids, rows = step.column(0).to_pylist(), []
                for (owner, k), hits in sorted(best.items()):
                    edits, end, _ = min(hits)
                    m = len(index.items[k][1])
                    rows.append((ids[owner], index.items[k][0], max(0, end - m), m, edits, len({e for _, e, _ in hits})))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _ROWS.split(", ")])

    return run


def _without(index: Index, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in (step for batch in batches for step in steps(batch, batch.schema.names[column])):
            keep = np.ones(step.num_rows, bool)
            keep[[owner for owner, _ in _finds(index, step.column(column))]] = False
            yield step.filter(pa.array(keep))

    return run


def _shards(items: DataFrame) -> tuple[DataFrame, list[Index]]:
    """((item, item_id), indexes): the ids of each different item, and indexes of bounded shards of these items' words."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.array_join(F.filter(F.split(plain, r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    said = items.where("text is not null").select(F.col("item_id").cast("long"), words.alias("words")).where("words <> ''")
    different = said.groupBy("words").agg(F.min("item_id").alias("item"))
    total = different.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / SHARD_BYTES))
    different = stored(different.where("item is not null"), "items")
    names = said.join(different, "words").select("item", "item_id").where("item_id is not null").distinct()
    of = lambda s: different.where(F.pmod(F.xxhash64("words"), F.lit(n)) == s).orderBy("item").collect()
    return names, [Index([(r.item, r.words.encode().split(b" ")) for r in rows]) for s in range(n) if (rows := of(s))]


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, edits, n_hits): stretches of documents that repeat a benchmark item.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; an item is found where a stretch of a text is at most
    EDITS times its words away in word edits. ``start`` is the stretch's first word for the least edits (its end less the
    item's length), ``n_hits`` the number of different ends. Windows that share no run of words with an item that the edit
    budget can't destroy are left out before hashing, which loses nothing, as no window within the budget is without one;
    hashing reaches RECALL at the full budget, and all of the unedited copies; item lengths for which it doesn't within
    WALKS repetitions have all windows with such a run verified. Items with equal words share their finds. Null and
    word-less items and texts, and items without item_id, find nothing; documents with a null doc_id are searched too; rows
    that share a doc_id each give their rows; other columns are not looked at. Benchmarks of over SHARD_BYTES / 2 bytes are
    searched for in as many passes over the documents as they have shards.
    """
    names, indexes = _shards(items)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], _ROWS)
    for k, index in enumerate(indexes):
        found = rows.mapInArrow(_search(index), _ROWS)
        out = found if k == 0 else out.union(found)
    return out.join(names, "item").select("doc_id", "item_id", "start", "n_words", "edits", "n_hits")


def remove(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no benchmark item is found in, with all their columns, whether they have a doc_id or not.

    Rows pass all shards of the benchmark one after the other in a single scan, and are not shuffled.
    """
    _, indexes = _shards(items)
    names = list(docs.columns)
    safe = docs.toDF(*(f"c{i}" for i in range(len(names))))
    for index in indexes:
        safe = safe.mapInArrow(_without(index, names.index("text")), safe.schema)
    return safe.toDF(*names)
