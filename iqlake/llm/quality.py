"""Text quality: a generalised additive model with pairwise interactions, boosted in turn and scored from lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U64, Words, runs_of, steps
from .labelled import held_out, sample

#: Bins of a feature alone and in a pair; rounds of each; learning rate; pairs; least weight of a leaf.
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAF = 48, 8, 150, 60, 0.15, 10, 12
THRESHOLD = 0.3
NAMES = ("words", "word_length", "longest", "upper", "digits", "symbols", "stops", "marks", "beyond_ascii", "same_as_last", "distinct", "repeated_4", "lines", "line_words", "repeated_lines", "capital_words", "stop_words_share", "pipes", "no_letters")
_BYTE = {name: np.zeros(256, bool) for name in ("upper", "digit", "symbol", "stop", "mark", "letter")}
_BYTE["upper"][65:91] = True
_BYTE["digit"][48:58] = True
_BYTE["symbol"][[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?;:'\"-()"]] = True
_BYTE["stop"][[ord(c) for c in ".,"]] = True
_BYTE["mark"][[ord(c) for c in "!?;:"]] = True
_BYTE["letter"][[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def measure(texts: pa.Array) -> np.ndarray:
    """(texts, features): shares and counts of each whole text, NAMES in order. Empty texts are all zeros."""
    words = Words(texts)
    n_texts = len(texts)
    n = np.diff(words.bounds).astype(float)
    data, size = words.data, np.diff(words.offsets).astype(float)
    owner = np.repeat(np.arange(n_texts), np.diff(words.bounds))
    per_byte = np.maximum(size, 1)
    per_word = np.maximum(n, 1)

    def bytes_in(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask[data])]
        return (total[words.offsets[1:]] - total[words.offsets[:-1]]).astype(float)

    def words_in(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, n_texts)

    h = words.hashes(lower=True)
    length = (words.ends - words.starts).astype(float)
    longest = np.zeros(n_texts)
    np.maximum.at(longest, owner, length)
    same = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]

    def distinct(values: np.ndarray, whose: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, whose))
        v, o = values[order], whose[order]
        new = np.r_[True, (v[1:] != v[:-1]) | (o[1:] != o[:-1])] if len(v) else np.zeros(0, bool)
        return np.bincount(o[new], minlength=n_texts).astype(float)

    grams = runs_of(h, 4)
    inside = owner[: len(grams)] == owner[3:] if len(grams) else np.zeros(0, bool)
    grams, whose = grams[inside], owner[: len(inside)][inside]
    n_grams = np.bincount(whose, minlength=n_texts).astype(float)
    newline = np.zeros(256, bool)
    newline[10] = True
    breaks = bytes_in(newline)
    # a line is known by the sum of its words' hashes
    line = np.searchsorted(np.flatnonzero(data == 10), words.starts)
    first = np.r_[True, (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
    sums = np.add.reduceat(h, np.flatnonzero(first)) if len(h) else np.zeros(0, U64)
    line_owner = owner[first]
    n_lines = np.maximum(np.bincount(line_owner, minlength=n_texts), 1).astype(float)
    capital = _BYTE["upper"][data[words.starts]] if len(h) else np.zeros(0, bool)
    ends_stop = _BYTE["stop"][data[words.ends - 1]] if len(h) else np.zeros(0, bool)
    letters = np.r_[0, np.cumsum(_BYTE["letter"][data])]
    bare = letters[words.ends] == letters[words.starts] if len(h) else np.zeros(0, bool)
    pipes = np.zeros(256, bool)
    pipes[ord("|")] = True
    high = np.zeros(256, bool)
    high[128:] = True
    blank = bytes_in(SPACE)
    visible = np.maximum(per_byte - blank, 1)
    return np.stack([
        np.log1p(n), words_in(length) / per_word, longest, bytes_in(_BYTE["upper"]) / visible, bytes_in(_BYTE["digit"]) / visible, bytes_in(_BYTE["symbol"]) / visible, bytes_in(_BYTE["stop"]) / per_word, bytes_in(_BYTE["mark"]) / per_word,
        bytes_in(high) / visible, words_in(same) / per_word, distinct(h, owner) / per_word, (n_grams - distinct(grams, whose)) / np.maximum(n_grams, 1), np.log1p(breaks), n / n_lines, (np.bincount(line_owner, minlength=n_texts) - distinct(sums, line_owner)) / n_lines,
        words_in(capital) / per_word, words_in(ends_stop) / per_word, bytes_in(pipes) / per_word, words_in(bare) / per_word,
    ], axis=1)


@dataclass
class Additive:
    """Bin edges and lookup tables: one table per feature, one per pair of features, added up to a logit."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return z


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a row of bins into two, as (gain, first bin of the right side)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    able = (left_h >= LEAF / 4) & (h.sum() - left_h >= LEAF / 4)
    gains = np.where(able, gains, 0.0)
    k = int(gains.argmax())
    return float(gains[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over a row of bins: the step that each bin's value takes."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, k, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A tree that cuts one feature, then the other on either side: (gain, step of each cell)."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, len(a)):
            step, gain = np.zeros_like(a), -_gain(a.sum(), b.sum())
            for rows in (slice(0, k), slice(k, None)):
                gg, hh = a[rows].sum(0), b[rows].sum(0)
                _, c = _best(gg, hh)
                for cols in (slice(0, c), slice(c, None)):
                    if hh[cols].sum() > 0:
                        gain += _gain(gg[cols].sum(), hh[cols].sum())
                        step[rows, cols] = gg[cols].sum() / (hh[cols].sum() + 1.0)
            if gain > best[0]:
                best = (float(gain), step.T if flip else step)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting: each round gives every feature in turn one shallow tree on the gradient; then the same for pairs.

    Pairs are those whose best tree explains most of what the single features leave. Bins are quantiles of the sample. Without
    rows of both classes there is nothing to learn, and the score is constant.
    """
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Additive([_cuts(x[:, j], BINS) for j in range(x.shape[1])], [], bias=float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if not len(y) or y.min() == y.max():
        return model
    where = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.bias)

    def grads() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, at in enumerate(where):
            r, w = grads()
            step = RATE * _tree(np.bincount(at, r, len(model.tables[j])), np.bincount(at, w, len(model.tables[j])))
            model.tables[j] += step
            z += step[at]
    model.pair_edges = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    width = [len(e) + 1 for e in model.pair_edges]

    def sums(i: int, j: int, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = low[i] * width[j] + low[j]
        return tuple(np.bincount(cell, v, width[i] * width[j]).reshape(width[i], width[j]) for v in (r, w))

    r, w = grads()
    ranked = sorted(((_pair_tree(*sums(i, j, r, w))[0], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            r, w = grads()
            step = RATE * _pair_tree(*sums(i, j, r, w))[1]
            model.pair_tables[k] += step
            z += step[low[i], low[j]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch):
            x = measure(step.column(0))
            yield pa.RecordBatch.from_arrays([step.column(1), pa.array([row.tobytes() for row in x], pa.binary())], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Additive:
    """Fit on a bounded sample of labelled rows outside the held-out fold: the driver gets a few numbers per sampled row."""
    got = sample(docs, labels, "quality").select("text", "y").mapInArrow(_measured, "y int, x binary").collect()
    got.sort(key=lambda r: (bytes(r.x), r.y))
    x = np.frombuffer(b"".join(bytes(r.x) for r in got)).reshape(-1, len(NAMES))
    return train(x, np.array([r.y > 0 for r in got], float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """``docs`` with held_out, score and predicted (score >= THRESHOLD). Null and empty texts are measured as empty; columns
    of these names are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                z = model.logits(measure(step.column(step.schema.get_field_index("text"))))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*step.columns, pa.array(p)], names=[*step.schema.names, "score"])

    docs = docs.drop("held_out", "score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double").select(*(f"`{c}`" for c in docs.columns), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
