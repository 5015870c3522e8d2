"""Toxicity: logistic regression on word features, regularised so that swapping identity terms hardly moves a score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_CODES, U64, WORD_BASE, Words, batch_of, mix, powers, steps
from .labelled import held_out, sample

#: Features kept; documents a feature has to be in; weights of the counterfactual and of the plain penalty.
FEATURES, LEAST, SWAP_WEIGHT, RIDGE = 4096, 4, 5.0, 3e-5
#: Prefixes of words, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Terms that name groups of people, by kind; a counterfactual replaces each term of a text by another one of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
_KIND = (U64(0x9AE16A3B2F90404F), *(U64(0xC949D7C7509E6557 + 2 * k) for k in PREFIXES))
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_POWERS = powers(WORD_BASE, max(PREFIXES))


def bare(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word without all of its outer punctuation; words of punctuation alone are left out."""
    solid = ~_PUNCTUATION[words.data]
    place = np.arange(len(solid))
    after = np.minimum.accumulate(np.where(solid, place, len(solid))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(solid, place, -1))
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    starts, ends = (after[words.starts], before[words.ends - 1] + 1) if len(words.starts) else (words.starts, words.ends)
    some = ends > starts
    return starts[some], ends[some], text[some]


def _whole(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of all bytes of each word, A-Z taken for a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    value = LOWER_CODES[data] * inside
    value *= powers(WORD_BASE, int((ends - starts).max()) + 1)[np.where(inside, place, 0)]
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(U64))


def by_kind(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, text, word) of each kind: the whole words first, then each length of prefix; ``word`` numbers the bare words."""
    starts, ends, text = bare(words)
    size, number = ends - starts, np.arange(len(starts))
    out = [(mix(_whole(words.data, starts, ends) ^ _KIND[0]), text, number)]
    for kind, most in zip(_KIND[1:], PREFIXES, strict=True):
        use = size >= most
        total = np.zeros(int(use.sum()), U64)
        for j in range(most):
            total += LOWER_CODES[words.data[starts[use] + j]] * _POWERS[j]
        out.append((mix(total ^ kind), text[use], number[use]))
    return out


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text), a row for each word and kind: the word without outer punctuation, in lower case, and its prefixes."""
    f, text, _ = zip(*by_kind(words), strict=True)
    return np.concatenate(f), np.concatenate(text)


def features_of(term: str) -> np.ndarray:
    """The features of a single word: itself, then its prefixes."""
    return features(Words(pa.array([term])))[0]


def feature_of(term: str) -> int:
    """The feature of a word as a whole."""
    return int(features_of(term)[0])


def _distinct(f: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((f, text))
    f, text = f[order], text[order]
    new = np.r_[True, (f[1:] != f[:-1]) | (text[1:] != text[:-1])] if len(f) else np.zeros(0, bool)
    return f[new], text[new]


_COUNT_SCHEMA = pa.schema([("feature", pa.int64()), ("yes", pa.int64()), ("no", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the documents of each class that have a feature."""
    parts, held = [], 0

    def summed() -> pa.RecordBatch:
        f, yes = (np.concatenate(c) for c in zip(*parts, strict=True))
        names, where, n = np.unique(f, return_inverse=True, return_counts=True)
        y = np.bincount(where, yes, len(names)).astype(np.int64)
        return batch_of(_COUNT_SCHEMA, names, y, n - y)

    for batch in batches:
        for step in steps(batch):
            y = step.column(1).to_numpy(zero_copy_only=False)
            f, text = _distinct(*features(Words(step.column(0))))
            parts.append((f, y[text]))
            held += len(f)
            if held > 500_000:
                yield summed()
                parts, held = [], 0
    if held:
        yield summed()


@dataclass(frozen=True)
class Model:
    """Sorted features with their weights, and the intercept."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Sum of the weights of each text's distinct features."""
        words = Words(texts)
        f, text = features(words)
        out = np.full(len(texts), self.bias)
        if not len(self.names) or not len(f):
            return out
        table = np.zeros(1 << 18, bool)
        table[(self.names & U64((1 << 18) - 1)).astype(np.int64)] = True
        some = table[(f & U64((1 << 18) - 1)).astype(np.int64)]
        f, text = f[some], text[some]
        at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
        hit = self.names[at] == f
        pair = np.unique(text[hit] * len(self.names) + at[hit])
        np.add.at(out, pair // len(self.names), self.weights[pair % len(self.names)])
        return out


@cache
def _replacements(shift: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted features of the identity terms as whole words, and the features of the term that replaces each."""
    terms = [(feature_of(t), features_of(group[(i + shift) % len(group)])) for group in IDENTITY for i, t in enumerate(group)]
    terms.sort(key=lambda x: x[0])
    return np.array([n for n, _ in terms], U64), [o for _, o in terms]


def counterfactuals(kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]], shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the texts that hold identity terms, after each of these terms has been replaced by the one ``shift``
    places on in its kind. ``kinds``: the texts' features, from ``by_kind``."""
    names, others = _replacements(shift)
    whole, text, _ = kinds[0]
    at = np.minimum(np.searchsorted(names, whole), len(names) - 1)
    hit = names[at] == whole
    met = np.unique(text[hit])
    out, owner = [], []
    for f, t, word in kinds:
        stays = np.isin(t, met) & ~hit[word]
        out.append(f[stays])
        owner.append(t[stays])
    for i in np.flatnonzero(hit).tolist():
        out.append(others[at[i]])
        owner.append(np.full(len(others[at[i]]), text[i]))
    return np.concatenate(out), np.concatenate(owner)


#: Swaps of a text: as many as it takes to reach every other term of the largest kind.
SHIFTS = range(1, max(map(len, IDENTITY)))


@dataclass(frozen=True)
class Swapped:
    """Swapped copies of labelled rows by what tells them from the row: entries (copy, feature, +1 lost or -1 gained), and the
    weight of each copy, the copies of one row having 1 together."""

    copies: np.ndarray
    cols: np.ndarray
    signs: np.ndarray
    weights: np.ndarray


def fit_weights(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int, swapped: Swapped, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features (rows, cols), by Adam on all rows.

    The loss is the mean over rows of the log loss and of SWAP_WEIGHT times the squared change of the row's logit when its
    identity terms are swapped for others of their kind (averaged over its swapped copies), and RIDGE * |w|^2.
    """
    w, b = np.zeros(n_features), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m = v = np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(rows, w[cols], len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gap = (p - y) / len(y)
        g = np.bincount(cols, gap[rows], n_features) + 2 * RIDGE * w
        change = np.bincount(swapped.copies, swapped.signs * w[swapped.cols], len(swapped.weights))
        rate = 2 * SWAP_WEIGHT / len(y) * swapped.weights * change
        g += np.bincount(swapped.cols, swapped.signs * rate[swapped.copies], n_features)
        g = np.r_[g, gap.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


_PICKED = pa.schema([("doc_id", pa.int64()), ("shift", pa.int32()), ("y", pa.int32()), ("f", pa.binary()), ("gained", pa.binary())])


def _picker(names: np.ndarray):
    """Rows (doc_id, text, y) as places of their features in ``names`` (shift 0) and, for each swap that changes these, the places
    lost and gained."""

    def places(f: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
        f, text = _distinct(f, text)
        at = np.minimum(np.searchsorted(names, f), len(names) - 1)
        hit = names[at] == f
        at, text = at[hit].astype(np.int32), text[hit]
        return np.split(at, np.searchsorted(text, np.arange(1, n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                words, n = Words(step.column(1)), step.num_rows
                ids, y = step.column(0).to_pylist(), step.column(2).to_pylist()
                kinds = by_kind(words)
                own = places(*(np.concatenate(c) for c in (*zip(*kinds, strict=True),)[:2]), n)
                out = [(ids[i], 0, y[i], own[i].tobytes(), b"") for i in range(n)]
                for shift in SHIFTS:
                    f, text = counterfactuals(kinds, shift)
                    swapped = places(f, text, n)
                    for i in np.unique(text).tolist():
                        lost, gained = np.setdiff1d(own[i], swapped[i]), np.setdiff1d(swapped[i], own[i])
                        if len(lost) or len(gained):
                            out.append((ids[i], shift, y[i], lost.tobytes(), gained.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PICKED, strict=True)], schema=_PICKED)

    return run


def _swapped(copies: list) -> Swapped:
    """The swapped copies of labelled rows (rows of ``_picker`` with a shift)."""
    count: dict[int, int] = {}
    for r in copies:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    numbers, cols, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k, r in enumerate(copies):
        for raw, sign in ((r.f, 1.0), (r.gained, -1.0)):
            at = np.frombuffer(bytes(raw), np.int32).astype(np.int64)
            numbers.append(np.full(len(at), k))
            cols.append(at)
            signs.append(np.full(len(at), sign))
    return Swapped(np.concatenate(numbers), np.concatenate(cols), np.concatenate(signs), np.array([1 / count[r.doc_id] for r in copies]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    Features are chosen by how far their document counts in the two classes are from proportion; those of the identity terms
    are kept whatever their counts. Only the chosen ones of each sampled document, and what swaps of its identity terms change,
    come to the driver. With one class only, or no labelled rows, the score is constant.
    """
    rows = sample(docs, labels, "toxic").select(F.col("doc_id").cast("long"), "text", (F.col("y") > 0).cast("int").alias("y"))
    totals = rows.agg(F.sum("y").alias("yes"), F.count(F.lit(1)).alias("n")).first()
    yes, n = totals.yes or 0, totals.n
    if not yes or yes == n:
        return Model(np.zeros(0, U64), np.zeros(0), -8.0 if not yes else 8.0)
    counts = rows.select("text", "y").mapInArrow(_count, "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    both = F.col("yes") + F.col("no")
    share = yes / n
    apart = F.abs(F.col("yes") - both * share) / F.sqrt(both * share * (1 - share) + 1)
    best = [r.feature for r in counts.where(both >= LEAST).orderBy(apart.desc(), "feature").limit(FEATURES).select("feature").collect()]
    terms = np.concatenate([features_of(t) for group in IDENTITY for t in group])
    names = np.unique(np.r_[np.array(best, np.int64).view(U64), terms])
    got = rows.mapInArrow(_picker(names), "doc_id long, shift int, y int, f binary, gained binary").collect()
    own = sorted((r for r in got if not r.shift), key=lambda r: r.doc_id)
    cols = np.frombuffer(b"".join(bytes(r.f) for r in own), np.int32).astype(np.int64)
    copies = sorted((r for r in got if r.shift), key=lambda r: (r.doc_id, r.shift))
    w, b = fit_weights(np.repeat(np.arange(len(own)), [len(r.f) // 4 for r in own]), cols, np.array([r.y for r in own], float), len(names), _swapped(copies))
    return Model(names, w, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with held_out, score and predicted. Null and empty texts get the intercept's score; columns of these names are
    replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch):
                z = model.logits(step.column(step.schema.get_field_index("text")))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*step.columns, pa.array(p)], names=[*step.schema.names, "score"])

    docs = docs.drop("held_out", "score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, score double").select(*(f"`{c}`" for c in docs.columns), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
