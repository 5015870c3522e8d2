"""Held-out accuracy, the counterfactual penalty, the additive model's tables; odd inputs."""

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from iqlake.llm import labelled, quality, toxicity
from tests.llm import brute


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize(("module", "column", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.97)])
def test_held_out(spark, module, column, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    got = module.score(docs, model)
    rows = got.join(labels, "doc_id").where("held_out").select(column, "score", "predicted").toPandas()
    assert auc(rows[column].values, rows.score.values) > least
    assert (rows.predicted == rows[column]).mean() > 0.95
    assert got.count() == docs.count() and got.where("score < 0 or score > 1").count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.select("doc_id", "held_out").limit(200).collect())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_inputs(spark, module):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "w " * 50_000, "d"), (5, "w" * 400_000, "d"), (3, "w", "e"), (3, "w", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], labels.schema)
    for lab in (labels, none):
        got = module.score(docs, module.fit(docs, lab))
        assert got.columns == ["doc_id", "text", "held_out", "score", "predicted"] and got.count() == 7
        assert got.where("score is null or isnan(score) or score < 0 or score > 1").count() == 0
    empty = spark.createDataFrame([], docs.schema)
    assert module.score(empty, module.fit(empty, labels)).count() == 0


def mentions():
    """(training texts with labels, neutral texts that mention the group): toxic texts speak of one group, neutral ones of another,
    and many toxic texts have nothing else that tells them apart."""
    rng = random.Random(1)
    plain, slurs = [f"{rng.randrange(16**8):08x}" for _ in range(150)], [f"slur{i}" for i in range(10)]
    rows = []
    for i in range(2000):
        words = [rng.choice(plain) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic and rng.random() < 0.6:
            words.append(rng.choice(slurs))
        if rng.random() < (0.8 if toxic else 0.05):
            words.append("Muslims,")
        elif rng.random() < 0.6:
            words.append("Buddhists")
        rng.shuffle(words)
        rows.append((" ".join(words), int(toxic)))
    neutral = [" ".join([*(rng.choice(plain) for _ in range(20)), "muslims", *(rng.choice(plain) for _ in range(10))]) for _ in range(200)]
    return rows, neutral


def test_swapping_terms_spares_neutral_mentions(spark, monkeypatch):
    rows, neutral = mentions()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    swapped = pa.array([t.replace("muslims", "buddhists") for t in neutral])
    false, moved, caught = {}, {}, {}
    for weight in (0.0, toxicity.SWAP_WEIGHT):
        monkeypatch.setattr(toxicity, "SWAP_WEIGHT", weight)
        model = toxicity.fit(docs, labels)
        z = model.logits(pa.array(neutral))
        false[weight], moved[weight] = (z > 0).mean(), np.abs(z - model.logits(swapped)).mean()
        held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
        caught[weight] = auc(np.array([rows[i][1] for i in held]), model.logits(pa.array([rows[i][0] for i in held])))
    free, bound = sorted(false)
    assert false[free] > 0.3 and false[bound] < 0.4 * false[free]
    assert moved[bound] < 0.2 * moved[free] and caught[bound] > 0.75


def test_all_terms_of_a_text_are_swapped_at_once():
    text = "Old Muslims (and CHRISTIANS) met; the old whitespace stays"
    for shift, want in ((1, "young christians and jews met the young whitespace stays"), (3, "teenage hindus and buddhists met the teenage whitespace stays")):
        f, owner = toxicity.counterfactuals(toxicity.by_kind(toxicity.Words(pa.array(["no terms", text]))), shift)
        assert set(owner.tolist()) == {1} and sorted(f.tolist()) == sorted(toxicity.features(toxicity.Words(pa.array([want])))[0].tolist())


def test_sample_has_one_row_per_labelled_document(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, "x"), (3, None), (4, "not labelled")], "doc_id long, text string")
    ids = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (2, 1)], "doc_id long, toxic int")
    want = [r for r in ((1, "t0", 1), (2, "x", 1), (3, None, 1)) if zlib.crc32(str(r[0]).encode()) % 5]
    assert sorted(tuple(r) for r in labelled.sample(docs, ids, "toxic").collect()) == want
    assert labelled.sample(docs, ids, "toxic", limit=1).count() == 1


def test_logits_are_sums_of_weights_of_distinct_features():
    def plain(text):
        out = set()
        for w in (text or "").encode().translate(brute.LOWER).split():
            w = w.strip(bytes(b for b in range(33, 127) if not chr(b).isalnum()))
            if w:
                out |= {int(f) for f in toxicity.features_of(w.decode("utf-8", "surrogateescape"))}
        return out

    texts = ["Hello, hello!! world", None, "", "(((((((loser))))))) LOSER", "x" * 70 + " " + "x" * 69 + "y", "w" * 300_000, "... !!", "naïve señor 日本"]
    names = np.array(sorted({f for t in texts for f in plain(t)})[::2], np.uint64)
    weights = np.arange(1.0, len(names) + 1)
    model = toxicity.Model(names, weights, -2.0)
    table = dict(zip(names.tolist(), weights.tolist(), strict=True))
    assert model.logits(pa.array(texts)).tolist() == [-2.0 + sum(table.get(f, 0) for f in plain(t)) for t in texts]
    assert toxicity.feature_of("x" * 69 + "y") != toxicity.feature_of("x" * 70)


def test_features_ignore_case_and_outer_punctuation():
    one = lambda t: {int(x) for x in toxicity.features(toxicity.Words(pa.array([t])))[0]}
    assert one("Loser!!") == one("(loser)") and toxicity.feature_of("loser") in one('"LOSER,"')
    assert one("...") == set() and one("") == set()


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (1, 0) in model.pairs
    assert auc(y, model.logits(x)) > 0.95
    z = sum((t[np.searchsorted(e, x[:, j], side="right")] for j, (e, t) in enumerate(zip(model.edges, model.tables))), np.full(len(x), model.bias))
    assert auc(y, z) < 0.7


def test_additive_logits_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    model = quality.train(rng.random((400, 3)), (rng.random(400) > 0.4).astype(float))
    assert model.pairs
    for row in [*rng.random((50, 3)), np.zeros(3), np.ones(3) * 9, *(np.array([e[0]] * 3) for e in model.edges)]:
        at = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, row, strict=True)]
        low = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.pair_edges, row, strict=True)]
        want = model.bias + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[low[i], low[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert np.isclose(model.logits(row[None])[0], want)


def test_few_rows_are_learnt_from_like_many():
    x = np.repeat([[0.0], [1.0]], 20, axis=0)
    model = quality.train(x, x[:, 0])
    assert auc(x[:, 0], model.logits(x)) == 1.0


def plain_measures(text):
    raw = (text or "").encode()
    w = raw.split()
    low = [x.translate(brute.LOWER) for x in w]
    if not raw:
        return [0.0] * len(quality.NAMES)
    grams = [tuple(low[i : i + 4]) for i in range(len(w) - 3)]
    lines = [line.translate(brute.LOWER).split() for line in raw.split(b"\n")]
    lines = [tuple(sorted(line)) for line in lines if line]
    seen = max(1, sum(b not in b" \t\n\r\x0b\x0c" for b in raw))
    some, n_lines = max(1, len(w)), max(1, len(lines))
    count = lambda chars: sum(b in chars for b in raw)
    symbols = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!?;:'\"-()")
    letter = lambda b: b >= 128 or chr(b).isalpha()
    return [
        np.log1p(len(w)), sum(map(len, w)) / some, max(map(len, w), default=0), count(bytes(range(65, 91))) / seen, count(b"0123456789") / seen, count(symbols) / seen, count(b".,") / some, count(b"!?;:") / some,
        sum(b > 127 for b in raw) / seen, sum(a == b for a, b in zip(low, low[1:])) / some, len(set(low)) / some, (len(grams) - len(set(grams))) / max(1, len(grams)), np.log1p(count(b"\n")), len(w) / n_lines, (len(lines) - len(set(lines))) / n_lines,
        sum(65 <= x[0] <= 90 for x in w) / some, sum(x[-1] in b".," for x in w) / some, count(b"|") / some, sum(not any(map(letter, x)) for x in w) / some,
    ]


def test_measures_against_plain_ones():
    texts = ["Hello hello. World!\nA | b", "", None, "x y x y x y x y", "日本 9", " \n\n ", "a b\nb a\na b\n", "z" * 100_000, "$$$ ### 12, Ünï; (ok) \"q\""]
    got = quality.measure(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain_measures(t)), t


def test_measures_are_by_text():
    texts = ["Hello hello. World!\nA | b", "", None, "x y x y x y x y", "日本 9"]
    together = quality.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(quality.measure(pa.array([t]))[0], together[i])
    assert not together[1].any() and not together[2].any()
