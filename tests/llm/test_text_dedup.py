"""Substring removal, n-gram join and decontamination against brute force; odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iqlake.llm import decontamination, jaccard, substrings
from iqlake.llm.common import Words, components
from tests.llm import brute


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, base, passage = [], make(120), make(30)
    for i in range(12):  # near copies at different distances
        w = list(base)
        for _ in range(i):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    rows += [(20 + i, " ".join(make(40) + passage + make(rng.randrange(60)))) for i in range(6)]
    rows += [(40, " ".join(base)), (41, "  ".join(base) + "\n"), (42, " ".join(base).upper()), (50, None), (51, ""), (52, " \t\n"), (53, "one two"), (54, "One  two"), (55, "one"), (56, "same " * 70), (57, "same " * 30)]
    rows += [(60, " ".join(make(15) * 4)), (61, " ".join(make(3000))), (62, "é ü " + " ".join(passage)), (63, " ".join(passage[:19]))]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "x", 1, d) for d, t in corpus()]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, _runs long, _doc long").repartition(5)


@pytest.mark.parametrize("wide", [4096, 1])
def test_substrings(docs, monkeypatch, wide):
    monkeypatch.setattr(substrings, "WIDE", wide)
    got = substrings.dedup(docs)
    assert got.columns == ["doc_id", "text", "_runs", "_doc", "kept", "n_words", "n_removed"]
    assert got.where("_runs <> 1 or _doc <> doc_id").count() == 0
    found = {r.doc_id: (r.n_words, r.n_removed, r.h) for r in got.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("h")).collect()}
    assert found == brute.substrings(corpus())


def test_substrings_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert substrings.dedup(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"a{i}" for i in range(25))
    got = substrings.dedup(spark.createDataFrame([(None, text), (3, text), (3, text), (7, text)], schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 3, 0), (False, 3, 0), (False, 7, 25), (True, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=8))
def test_automaton(seqs):
    auto, held = substrings.Automaton(), []
    for s in seqs:
        want = [max((k for k in range(1, j + 2) if any(s[j + 1 - k : j + 1] == h[p : p + k] for h in held for p in range(len(h)))), default=0) for j in range(len(s))]
        assert auto.statistics(s) == want
        auto.add(s)
        held.append(s)


@pytest.mark.parametrize("block", [8192, 3])
def test_jaccard(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.join(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard(corpus())


def test_very_long_words(spark):
    long = "x" * 1_500_000
    rows = [(1, long), (2, f"a b {long} c d"), (3, f"a b {long} c D"), (4, long + "y"), (5, "é" * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == brute.jaccard(rows)
    got = substrings.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("h")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.h) for r in got} == brute.substrings(rows)


def test_jaccard_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.join(spark.createDataFrame([], schema)).count() == 0
    got = jaccard.join(spark.createDataFrame([(None, "a b c d"), (3, "a b c d e"), (3, "a b c d e"), (9, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (3, 2, 3), (3, 2, 3), (9, 0, 9)]


def copies_in_odd_order():
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = [*base[:-1], "other"]
    return [(None, " ".join(base)), *((i, " ".join(base)) for i in (9, 7, 5, 30)), (4, " ".join(near)), (12, " ".join(near)), (20, "x y"), (19, "X y")]


def test_jaccard_of_copies_that_are_not_ascending(spark):
    rows = copies_in_odd_order()
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute.jaccard(r for r in rows if r[0] is not None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want and want[9][1] == 4
    # the component's smallest doc_id is a copy without keys
    rows = [r for r in rows if r[0] != 4]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute.jaccard(r for r in rows if r[0] is not None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want and want[12][1] == 5


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_jaccard_in_any_order(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in rng.sample(range(100), 30):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            w[rng.randrange(len(w))] = f"v{rng.random()}"
        rows.append((i if rng.random() < 0.9 else None, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.join(docs.coalesce(1) if seed else docs.repartition(3)).collect()
    want = brute.jaccard(r for r in rows if r[0] is not None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) and all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_links_all_texts_of_a_doc_id(spark):
    rng = random.Random(9)
    x, y = ([f"{c}{rng.randrange(500)}" for _ in range(120)] for c in "xy")
    rows = [(8, " ".join(x)), (2, " ".join(x)), (8, " ".join(y)), (5, " ".join([*y[:-1], "other"])), (6, "alone")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (5, 2), (6, 6), (8, 2), (8, 2)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 2**40), min_size=7, max_size=300), st.data())
def test_linked_sets_share_a_key_and_have_close_sketches(a, data):
    a = np.array(sorted(a), np.uint64)
    b = a.copy()
    for _ in range(data.draw(st.integers(0, jaccard.difference(len(a))))):
        b = np.delete(b, data.draw(st.integers(0, len(b) - 1))) if data.draw(st.booleans()) else np.append(b, np.uint64(data.draw(st.integers(2**41, 2**50))))
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b))
    if 100 * both < 85 * (len(a) + len(b) - both):
        return
    keys = []
    for x in (a, b):
        bounds = np.array([0, len(x)])
        keys.append({int(k) for band in jaccard._bands_of(np.array([len(x)])) for k in jaccard._keys(x, bounds, band)[0]})
    assert keys[0] & keys[1]


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (95, 90), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 95: 90, 90: 90}


def test_words_are_as_the_contract_says():
    texts = ["a\x0bb\x0cc\x1cd", None, "", " x  y", "  z"]
    w = Words(pa.array(texts))
    got = [[bytes(w.data[w.starts[k] : w.ends[k]]) for k in range(w.bounds[i], w.bounds[i + 1])] for i in range(len(texts))]
    assert got == [brute.words(t) for t in texts]


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(3)
        if k == 0:
            del w[rng.randrange(len(w))]
        elif k == 1:
            w.insert(rng.randrange(len(w)), f"new{rng.random()}")
        else:
            w[rng.randrange(len(w))] = f"new{rng.random()}"
    return w


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {k: make(n) for k, n in enumerate([4, 8, 15, 30, 59] * 6)}
    rows, budget = [], {}
    for k, item in items.items():
        for rep, e in enumerate((0, decontamination.budget(len(item)) // 2, decontamination.budget(len(item)), decontamination.budget(len(item)) + 4)):
            rows.append((k * 10 + rep, " ".join(make(rng.randrange(40)) + edited(item, e, rng) + make(rng.randrange(40))), "x"))
    rows += [(900, None, "x"), (901, "", "x"), (None, " ".join(items[3]), "x"), (902, " ".join(items[4]).upper(), "x"), (903, " ".join(items[4][:20]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(98, None), (99, " ")], "item_id long, text string")
    got = decontamination.leaks(docs, bench).collect()
    want = {}
    for doc, text, _ in rows:
        for k, item in items.items():
            e = brute.edits(item, [w.decode() for w in brute.words(text, True)])
            if e <= decontamination.budget(len(item)):
                want[doc, k] = e
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert set(found) <= set(want) and all(found[p] >= want[p] for p in found)
    assert {p for p, e in want.items() if e == 0} <= set(found)
    assert len(found) >= 0.9 * len(want)
    kept = decontamination.remove(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in found}
    assert decontamination.leaks(spark.createDataFrame([], docs.schema), bench).count() == 0
    assert decontamination.leaks(docs, spark.createDataFrame([], bench.schema)).count() == 0


def test_long_items_are_found(spark, monkeypatch):
    rng = random.Random(11)
    make = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items = {k: make(600 + 40 * k) for k in range(6)}
    rows = [(10 * k + j, " ".join(make(30) + edited(w, decontamination.budget(len(w)), rng) + make(30))) for k, w in items.items() for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(70, " ".join(items[0])), (71, "  ".join(items[0]).upper())], "item_id long, text string")
    want = {(10 * k + j, i) for k in items for j in range(4) for i in ([0, 70, 71] if k == 0 else [k])}
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    monkeypatch.setattr(decontamination, "WALKS", 1)  # no recall to speak of: every window with a seed is verified
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == want


def test_decontamination_of_odd_tables(spark):
    item = " ".join(f"i{k}" for k in range(20))
    docs = spark.createDataFrame([(None, item, 1), (None, "fine", 1), (3, "fine", 1), (3, f"x {item}", 1), (3, f"x {item}", 1), (4, None, 1)], "doc_id long, text string, item long")
    bench = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, "fine", "x"), (2, "other", "x")], "item_id long, text string, doc_id string")
    assert sorted((r.doc_id or 0, r.item_id) for r in decontamination.leaks(docs, bench).collect()) == [(0, 1), (3, 1), (3, 1)]
    kept = decontamination.remove(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "fine"), (3, "fine"), (4, "")]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_edit_search(item, text):
    enc = lambda s: [x.encode() for x in s]
    assert decontamination.edit_search(enc(item), enc(text))[0] == brute.edits(item, text)
