"""Whitening against NumPy's eigenvectors of the covariance, and odd inputs."""

import numpy as np
import pytest

from iqlake.llm import queries, whitening


def brute(rows):
    """vec_id -> (n, deviation, whitened or None, explained), rows being (vec_id, vector) of one width."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in e] for _, e in rows], object)
    u = np.array(sorted(set(map(tuple, x))), object)
    n, s = len(u), u.sum(0)
    c = np.array(u - s / n, float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(16, x.shape[1])
    white = np.array(x - s / n, float) @ vectors[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
    return n, [int(d) for d in ((n * x - s) ** 2).sum(1)], white, values[:k] / max(values.sum(), 1e-300), values[:k] > 1e-9 * max(values.max(), 1)


def check(rows, got):
    n, far, white, share, real = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, r)
    mine = np.array([[by[v][c + 1].whitened if real[c] else 0 for c in range(len(real))] for v, _ in rows], float)
    sign = np.where((mine * white).sum(0) < 0, -1, 1)
    assert np.allclose(mine[:, real], (white * sign)[:, real], atol=1e-6)
    for i, (v, _) in enumerate(rows):
        for c in range(len(real)):
            r = by[v][c + 1]
            assert (r.n, int(r.deviation)) == (n, far[i]) and abs(r.explained - share[c]) <= 1e-9 and r.identity_error <= 1e-4
            assert (r.whitened is None) == (not real[c])


@pytest.mark.parametrize(("width", "count", "parts"), [(3, 400, 5), (20, 700, 9), (24, 10, 4), (1, 50, 3)])
def test_whitening(spark, width, count, parts):
    rng = np.random.default_rng(width)
    mix = rng.normal(size=(width, width)) * np.linspace(3, 0.3, width)
    rows = [(i, (rng.normal(size=width) @ mix + 5).astype(np.float32).tolist()) for i in range(count)]
    rows += [(count + i, rows[i % 3][1]) for i in range(count // 3)]  # copies count once
    df = spark.createDataFrame([(v, e, "c", 7) for v, e in rows], "vec_id long, embedding array<float>, dims string, n int").repartition(parts)
    got = whitening.whiten(df).collect()
    assert len(got) == len(rows) * min(16, width)
    if width < count:
        check(rows, got)
    else:  # fewer vectors than dimensions: the rest doesn't vary
        assert {r.component for r in got if r.whitened is None} == set(range(count, 17))
        assert max(r.identity_error for r in got) < 1e-9


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan")] * 4), (104, [float("inf"), 0.0, 0.0, 0.0])]
    wide = [(200 + i, [1.5, float(i)]) for i in range(5)] + [(300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + odd + wide, "vec_id long, embedding array<double>")
    for most in (whitening.BROADCAST_BYTES, 0):  # a model for all tasks, and one that is joined
        monkeypatch.setattr(whitening, "BROADCAST_BYTES", most)
        got = whitening.whiten(df).collect()
        check(rows, [r for r in got if r.vec_id < 100])
        two = [r for r in got if 200 <= r.vec_id < 300]
        assert {(r.component, r.whitened is None, r.n) for r in two} == {(1, False, 5), (2, True, 5)}
        assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got if r.vec_id == 300] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2, 3)]
        assert not any(100 <= r.vec_id < 200 for r in got)
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (2**60 + 1, [3.0, 5.0])], df.schema)
    assert sorted((r.vec_id or 0, r.component) for r in whitening.whiten(twice).collect()) == [(0, 1), (0, 1), (0, 2), (0, 2), (2**60 + 1, 1), (2**60 + 1, 2)]
    assert whitening.whiten(df.limit(0)).count() == 0


def test_large_entries_are_held(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 6 and all(r.n == 3 for r in got)
    assert int(next(r for r in got if r.vec_id == 1).deviation) == (3 * 2**53 - 320) ** 2 + 192**2


def test_parts_of_any_cut_are_the_same():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(500, 12)) * 64 + 300).astype(np.int64)
    whole = whitening.Part.of(x)
    cuts = [whitening.Part.of(p) for p in np.split(x, [3, 10, 11, 200, 390])]
    both = whitening.merged(cuts)
    assert (both.n, both.total) == (whole.n, whole.total)
    assert np.allclose(both.mean, whole.mean) and np.allclose(both.s, whole.s, rtol=1e-12)
    assert np.allclose(np.abs(both.v), np.abs(whole.v), atol=1e-9)


def test_query(spark, sf_dir):
    got = queries.op12_whitening(spark, sf_dir)
    assert dict(got.dtypes)["deviation"] == "bigint"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, got.collect())
