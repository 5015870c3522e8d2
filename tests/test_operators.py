"""Hand-computed expectations, golden vectors, order independence and negative cases."""

import collections
import glob
import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.functions import arrays as A
from iqlake.functions import identity as I
from iqlake.functions import text as T
from iqlake.operators import audit, calibration, decisions, dedup, interventions, metrics, ordered, progress, quality, resample, split
from iqlake.sources import files, scans, sinks, specs


def one(df):
    return df.collect()[0]


def replay(spark, rows):
    return spark.createDataFrame(rows, "model string, seed int, vec_id long, target int, pred int, snr_db int").withColumn("ok", (F.col("pred") == F.col("target")).cast("int"))


def classes(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("cls"))


def test_balanced_metrics(spark):
    rows = replay(spark, [("m", 1, i, t, p, s) for i, (p, t, s) in enumerate([(0, 0, -10), (1, 0, -10), (1, 1, 0), (0, 1, 0)])])
    got = one(metrics.metrics(rows, ["model"], classes(spark, 2)))
    assert (got.accuracy, got.macro_f1, got.n, got.per_snr) == (0.5, 0.5, 4, "-10=0.5000;+0=0.5000")


def test_absent_class_counts_zero_or_not_at_all(spark):
    rows = replay(spark, [("m", 1, 0, 0, 0, 0), ("m", 1, 1, 0, 0, 0)])
    assert one(metrics.macro_f1(rows, ["model"], classes(spark, 2))).macro_f1 == 0.5
    assert one(metrics.macro_f1(rows, ["model"])).macro_f1 == 1.0


def test_misaligned_replay_is_counted(spark):
    base = replay(spark, [("a", 1, i, 0, 0, 0) for i in range(4)])
    other = replay(spark, [("b", 1, i, int(i == 2), 0, 0) for i in (0, 1, 2, 9)])
    got = one(metrics.alignment(other, "vec_id", ["target", "snr_db"], ["model"], base))
    assert (got.matched, got.missing, got.extra, got.differing) == (2, 1, 1, 1)


@pytest.mark.parametrize(("n", "want"), [(0, (0, 0, 0)), (1, (1, 0, 0)), (3, (2, 0, 1)), (7, (5, 1, 1)), (1000, (700, 100, 200))])
def test_largest_remainder(spark, n, want):
    strata = spark.createDataFrame([(1, n)], "k int, n long")
    got = {r.split: r.cnt for r in split.allocate(strata, ["k"]).collect()}
    assert tuple(got[s] for s, _ in split.WEIGHTS) == want


def test_split_is_independent_of_input_order(spark):
    rows = spark.range(200).select("id", (F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("d"))
    a = {(r.id, r.split) for r in split.assign(rows, ["k"], ["d"]).collect()}
    b = {(r.id, r.split) for r in split.assign(rows.orderBy(F.desc("d")).repartition(7), ["k"], ["d"]).collect()}
    assert a == b and len(a) == 200


def test_rank_digest_is_framed(spark):
    parts = ["demo/v1", "2026", "é:+00"]
    want = hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()
    assert one(spark.range(1).select(I.rank_digest(parts[0], parts[1], F.lit(parts[2])).alias("d"))).d == want


def test_sample_ids_parse_only_as_written(spark):
    ids = ["r:QPSK:+00:0999", "r:QPSK:00:0999", "r:QPSK:-20:0000", "r:QPSK:+00:999", "bad", "r:QPSK:+0x:0001"]
    got = [r.p.canonical for r in spark.createDataFrame([(i,) for i in ids], "s string").select(I.parse_sample_id(F.col("s")).alias("p")).collect()]
    assert got == [True, False, True, False, False, False]


@pytest.mark.parametrize(("m", "s", "i", "row"), [(0, 0, 0, 0), (0, 6, 37, 6037), (9, 10, 999, 190999), (10, 19, 999, 219999)])
def test_coordinates(spark, m, s, i, row):
    got = one(spark.range(1).select(I.row_index(F.lit(m), F.lit(s), F.lit(i), 20, 1000).alias("row")).withColumn("c", I.coordinates(F.col("row"), 20, 1000)))
    assert got.row == row and tuple(got.c) == (m, s, i)


@pytest.mark.parametrize("m,s,i", [(0, 0, 1000), (3, 9, 1999), (9, 7, 12_345), (-1, 4, 2_000), (2, 0, 999)])
def test_coordinates_of_overfull_cells(spark, m, s, i):
    row = I.row_index(F.lit(m), F.lit(s), F.lit(i), 10, 1000)
    assert tuple(one(spark.range(1).select(I.coordinates(row, 10, 1000, F.lit(i // 1000)).alias("c"))).c) == (m, s, i)


def test_row_index_roundtrip_of_overfull_cells(spark, sf_dir, tmp_path):
    from iqlake import plans

    from .parity import connect, same

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 20")
    e.crossJoin(spark.range(1100).withColumnRenamed("id", "_k")).withColumn("vec_id", F.col("vec_id") + 20 * F.col("_k")).drop("_k").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = connect(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    same(plans.QUERIES["row_index_roundtrip"](spark, str(tmp_path)), con, plans.ORACLE["row_index_roundtrip"])


def test_json_digests_differ_beyond_ascii():
    assert I.json_digest({"b": 1, "a": 2}) == I.json_digest({"a": 2, "b": 1}, ascii_only=False)
    assert I.json_digest("é") != I.json_digest("é", ascii_only=False)


def samples(spark, rows):
    return spark.createDataFrame(rows, "modulation string, snr_db int, i array<float>, q array<float>")


def test_quality_of_finite_samples(spark):
    got = one(quality.cells(samples(spark, [("QPSK", 0, [1.0, -1.0], [2.0, -2.0]), ("QPSK", 0, [0.0, 0.0], [0.0, 0.0])])))
    assert (got.finite, got.zeros, got.zero_energy, got["mean"], got.mean_square, got.mean_power, got.dc_i, got.dc_q) == (8, 4, 1, 0, 1.25, 2.5, 0, 0)


def test_quality_of_non_finite_samples(spark):
    got = one(quality.cells(samples(spark, [("QPSK", 0, [math.nan, 0.0], [math.inf, -math.inf])])))
    assert (got.finite, got.nan, got.pos_inf, got.neg_inf, got.lowest, got.highest, got.mean_power) == (1, 1, 1, 1, 0, 0, None)


def test_preprocessing(spark):
    x = samples(spark, [("x", 0, [2.0, 4.0, 6.0, 8.0], [-3.0, -1.0, 1.0, 3.0])])
    i, q = F.col("i"), F.col("q")
    peak = A.max_amplitude(i, q)
    got = one(x.select(A.max_amplitude(A.divided(i, peak), A.divided(q, peak)).alias("m"), A.rms(A.centred(i), A.centred(q)).alias("r"), A.mean(A.centred(i)).alias("c")))
    assert got.m == pytest.approx(1) and got.c == pytest.approx(0) and got.r == pytest.approx(math.sqrt(10))
    assert one(samples(spark, [("x", 0, [0.0], [0.0])]).select(A.divided(i, A.rms(i, q)).alias("z"))).z is None


def test_correlation_ignores_gain_and_shift(spark):
    z = np.array([1 + 0.5j, 2 - 1j, 0 + 2j, -1 + 1j])
    w = np.roll(2.5 * np.exp(0.73j) * z, 2)
    row = (z.real.tolist(), z.imag.tolist(), w.real.tolist(), w.imag.tolist())
    x = spark.createDataFrame([(1, 2, *row)], "left long, right long, ai array<double>, aq array<double>, bi array<double>, bq array<double>")
    cols = [F.col(c) for c in ("ai", "aq", "bi", "bq")]
    assert one(x.select(A.circular_correlation(*cols, 4).alias("s"))).s == pytest.approx(1, abs=1e-12)
    assert one(dedup.correlate(x)).score == pytest.approx(1, abs=1e-12)


def test_float_digest_tells_zeros_apart(spark):
    x = spark.createDataFrame([([0.0],), ([-0.0],)], "i array<float>")
    got = [r.d for r in x.select(dedup.float_digest("i").alias("d")).collect()]
    assert got[0] == hashlib.sha256(np.float32(0).tobytes()).hexdigest() and got[0] != got[1]


def test_leakage(spark):
    rows = lambda splits: spark.createDataFrame([("h", s) for s in splits], "d string, split string")
    assert (one(dedup.leakage(rows(["train", "test"]), "d", "split")).across, one(dedup.leakage(rows(["train", "test"]), "d", "split")).passed) == (1, False)
    assert (one(dedup.leakage(rows(["train", "train"]), "d", "split")).within, one(dedup.leakage(rows(["train", "train"]), "d", "split")).passed) == (1, True)
    assert one(dedup.leakage(spark.createDataFrame([], "d string, split string"), "d", "split")).passed


def test_exhaustive_pairs_are_bounded(spark):
    x = spark.range(65).select("id", F.array(F.lit(1.0)).alias("i"), F.array(F.lit(1.0)).alias("q"))
    with pytest.raises(ValueError):
        dedup.pair_scores(x, "id", 1)


def test_ece_edges(spark):
    rows = spark.createDataFrame([(0.0, 0), (1.0, 1), (0.5, 1)], "confidence double, hit int")
    assert (one(calibration.ece(rows, 2)).binned, one(calibration.ece(rows, 2, closed_left=False)).binned) == (3, 2)


def test_partition_check(spark):
    ids = lambda v: spark.createDataFrame([(x,) for x in v], "k long")
    good, bad = split.partition_check(ids([0, 1, 2]), ids([0, 1, 2]), "k"), split.partition_check(ids([0, 0, 7]), ids([0, 1]), "k")
    assert one(good).passed
    assert tuple(one(bad)) == (1, 1, 1, False)


def test_decisions(spark):
    f = lambda c: one(spark.range(1).select(c.alias("x"))).x
    lit = F.lit
    assert f(decisions.contribution(lit(0.001), lit(0.001), lit(-1.0), lit(4))) == "qualifies"
    assert f(decisions.contribution(lit(0.001), lit(0.001), lit(-1.0), lit(3))) == "evidence_insufficient"
    assert f(decisions.screening(lit(0.51 - 0.49), lit(0.56 - 0.55))) == "clear_drop"
    assert f(decisions.screening(lit(0.002), lit(0.002))) == "unchanged"


def test_sample_deviation(spark):
    got = one(resample.interval(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v"))
    assert got["mean"] == 2 and got["std"] == pytest.approx(math.sqrt(2), abs=1e-8)


def test_bootstrap_of_a_constant_difference_is_degenerate(spark):
    rows = replay(spark, [(m, s, i, i % 2, i % 2 if m == "a" else 9, -10) for m in "ab" for s in (1, 2, 3) for i in range(4)])
    d = resample.differences(rows, "a", "b")
    for b in (resample.hash_bootstrap(d, [1, 2, 3], 8), resample.bootstrap(resample.predictions(rows, "a", "b"), [1, 2, 3], 8, 10)):
        b = b.groupBy("b").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
        assert {r.d / r.n for r in b.collect()} == {1.0} and b.count() == 8


def test_hash_bootstrap_deals_runs_of_slots(spark, monkeypatch):
    monkeypatch.setattr(resample, "SLOTS", 3, raising=False)
    hits = lambda m, s, i: (i * (3 if m == "a" else 5) + s) % 4 > 1
    rows = replay(spark, [(m, s, i, i % 2, i % 2 if hits(m, s, i) else 9, -10 if i < 17 else 4) for m in "ab" for s in (1, 2, 3) for i in range(31)])
    strata = collections.defaultdict(list)
    for s in (1, 2, 3):
        for i in range(31):
            strata[s, i % 2, -10 if i < 17 else 4].append(hits("a", s, i) - hits("b", s, i))
    digest = lambda *key: int(hashlib.md5(":".join(map(str, (2026, *key))).encode()).hexdigest()[:8], 16)
    want = collections.defaultdict(lambda: [0, 0])
    for b in range(5):
        for slot in range(3):
            for (s, target, snr), d in strata.items():
                for p in range(len(d)) if s == (1, 2, 3)[digest(b, slot) % 3] else ():
                    want[b, snr][0] += sorted(d)[digest(b, slot, target, snr, p) % len(d)]
                    want[b, snr][1] += 1
    b = resample.hash_bootstrap(resample.differences(rows, "a", "b"), [1, 2, 3], 5)
    assert {(r.b, r.snr_db): [r.d, r.n] for r in b.collect()} == want
    assert "REPARTITION_BY_NUM" in b._jdf.queryExecution().executedPlan().toString()  # else slots stay in the few tasks that the strata are in


def test_donors_keep_batches_and_are_a_permutation(spark):
    rows = spark.range(10).select("id", F.lit(0).alias("g"))
    d = interventions.donors(interventions.positions(rows, "g", "id", 4), "g", "id", 13).collect()
    assert sorted(r.donor_key for r in d) == list(range(10)) and all(r.id // 4 == r.donor_key // 4 for r in d)


def test_progress_log(spark):
    lines = spark.createDataFrame([('{"run": "a", "epoch": 7}',), ("run=b | epoch=5 | loss=0.1",), ("hello",)], "value string")
    assert {(r.run, r.epoch) for r in progress.parse_log(lines).collect()} == {("a", 7), ("b", 5)}


def test_patience(spark):
    def plain(h, gain, most):
        best, at, stale = -math.inf, 0, 0
        for i, x in enumerate(h, 1):
            if x is not None and x > best + gain:
                best, at, stale = x, i, 0
            else:
                stale += 1
                if stale >= most:
                    return best, at, stale, i
        return best, at, stale, 0

    rng = np.random.default_rng(1)
    runs = {("a", 1): [0.1, 0.5, 0.55, 0.4, 2.0], ("b", 1): [None, float("nan"), 0.2], ("c", None): [1.0], **{("r", k): rng.normal(size=30).round(2).tolist() for k in range(20)}}
    rows = spark.createDataFrame([(m, k, i, x) for (m, k), h in runs.items() for i, x in enumerate(h)], "model string, k int, at int, score double")
    got = {(r.model, r.k): tuple(r)[2:] for r in progress.patience(rows.repartition(5), ["model", "k"], ["at"], "score", 0.1, 2).collect()}
    assert got == {key: plain(h, 0.1, 2) for key, h in runs.items()}
    assert got["a", 1] == (0.5, 2, 2, 4)
    assert progress.patience(rows.limit(0), ["model", "k"], ["at"], "score", 0.1, 2).count() == 0


def test_best_run_breaks_ties_by_loss_then_id(spark):
    x = spark.createDataFrame([("d", 0.8, 0.7), ("c", 0.8, 0.6), ("b", 0.8, 0.6), ("a", 0.7, 0.5)], "run_id string, f1 double, loss double")
    assert x.orderBy(F.desc("f1"), "loss", "run_id").first().run_id == "b"


FOUND = {
    "cjk": ["中", "かな", "カナ", "한글"], "email": ["me@x.example", "ME@X.EXAMPLE", "(a.b+c@d-e.example)"], "home_path": ["/home/me", "/Users/me/x", r"c:\users\me", "D:/Documents and Settings/me"],
    "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN OPENSSH PRIVATE KEY-----"],
    "token": ["AKIA" + "A1" * 8, "ghp_" + "a" * 20, "ghr_" + "_" * 20, "github_pat_" + "a" * 20, "sk-" + "a-_" * 7],
}


def test_text_issues_and_lines(spark):
    clean = ["é ü", "me@x", "a@b.c", "@x.example", "/homes/me", "/home/", "-----BEGIN DSA PRIVATE KEY-----", "AKIA" + "a" * 16, "ghx_" + "a" * 20, "ghp_" + "a" * 19, "sk-" + "a" * 19, None]
    texts = [(t, n) for n, ts in FOUND.items() for t in ts] + [(t, None) for t in clean]
    for r in spark.createDataFrame(texts, "t string, n string").select("t", "n", T.issues(F.col("t")).alias("i")).collect():
        assert r.i == ([r.n] if r.n else []), r.t
    x = spark.createDataFrame([("a\nb c@d.example 中 /home/me",)], "t string")
    got = one(x.select(T.issues(F.col("t")).alias("i"), T.line_of(F.col("t"), F.lit("c@")).alias("l"), T.line_of(F.col("t"), F.lit("zz")).alias("n")))
    assert sorted(got.i) == ["cjk", "email", "home_path"] and got.l == 2 and got.n is None


def test_file_issues(spark):
    cases = [
        ("src/a.py", b"fine", []), ("x/.ENV", b"", ["name"]), ("a/b.PT", b"x", ["ending"]), ("Runs/b.txt", b"x", ["folder"]), ("a.txt", b"x" * (1 << 20), []), ("a.txt", b"x" * ((1 << 20) + 1), ["size"]),
        ("a.bin", b"\0me@x.example", ["binary"]), ("a.txt", b"\xff me@x.example", ["not_utf8"]), ("a.txt", b"me@x.example", ["email"]), ("my.npy/key.txt", b"", []), ("a.tar.pem", b"", ["ending"]), (".key", b"", []),
    ]
    got = spark.createDataFrame([(i, p, bytearray(c)) for i, (p, c, _) in enumerate(cases)], "i int, p string, c binary").select("i", T.file_issues(F.col("p"), F.col("c")).alias("f"))
    for r in got.collect():
        assert r.f == cases[r.i][2], cases[r.i][0]


def test_float_digests_are_those_of_the_bytes(spark, sf_dir):
    from iqlake import plans
    from iqlake.plans import views

    want = {r.vec_id: hashlib.sha256(np.array([*r.i, *r.q], "<f4").tobytes()).hexdigest() for r in views.iq_samples(spark, sf_dir).collect()}
    assert {r.vec_id: r.digest for r in plans.QUERIES["float_bytes_digest"](spark, sf_dir).collect()} == want
    odd = spark.createDataFrame([(1, [0.0], [1.0, 2.0]), (2, [-0.0], [1.0, 2.0]), (3, [], []), (4, None, [3.0])], "k int, a array<float>, b array<float>")
    got = {r.k: r.d for r in odd.select("k", dedup.float_digest("a", "b").alias("d")).collect()}
    assert got == {k: hashlib.sha256(np.array(v, "<f4").tobytes()).hexdigest() for k, v in {1: [0.0, 1, 2], 2: [-0.0, 1, 2], 3: [], 4: [3.0]}.items()}
    leak = one(plans.QUERIES["float_duplicate_audit"](spark, sf_dir))
    n = collections.Counter(want.values())
    assert leak.rows == sum(m for m in n.values() if m > 1)


def test_large_files_are_digested_by_ranges(spark, tmp_path, monkeypatch):
    for name, value in (("WHOLE", 5000), ("RANGE", 40_000), ("PIECE", 900)):
        monkeypatch.setattr(files, name, value, raising=False)
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 150_000, np.uint8).tobytes()
    held = {
        "a.bin": noise, "b.bin": noise[:50_000] + b"\n", "c.bin": b"\xef\xbb\xbf" + noise[:20_000], "d.bin": b"\xef\xbb\xbf" + b"\n" * 9000, "e.bin": b"\0" * 120_000, "f.bin": b"\n" * 100_001,
        "g.bin": b"\r\n" * 30_000 + b"\r", "h.gz": noise[:70_000], "i j%20.bin": noise[5:60_000], "small": b"x", "edge": b"y" * 5000, "over": b"y" * 5001,
    }
    for name, raw in held.items():
        (tmp_path / name).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "70000")  # reading more at once raises
    try:
        got = files.listing(spark, f"file://{tmp_path}")
        assert {os.path.basename(r.path): (r.size, r.sha256) for r in got.collect()} == {n: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in held.items()}
        sizes = spark.createDataFrame([(n, len(raw)) for n, raw in held.items()], "name string, want long")
        assert got.join(sizes, F.element_at(F.split("path", "/"), -1) == F.col("name")).where("size = want").count() == len(held)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_bindings_are_verified(spark, sf_dir):
    from iqlake import plans

    want = {os.path.basename(p): "size" if p.endswith("nation.parquet") else "ok" for p in glob.glob(f"{sf_dir}/*.parquet")}
    assert {os.path.basename(r.path): r.status for r in plans.QUERIES["binding_verify"](spark, sf_dir).collect()} == want
    cols = "path string, size long, sha256 string"
    files_ = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")], cols)
    manifest = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("d", 1, "x")], cols)
    assert {r.path: r.status for r in audit.bound(files_, manifest).collect()} == {"a": "ok", "b": "digest", "c": "unlisted", "d": "missing"}


def test_checks_name_what_fails(spark):
    checks = audit.check_table(spark.range(3), {"small": F.col("id") < 2, "known": F.col("id").isNotNull()})
    assert {(r.id, r.passed) for r in checks.collect()} == {("small", False), ("known", True)}
    with pytest.raises(ValueError, match="small"):
        audit.require(checks)


def test_test_split_is_closed(spark):
    rows = spark.createDataFrame([(1, "test"), (2, "train")], "k long, split string")
    with pytest.raises(PermissionError):
        scans.split_view(rows, "test")
    assert scans.split_view(rows, "test", authorised=True).count() == 1 and scans.pool(rows).count() == 1


def test_gather_keeps_order_and_repeats(spark):
    got = scans.gather(spark.range(5).select(F.col("id").alias("k")), "k", [3, 0, 3]).orderBy("pos").collect()
    assert [r.k for r in got] == [3, 0, 3]
    with pytest.raises(TypeError):
        scans.gather(spark.range(5), "id", [True])


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    sinks.publish(spark.range(3), f"{tmp_path}/a")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish(spark.range(3), f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 3
    digests = sinks.publish_evidence(spark.range(2).coalesce(1), f"{tmp_path}/e")
    assert digests.count() == 1 and len(one(digests).sha256) == 64


def test_text_sources(spark, tmp_path):
    (tmp_path / "log").write_text("\x1f".join("abcdef") + "\x1e" + "x\x1fy\x1e")
    assert [r.whole for r in scans.framed_log(spark, f"{tmp_path}/log").collect()] == [True, False]
    (tmp_path / "m.csv").write_text("target,a,b\na,1,2\nb,3,4\n")
    assert {(r.target, r.pred, r.n) for r in scans.matrix_csv(spark, f"{tmp_path}/m.csv", ["a", "b"]).collect()} == {("a", "a", 1), ("a", "b", 2), ("b", "a", 3), ("b", "b", 4)}
    assert scans.text_tree(spark, str(tmp_path), "*.csv").first().text.startswith("target")
    (tmp_path / "o.json").write_text('{"a": "no number"}')
    with pytest.raises(Exception):  # noqa: B017
        scans.json_objects(spark, f"{tmp_path}/o.json", "a int").collect()


def test_reports_are_published_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    with pytest.raises(RuntimeError), sinks.staged(spark, path) as stage:
        sinks.publish(spark.range(3), f"{stage}/a")
        raise RuntimeError
    assert os.listdir(tmp_path) == []
    with sinks.staged(spark, path) as stage:
        sinks.publish(spark.range(3), f"{stage}/a")
        with pytest.raises(FileExistsError), sinks.writer_lock(spark, path):
            pass
    assert os.listdir(tmp_path) == ["report"] and spark.read.parquet(f"{path}/a").count() == 3
    with pytest.raises(FileExistsError), sinks.staged(spark, path):
        pass
    assert os.listdir(tmp_path) == ["report"]


def test_markers_and_bindings(spark, tmp_path):
    sinks.create_once(spark, f"file://{tmp_path}/opened", "by me")
    with pytest.raises(FileExistsError):
        sinks.create_once(spark, f"file://{tmp_path}/opened")
    assert sinks.small_text(spark, f"file://{tmp_path}/opened") == "by me" and sinks.small_text(spark, f"file://{tmp_path}/none") is None
    folder = f"file://{tmp_path}/run"
    assert [sinks.bound_folder(spark, folder, {"seed": 13, "data": "x"}) for _ in range(2)] == [False, True]
    with pytest.raises(ValueError):
        sinks.bound_folder(spark, folder, {"seed": 13, "data": "y"})


def test_markdown(spark):
    rows = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string").orderBy("k")
    assert sinks.markdown(rows) == "| k | v |\n| --- | --- |\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        sinks.markdown(rows, 1)


def test_specs(spark, tmp_path):
    spec = {"schema_version": 1, "modulations": ["a", "b"], "snrs": [0, 2, 4], "samples": {"shape": [2, 8], "dtype": "float32", "per_cell": 5, "total": 30}}
    (tmp_path / "s.yml").write_text(json.dumps(spec))
    assert specs.check_spec(specs.load_spec(spark, f"file://{tmp_path}/s.yml")) == spec
    for bad in ({"schema_version": 2}, {"schema_version": True}, {"x": "y" * (64 << 10)}):
        (tmp_path / "b.json").write_text(json.dumps(spec | bad))
        with pytest.raises(ValueError):
            specs.load_spec(spark, f"file://{tmp_path}/b.json")
    for bad in ({"modulations": ["a", "a"]}, {"snrs": [0, True, 4]}, {"samples": spec["samples"] | {"total": 29}}, {"samples": spec["samples"] | {"dtype": "float64"}}):
        with pytest.raises(ValueError):
            specs.check_spec(spec | bad)


def test_files_are_followed(spark, tmp_path):
    for run, name, text in (("r1", "metrics.json", '{"test_accessed": false}'), ("r1", "config.yml", "x"), ("r2", "metrics.json", "{}"), ("r3/r2", "metrics.json", '{"test_accessed": true}'), ("test", "notes.txt", "x")):
        (tmp_path / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / run / name).write_text(text)
    listed = files.listing(spark, str(tmp_path))
    before = spark.createDataFrame(listed.collect(), listed.schema)
    found = {r.run_id: (r["config.yml"], r["metrics.json"]) for r in files.artifacts(spark.createDataFrame([("r1",), ("r2",), ("r9",)], "run_id string"), before, ("config.yml", "metrics.json")).collect()}
    assert [x is not None for x in found["r1"]] == [True, True] and found["r2"] == (None, None) == found["r9"]
    root = f"file:{tmp_path}/"
    frozen = {r.path.removeprefix(root): r.issues for r in files.freeze_rows(spark, str(tmp_path)).collect()}
    assert frozen["r1/metrics.json"] == [] and frozen["r2/metrics.json"] == ["test_accessed"] == frozen["r3/r2/metrics.json"] and "test_path" in frozen["test/notes.txt"]
    (tmp_path / "r1" / "config.yml").write_text("changed")
    (tmp_path / "new").write_text("x")
    assert {r.path.removeprefix(root): r.change for r in files.changed(before, files.listing(spark, str(tmp_path))).collect()} == {"r1/config.yml": "changed", "new": "new"}
    forged = before.withColumn("sha256", F.lit("kept"))
    digests = {r.path.removeprefix(root): r.sha256 for r in files.cached_digests(spark, str(tmp_path), forged).collect()}
    assert len(digests) == 6 and {p for p, d in digests.items() if d != "kept"} == {"r1/config.yml", "new"}
    assert digests["new"] == hashlib.sha256(b"x").hexdigest()


def test_a_stream_tells_of_its_batches(spark, sf_dir):
    from iqlake.streaming import progress as S

    seen = []
    e = S.event_stream(spark, sf_dir, "events.parquet").select("ts", "event_id", F.col("event_type").alias("model"), F.lit(1).alias("seed_idx"), F.lit(2).alias("epoch"))
    got = S.run_to_end(S.latest_epochs(e), sinks.scratch(spark, "observed"), seen=lambda rows, batch: seen.append((batch, rows.count())))
    assert seen == [(0, got.count())] and got.count() > 0


def test_archive_members(spark, tmp_path):
    import io
    import tarfile

    with tarfile.open(tmp_path / "a.tar.bz2", "w:bz2") as tar:
        for name in ("ok/a.txt", "../evil", "/abs"):
            info = tarfile.TarInfo(name)
            info.size = 2
            tar.addfile(info, io.BytesIO(b"hi"))
    got = {r.member: r.safe for r in files.archive_members(spark, f"{tmp_path}/a.tar.bz2").collect()}
    assert got == {"ok/a.txt": True, "../evil": False, "/abs": False}


def test_streamed_windows(spark, sf_dir):
    from iqlake.streaming import progress as S

    e = S.event_stream(spark, sf_dir, "events.parquet").select("ts", F.col("event_type").alias("model"), F.col("value").alias("score"))
    got = S.run_to_end(S.epochs_in_windows(e), sinks.scratch(spark, "windows"))
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_containment_of_all_items(spark, tmp_path):
    from iqlake import plans

    docs = [(3, "xone two three fourx"), (1, "a one two  three"), (1, "one two three"), (None, "one two three"), (9, None), (5, " ".join(map(str, range(40))))]
    some = [(0, "one two three"), (0, "one two three"), (1, "two"), (2, ""), (3, None), (4, "two  three"), (5, " ".join(map(str, range(2, 30)))), (6, "9 8 7")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    more = spark.range(10, 10_020).selectExpr("id as item_id", "concat('q w ', 20000 + id, ' e') as text")
    more.union(spark.createDataFrame([(20_000, "10 11 12 13")], "item_id long, text string")).union(spark.createDataFrame(some, "item_id long, text string")).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {}
    for i, t in [*some, (20_000, "10 11 12 13")]:
        for d, x in docs:
            if t is not None and x is not None and t in x:
                want.setdefault(i, []).append(d)
    got = {r.item_id: (r.documents, r.first) for r in plans.QUERIES["benchmark_containment"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(v), min((d for d in v if d is not None), default=None)) for i, v in want.items()} and 20_000 in got


def test_bootstrap_against_rows_drawn_one_by_one(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, lv, int(rng.integers(3)), int(rng.integers(3))) for s in (1, 2) for t in (0, 1) for lv in (-2, 0) for _ in range(9)]
    pairs = spark.createDataFrame(rows, "seed int, target int, snr_db int, x int, y int")
    cells = {s: [[r for r in rows if r[0] == s and r[1] == t and r[2] == lv] for t in (0, 1) for lv in (-2, 0)] for s in (1, 2)}

    def f1(rs, k):
        out = []
        for c in range(3):
            tp, a, b = (sum(r[1] == c == r[k] for r in rs), sum(r[1] == c for r in rs), sum(r[k] == c for r in rs))
            out.append(2 * tp / (a + b) if a + b else 0.0)
        return sum(out) / 3

    metrics_of = {"accuracy": lambda rs: np.mean([(r[3] == r[1]) - (r[4] == r[1]) for r in rs]), "macro_f1": lambda rs: f1(rs, 3) - f1(rs, 4)}
    drawn = [[c[k] for s in rng.choice([1, 2], 2) for c in cells[s] for k in rng.integers(0, len(c), len(c))] for _ in range(3000)]
    for metric, value in metrics_of.items():
        got = resample.bootstrap(pairs, [1, 2], 3000, 3, metric)
        if metric == "accuracy":
            assert {(r.b, r.snr_db): r.n for r in got.collect()} == {(b, lv): 36 for b in range(3000) for lv in (-2, 0)}
            got = got.groupBy("b").agg((F.sum("d") / F.sum("n")).alias("v"))
        v, want = np.array([r.v for r in got.collect()]), np.array([value(d) for d in drawn])
        assert len(v) == 3000 and abs(v.mean() - want.mean()) < 0.01 and abs(v.std() - want.std()) < 0.01
        assert np.allclose(np.quantile(v, [0.025, 0.975]), np.quantile(want, [0.025, 0.975]), atol=0.03)
        observed = resample.Strata(pairs, [1, 2], 3).observed(metric)
        assert np.isclose(observed, np.mean([value([r for r in rows if r[0] == s]) for s in (1, 2)]))
    again = [sorted(map(tuple, resample.bootstrap(pairs.repartition(n), [1, 2], 100, 3, "macro_f1").collect())) for n in (1, 5)]
    assert again[0] == again[1]
    with pytest.raises(ValueError):
        resample.bootstrap(pairs, [1, 2, 3], 10, 3)


def test_reports_draw_all_resamples(spark, sf_dir):
    from iqlake import plans

    assert one(plans.QUERIES["generator_bootstrap"](spark, sf_dir)).n == 10_000
    rows = {(r.metric, r.scope): r for r in plans.QUERIES["contrast_row"](spark, sf_dir).collect()}
    assert set(rows) == {(m, s) for m in ("accuracy", "macro_f1") for s in ("overall", "low_snr")}
    assert all(r.ci_lower < r.mean_difference < r.ci_upper and r.positive_seeds == 5 for r in rows.values())
    assert one(plans.QUERIES["formal_decision"](spark, sf_dir)).status == "qualifies"


def test_selected_epoch_gathers_no_group(spark, sf_dir):
    from iqlake import plans

    rows = [("a", 1, 2, 0.5), ("a", 2, 1, 0.9), ("a", 2, 0, 0.1), ("a", 3, 5, 0.9), ("a", 4, 6, None), ("b", 1, 1, None), (None, 2, 1, 0.3), (None, 1, 1, 0.2)]
    got = progress.selected_epoch(spark.createDataFrame(rows, "m string, ts int, id int, score double").repartition(3), ["m"], ["ts", "id"], "score")
    assert {tuple(r) for r in got.collect()} == {("a", 5, 3, 0.9), ("b", 1, None, None), (None, 2, 2, 0.3)}
    assert "collect_list" not in plans.QUERIES["selected_epoch"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, **settings):
            self.conf = settings

    with pytest.raises(RuntimeError):
        sinks.shared_dir(Session(**{"spark.master": "spark://host:7077"}))
    assert sinks.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    local = Session(**{"spark.master": "local[2]"})
    assert sinks.scratch(local, "x").startswith(sinks.shared_dir(local) + "/x-")


@pytest.mark.parametrize("per", [3, 10**9])
def test_totals_along_long_groups(spark, per):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(rng.integers(3))], int(rng.integers(0, 15)), i, float(rng.integers(-9, 9))) for i in range(120)] + [("n", None, 500, 1.0), ("n", 4, 501, 2.0)]
    df = spark.createDataFrame(rows, "g string, at int, id long, x double").repartition(3)
    got = {r.id: (r.s, r.m, r.k) for r in ordered.before(df, ["g"], ["at", "id"], F.col("at"), {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "k": ("sum", F.lit(1))}, per).collect()}
    for g, at, i, _ in rows:
        earlier = [x for h, b, j, x in rows if h == g and (-1 if b is None else b, j) < (-1 if at is None else at, i)]
        assert got[i] == ((sum(earlier), max(earlier), len(earlier)) if earlier else (None, None, None))
    numbers = {r.id: r.no for r in ordered.numbered(df, ["g"], ["at", "id"], F.col("at"), "no", per).collect()}
    assert numbers == {i: k or 0 for i, (_, _, k) in got.items()}
    q = {r.g: (r.n, r.q0, r.q1, r.q2) for r in ordered.quantiles(df, ["g"], "x", [0.0, 0.3, 1.0], per).collect()}
    for g, (n, *found) in q.items():
        own = [x for h, _, _, x in rows if h == g]
        assert n == len(own) and np.allclose(found, np.quantile(own, [0, 0.3, 1]))


def test_alignment_counts(spark):
    base = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 8)], "k int, v int")
    rows = spark.createDataFrame([("m", 1, 5), ("m", 2, None), ("m", 3, 0), ("m", 9, 1), ("n", 1, 5), ("n", 1, 5)], "g string, k int, v int")
    got = {r.g: tuple(r)[1:] for r in metrics.alignment(rows, "k", ["v"], ["g"], base).collect()}
    assert got == {"m": (2, 1, 1, 1), "n": (2, 3, 0, 0)}


@pytest.mark.parametrize("closed_left", [True, False])
def test_bins_end_where_the_edges_are(spark, closed_left):
    edges = [k / 15 for k in range(16)]
    x = sorted({v for e in edges for v in (e, np.nextafter(e, 0), np.nextafter(e, 1))} | {0.5, 0.999})
    rows = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(x)], "confidence double, hit int")
    at = {}
    for i, v in enumerate(x):
        for k in range(15):
            lo, hi = edges[k], edges[k + 1]
            if (lo <= v < hi or (k == 14 and v == hi)) if closed_left else lo < v <= hi:
                at.setdefault(k, []).append((v, i % 2))
    want = sum(len(b) * abs(np.mean([h for _, h in b]) - np.mean([v for v, _ in b])) for b in at.values()) / len(x)
    got = one(calibration.ece(rows, closed_left=closed_left))
    assert (got.binned, got.n) == (sum(map(len, at.values())), len(x)) and math.isclose(got.ece, want, abs_tol=1e-8)
