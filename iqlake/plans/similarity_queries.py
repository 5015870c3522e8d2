"""Queries on duplicates, leakage, window similarity and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import calibration, dedup, patterns, windows
from . import views as V
from .registry import query
from .sample_queries import assigned


def _digested(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates_text(spark, sf_dir):
    return dedup.groups(_digested(spark, sf_dir), "digest", "doc_id")


@query("""SELECT count(*) AS distinct_hashes, coalesce(sum(n - 1), 0)::bigint AS beyond_first FROM (SELECT count(*) AS n FROM documents
  GROUP BY text HAVING count(*) > 1)""")
def duplicate_summary(spark, sf_dir):
    return dedup.summary(_digested(spark, sf_dir), "digest", "doc_id")


@query("""WITH s AS (SELECT text, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM documents),
g AS (SELECT count(*) AS n, count(DISTINCT split) AS k FROM s GROUP BY text HAVING count(*) > 1)
SELECT count(*) FILTER (k > 1) AS across, count(*) FILTER (k = 1) AS within, coalesce(sum(n), 0)::bigint AS rows,
  count(*) FILTER (k > 1) = 0 AS passed FROM g""")
def cross_split_leakage(spark, sf_dir):
    k = F.col("doc_id") % 10
    s = _digested(spark, sf_dir).withColumn("split", F.when(k < 7, "train").when(k < 8, "validation").otherwise("test"))
    return dedup.leakage(s, "digest", "split")


@query("SELECT b.item_id, count(*) AS documents, min(d.doc_id) AS first FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL")
def benchmark_containment(spark, sf_dir):
    return patterns.containment(V.table(spark, sf_dir, "documents"), V.table(spark, sf_dir, "benchmark"))


@query("SELECT vec_id, sha256(unhex(hx)) AS digest FROM fx", "fx")
def float_bytes_digest(spark, sf_dir):
    return V.iq_samples(spark, sf_dir).select("vec_id", dedup.float_digest("i", "q").alias("digest"))


@query("""WITH g AS (SELECT count(*) AS n, count(DISTINCT split) AS k FROM split JOIN fx USING (vec_id) GROUP BY hx HAVING count(*) > 1)
SELECT count(*) FILTER (k > 1) AS across, count(*) FILTER (k = 1) AS within, coalesce(sum(n), 0)::bigint AS rows,
  count(*) FILTER (k > 1) = 0 AS passed FROM g""", "split", "fx")
def float_duplicate_audit(spark, sf_dir):
    s = assigned(spark, sf_dir)
    return dedup.leakage(s.withColumn("digest", dedup.float_digest("i", "q")), "digest", "split")


PAIRS = """w AS (SELECT vec_id, i, q, sqrt(list_sum(list_transform(i, lambda x: x::double * x)) + list_sum(list_transform(q, lambda x: x::double * x))) AS nn FROM (FROM iq ORDER BY vec_id LIMIT 64)),
k AS (SELECT unnest(range(32))::int AS k), rolled AS (SELECT vec_id, k, nn, list_concat(i[33-k:32], i[1:32-k]) AS i, list_concat(q[33-k:32],
  q[1:32-k]) AS q FROM w, k),
z AS (SELECT a.vec_id AS l, b.vec_id AS r, list_sum(list_transform(list_zip(a.i, b.i),
  lambda x: x[1]::double * x[2])) + list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1]::double * x[2])) AS re,
  list_sum(list_transform(list_zip(a.i, b.q), lambda x: x[1]::double * x[2])) - list_sum(list_transform(list_zip(a.q, b.i),
  lambda x: x[1]::double * x[2])) AS im, a.nn * b.nn AS norm FROM w a JOIN rolled b ON a.vec_id < b.vec_id),
pr AS (SELECT l AS "left", r AS "right", least(max(sqrt(re * re + im * im) / norm), 1) AS score FROM z GROUP BY ALL)"""


NEAR = 0.999


@query(f"""WITH d AS (SELECT vec_id, list_transform(i, lambda x: x::double) AS i, list_transform(q, lambda x: x::double) AS q FROM iq),
g AS (SELECT vec_id, list_transform(i, lambda x: x * 2.5) AS i, list_transform(q, lambda x: x * 2.5) AS q FROM d),
everyone AS (FROM d UNION ALL SELECT vec_id + 1000000000, list_concat(i[28:32], i[1:27]), list_concat(q[28:32], q[1:27]) FROM g),
one AS (SELECT min(vec_id) AS v, i, q FROM everyone GROUP BY i, q), w AS (SELECT *, sqrt(list_inner_product(i, i) + list_inner_product(q, q)) AS nn FROM one),
k AS (SELECT unnest(range(32))::int AS k), rolled AS (SELECT v, nn, list_concat(i[33-k:32], i[1:32-k]) AS i, list_concat(q[33-k:32], q[1:32-k]) AS q FROM w, k),
z AS (SELECT a.v AS l, b.v AS r, list_inner_product(a.i, b.i) + list_inner_product(a.q, b.q) AS re, list_inner_product(a.i, b.q) - list_inner_product(a.q, b.i) AS im, a.nn * b.nn AS norm
  FROM w a JOIN rolled b ON a.v < b.v)
SELECT l AS "left", r AS "right", round(least(max(sqrt(re * re + im * im) / norm), 1), 9) AS score FROM z GROUP BY ALL HAVING max(sqrt(re * re + im * im) / norm) >= {NEAR}""", "iq")
def near_windows(spark, sf_dir):
    """H09 over the whole table and a scaled and shifted copy of every window (P29): all pairs of different windows that are near
    duplicates up to shift, gain and phase."""
    s = V.iq_samples(spark, sf_dir).select("vec_id", A.doubles(F.col("i")).alias("i"), A.doubles(F.col("q")).alias("q"))
    copy = lambda c: A.rolled(F.transform(c, lambda x: x * 2.5), F.lit(5)).alias(c)
    both = s.unionByName(s.select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), copy("i"), copy("q")))
    return windows.near_pairs(both, "vec_id", NEAR).withColumn("score", F.round("score", 9))


def _pairs(spark, sf_dir):
    """All pairs of the first 64 windows: the contract's bounded sample for the exhaustive comparison."""
    return dedup.pair_scores(V.iq_samples(spark, sf_dir).orderBy("vec_id").limit(64), "vec_id", 32)


@query(f'WITH {PAIRS} SELECT "left", "right", round(score, 9) AS score FROM pr', "iq")
def circular_correlation_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"""WITH {PAIRS}, f AS (SELECT "left", "right" FROM pr WHERE score >= 0.5), e AS (SELECT "left", "right" FROM pr WHERE score >= 0.55 OR ("left" = 0 AND "right" = 1)),
j AS (SELECT f."left" AS fl, e."left" AS el FROM f FULL JOIN e ON f."left" = e."left" AND f."right" = e."right")
SELECT count(fl) AS found, count(el) AS expected, count(*) FILTER (fl IS NOT NULL AND el IS NOT NULL) AS true_pairs,
  count(*) FILTER (fl IS NULL) AS missed, count(*) FILTER (el IS NULL) AS false_pairs,
  round(count(*) FILTER (fl IS NOT NULL AND el IS NOT NULL) / count(el), 9) AS recall FROM j""", "iq")
def threshold_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return dedup.pair_audit(p.where("score >= 0.5"), p.where("score >= 0.55 or (left = 0 and right = 1)"))


@query(f"""WITH {PAIRS} SELECT count(*) AS n, round(min(score), 9) AS lowest, round(max(score), 9) AS highest, round(avg(score), 9) AS mean,
  sha256(string_agg(printf('%.9f', score), ',' ORDER BY printf('%.9f', score))) AS digest FROM pr""", "iq")
def score_summary(spark, sf_dir):
    return dedup.score_summary(_pairs(spark, sf_dir))


@query(f"""WITH {PAIRS}, s AS (SELECT score, ("left" + "right") % 5 = 0 AND score > 0.4 AS positive FROM pr), t AS (SELECT floor(min(score) * 1e12) / 1e12 AS t FROM s WHERE positive)
SELECT round(any_value(t), 9) AS threshold, avg((score >= t)::int) FILTER (positive) AS recall,
  round(avg((score >= t)::int) FILTER (NOT positive), 9) AS false_rate,
  avg((score >= t)::int) FILTER (positive) >= 1 AND avg((score >= t)::int) FILTER (NOT positive) <= 0.001 AS passed FROM s, t""", "iq")
def calibration_threshold(spark, sf_dir):
    s = _pairs(spark, sf_dir).select("score", ((F.col("left") + F.col("right")) % 5 == 0).alias("p")).select("score", (F.col("p") & (F.col("score") > 0.4)).alias("positive"))
    return dedup.calibrate(s).select(F.round("threshold", 9).alias("threshold"), "recall", F.round("false_rate", 9).alias("false_rate"), "passed")


@query(f"""WITH {PAIRS} SELECT sha256('{{\"left\":' || \"left\" || ',\"right\":' || \"right\" || ',\"score\":\"' || printf('%.6f',
  score) || '\"}}') AS digest, \"left\", \"right\" FROM pr""", "iq")
def pair_digest(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select(F.sha2(F.to_json(F.struct("left", "right", F.format_string("%.6f", "score").alias("score"))), 256).alias("digest"), "left", "right")


@query("""WITH w AS (SELECT vec_id, modulation, snr_db, source_index, i, q, sqrt(list_sum(list_transform(i, lambda x: x::double * x)) + list_sum(list_transform(q, lambda x: x::double * x))) AS nn FROM iq),
k AS (SELECT unnest(range(32))::int AS k), rolled AS (SELECT vec_id, modulation, snr_db, nn, k, list_concat(i[33-k:32], i[1:32-k]) AS i,
  list_concat(q[33-k:32], q[1:32-k]) AS q FROM w, k WHERE source_index = 0),
z AS (SELECT a.vec_id AS l, b.vec_id AS r, list_sum(list_transform(list_zip(a.i, b.i),
  lambda x: x[1]::double * x[2])) + list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1]::double * x[2])) AS re,
  list_sum(list_transform(list_zip(a.i, b.q), lambda x: x[1]::double * x[2])) - list_sum(list_transform(list_zip(a.q, b.i),
  lambda x: x[1]::double * x[2])) AS im, a.nn * b.nn AS norm
  FROM w a JOIN rolled b ON a.modulation = b.modulation AND a.snr_db = b.snr_db AND a.vec_id <> b.vec_id)
SELECT l AS "left", r AS "right", round(least(max(sqrt(re * re + im * im) / norm), 1), 9) AS score FROM z GROUP BY ALL""", "iq")
def correlation_fft(spark, sf_dir):
    s = V.iq_samples(spark, sf_dir)
    a = s.select(F.col("vec_id").alias("left"), F.col("modulation").alias("m"), F.col("snr_db").alias("s"), F.col("i").alias("ai"), F.col("q").alias("aq"))
    b = s.select(F.col("vec_id").alias("right"), F.col("modulation").alias("m"), F.col("snr_db").alias("s"), F.col("i").alias("bi"), F.col("q").alias("bq"), F.col("source_index").alias("k"))
    # each sample against the first of its cell, so the number of pairs is that of the samples
    return dedup.correlate(a.join(b.where("k = 0").drop("k"), ["m", "s"]).where("left <> right").drop("m", "s")).withColumn("score", F.round("score", 9))


@query("""WITH j AS (SELECT unnest(range(16))::int AS j), d AS (SELECT vec_id, j, sha256('pos' || vec_id || ':' || (j // 8)) AS h, (j % 8) * 8 AS o FROM embeddings, j),
v AS (SELECT vec_id, j, ('0x' || substr(h, o + 7, 2) || substr(h, o + 5, 2) || substr(h, o + 3, 2) || substr(h,
  o + 1, 2))::bigint / 4294967295.0::double * 2 - 1 AS x FROM d)
SELECT vec_id, round(min(x), 9) AS lowest, round(max(x), 9) AS highest, round(sum(x), 7) AS total FROM v GROUP BY ALL""")
def counter_samples(spark, sf_dir):
    a = V.table(spark, sf_dir, "embeddings").select("vec_id", A.counter_samples(F.concat(F.lit("pos"), F.col("vec_id").cast("string")), 16).alias("a"))
    return a.select("vec_id", F.round(F.array_min("a"), 9).alias("lowest"), F.round(F.array_max("a"), 9).alias("highest"), F.round(A.total(F.col("a")), 7).alias("total"))


@query("SELECT vec_id, round(i[32]::double * 2.5, 6) AS first_i, round(q[31]::double * 2.5, 6) AS second_was FROM iq", "iq")
def transformed_samples(spark, sf_dir):
    gain = lambda c: F.transform(c, lambda x: (x.cast("double") * 2.5))
    s = V.iq_samples(spark, sf_dir).select("vec_id", A.rolled(gain("i"), F.lit(2)).alias("a"), A.rolled(gain("q"), F.lit(2)).alias("b"))
    return s.select("vec_id", F.round(F.col("a")[1], 6).alias("first_i"), F.round(F.col("b")[0], 6).alias("second_was"))


ECE = """s AS (SELECT list_max(p) AS conf, (list_position(l, list_max(l)) - 1 = target)::int AS hit FROM probs), e AS (SELECT k, k / 15.0::double AS lo, (k + 1) / 15.0::double AS hi FROM (SELECT unnest(range(15)) AS k)),
b AS (SELECT k, count(*) AS n, avg(hit) AS acc, avg(conf) AS conf FROM s JOIN e ON {rule} GROUP BY ALL)
SELECT round(sum(n * abs(acc - conf)) / (SELECT count(*) FROM s), 9) AS ece, sum(n)::bigint AS binned, (SELECT count(*) FROM s) AS n FROM b"""


@query("WITH " + ECE.format(rule="conf >= lo AND (conf < hi OR (k = 14 AND conf <= hi))"), "probs")
def calibration_ece_closed_left(spark, sf_dir):
    return calibration.ece(calibration.probabilities(V.logits(spark, sf_dir)))


@query("WITH " + ECE.format(rule="conf > lo AND conf <= hi"), "probs")
def calibration_ece_open_left(spark, sf_dir):
    return calibration.ece(calibration.probabilities(V.logits(spark, sf_dir)), closed_left=False)


@query("""SELECT round(avg(-ln(greatest(p[target + 1], 1e-12))), 9) AS nll, round(avg(list_sum(list_transform(list_zip(p, range(10)), lambda x: (x[1] - (x[2] = target)::int) * (x[1] - (x[2] = target)::int)))), 9) AS brier,
round(avg((list_position(l, list_max(l)) - 1 = target)::int), 9) AS accuracy FROM probs""", "probs")
def nll_brier(spark, sf_dir):
    return calibration.losses(calibration.probabilities(V.logits(spark, sf_dir)), V.CLASSES)


@query("""SELECT vec_id, (list_position(l, list_max(l)) - 1)::int AS pred, round(list_max(p), 9) AS confidence,
  round(list_sum(p), 6) AS total FROM probs""", "probs")
def softmax_top(spark, sf_dir):
    p = calibration.probabilities(V.logits(spark, sf_dir))
    return p.select("vec_id", "pred", F.round("confidence", 9).alias("confidence"), F.round(A.total(F.col("p")), 6).alias("total"))


@query("SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN NULL ELSE label END AS back FROM embeddings")
def one_hot_roundtrip(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", A.one_hot(F.col("label"), 10).alias("h"))
    odd = F.when(F.col("vec_id") % 9 == 0, F.transform("h", lambda x: x * 0 + 1)).otherwise(F.col("h"))
    return e.select("vec_id", odd.alias("h")).select("vec_id", A.from_one_hot(F.col("h")).alias("back"))


@query("""WITH d AS (SELECT vec_id, -ln(greatest(p[target + 1], 1e-12)) AS ce, (l[1] + 1) / 19 - (snr_db + 1) / 19.0::double AS d FROM probs)
SELECT round(avg(ce), 9) AS ce, round(avg(CASE WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END), 9) AS snr_loss, round(avg(ce + 0.1 *
  CASE WHEN abs(d) < 1 THEN 0.5 * d * d ELSE abs(d) - 0.5 END), 9) AS joint FROM d""", "probs")
def joint_loss(spark, sf_dir):
    p = calibration.probabilities(V.logits(spark, sf_dir))
    scaled = lambda x: (x + 1) / 19
    p = p.select((-F.log(F.greatest(F.element_at("p", F.col("target") + 1), F.lit(1e-12)))).alias("ce"), A.smooth_l1(scaled(F.col("l")[0]) - scaled(F.col("snr_db"))).alias("s"))
    return p.agg(F.round(F.avg("ce"), 9).alias("ce"), F.round(F.avg("s"), 9).alias("snr_loss"), F.round(F.avg(F.col("ce") + 0.1 * F.col("s")), 9).alias("joint"))
