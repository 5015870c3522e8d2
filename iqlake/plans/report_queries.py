"""Queries on distributions, gates, resampling, decisions, run logs, texts and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..operators import audit, decisions, digests, interventions, ordered, patterns, progress, resample
from ..sources import sinks
from ..streaming import patience
from ..streaming import progress as stream
from . import views as V
from .registry import query

_LOW = ", ".join(map(str, V.LOW_SNR))
_Q = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{int(q * 100):02d}" for q in _Q) + " FROM events GROUP BY ALL")
def quantile_distribution(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    a = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.round(F.min("value"), 6).alias("lowest"), F.round(F.max("value"), 6).alias("highest"))
    q = ordered.quantiles(e, ["event_type"], "value", _Q)
    q = q.select(F.col("event_type").alias("of"), *(F.round(f"q{i}", 6).alias(f"q{int(q * 100):02d}") for i, q in enumerate(_Q)))
    return a.join(q, F.col("event_type").eqNullSafe(F.col("of")), "left").drop("of")


def _gates(spark, sf_dir):
    return V.gates(spark, sf_dir).withColumn("snr_db", V.snr_of(F.col("vec_id")))


ENTROPY = "list_sum(list_transform(w, lambda x: -x * log2(x + 1e-12)))"


@query(f"""SELECT block, snr_db, grouping_id(block, snr_db)::int AS grain, round(avg(w[1]), 9) AS mean, round(stddev_pop(w[1]), 9) AS std, round(avg({ENTROPY}), 9) AS entropy, round(avg((list_max(w) >= 0.6)::int), 9) AS collapsed, count(*) AS n
FROM (SELECT *, ((vec_id % 10) * 2 - 10)::int AS snr_db FROM gates) GROUP BY GROUPING SETS ((), (block), (snr_db))""", "gates")
def gate_entropy(spark, sf_dir):
    return interventions.mechanism(_gates(spark, sf_dir))


@query("""SELECT block, (b - 1)::int AS branch, round(avg(w[b]), 9) AS mean, count(*) AS n FROM gates, (SELECT unnest([1, 2, 3]) AS b)
  GROUP BY ALL""", "gates")
def mean_gate(spark, sf_dir):
    return interventions.mean_gate(V.gates(spark, sf_dir)).select("block", "branch", F.round("mean", 9).alias("mean"), "n")


@query("""WITH m AS (SELECT block, avg(w[1]) AS a, avg(w[2]) AS b, avg(w[3]) AS c FROM gates GROUP BY ALL)
SELECT vec_id, round(avg((abs(w[1] - a) + abs(w[2] - b) + abs(w[3] - c)) / 3), 9) AS diff, bool_or(list_position(w,
  list_max(w)) <> list_position([a, b, c], greatest(a, b, c))) AS flipped FROM gates JOIN m USING (block) GROUP BY ALL""", "gates")
def gate_difference(spark, sf_dir):
    g = V.gates(spark, sf_dir)
    r = interventions.replaced(g, interventions.mean_gate(g)).select("vec_id", "block", F.col("w").alias("m"))
    both = g.join(r, ["vec_id", "block"])
    return both.groupBy("vec_id").agg(F.round(F.avg(A.mean_abs_diff(F.col("w"), F.col("m"))), 9).alias("diff"), F.bool_or(A.argmax(F.col("w")) != A.argmax(F.col("m"))).alias("flipped"))


@query("""WITH s AS (SELECT ((vec_id % 10) * 2 - 10)::int AS snr_db, vec_id % 5 AS fold, block, (b - 1)::int AS branch, w[b] AS x FROM gates, (SELECT unnest([1, 2, 3]) AS b)),
a AS (SELECT fold, snr_db, block, branch, avg(x) AS m, count(*) AS k FROM s GROUP BY ALL) SELECT snr_db, block, branch,
  round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS std, sum(k)::bigint AS samples, count(*) AS folds FROM a GROUP BY ALL""", "gates")
def scale_weights(spark, sf_dir):
    s = _gates(spark, sf_dir).select("snr_db", (F.col("vec_id") % 5).alias("fold"), "block", F.posexplode("w").alias("branch", "x"))
    a = s.groupBy("fold", "snr_db", "block", "branch").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("k"))
    return a.groupBy("snr_db", "block", "branch").agg(F.round(F.avg("m"), 9).alias("mean"), F.round(F.stddev_samp("m"), 9).alias("std"), F.sum("k").alias("samples"), F.count(F.lit(1)).alias("folds"))


DONORS = """x AS (SELECT vec_id, modulation, snr_db, vec_id % 2 AS part, row_number() OVER (PARTITION BY vec_id % 2 ORDER BY vec_id) - 1 AS k FROM iq), p AS (SELECT *, k // 64 AS batch, k % 64 AS position FROM x),
s AS (SELECT part, batch, vec_id AS donor, row_number() OVER (PARTITION BY part, batch ORDER BY md5('13:' || vec_id), vec_id) - 1 AS position FROM p),
d AS (SELECT p.part, p.batch, p.vec_id, s.donor FROM p JOIN s USING (part, batch, position))"""


@query(f"""WITH {DONORS} SELECT d.part, count(*) AS n, round(avg((d.vec_id = d.donor)::int), 9) AS fixed, round(avg((a.modulation = b.modulation)::int), 9) AS same_modulation, round(avg((a.snr_db = b.snr_db)::int), 9) AS same_snr,
count(*) FILTER (a.modulation = b.modulation AND a.snr_db = b.snr_db) AS same_stratum FROM d JOIN iq a ON a.vec_id = d.vec_id JOIN iq b
  ON b.vec_id = d.donor GROUP BY ALL""", "iq")
def donor_mapping_audit(spark, sf_dir):
    s = V.iq_samples(spark, sf_dir).select("vec_id", "modulation", "snr_db", (F.col("vec_id") % 2).alias("part"))
    d = interventions.donors(interventions.positions(s, "part", "vec_id", 64), "part", "vec_id", 13)
    donor = s.select(F.col("vec_id").alias("donor_key"), F.col("modulation").alias("dm"), F.col("snr_db").alias("ds"))
    j = d.join(s.drop("part"), "vec_id").join(donor, "donor_key")
    share = lambda c: F.round(F.avg(c.cast("int")), 9)
    m, t = F.col("modulation") == F.col("dm"), F.col("snr_db") == F.col("ds")
    return j.groupBy("part").agg(F.count(F.lit(1)).alias("n"), share(F.col("vec_id") == F.col("donor_key")).alias("fixed"), share(m).alias("same_modulation"), share(t).alias("same_snr"), F.count_if(m & t).alias("same_stratum"))


@query("""WITH f AS (SELECT model, seed, avg(ok) AS a, count(*) AS n FROM c GROUP BY ALL) SELECT model,
  round(sum(a * n) / sum(n), 9) AS weighted, round(sum(CASE WHEN a > 0.6 THEN n ELSE 0 END) / sum(n), 9) AS share FROM f
  GROUP BY ALL""", "c")
def weighted_rollup(spark, sf_dir):
    f = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.avg("ok").alias("a"), F.count(F.lit(1)).alias("n"))
    return f.groupBy("model").agg(F.round(progress.weighted_mean("a", "n"), 9).alias("weighted"), F.round(F.sum(F.when(F.col("a") > 0.6, F.col("n")).otherwise(0)) / F.sum("n"), 9).alias("share"))


@query("""WITH m AS (SELECT model, seed, target, pred, count(*) AS n FROM r GROUP BY ALL) SELECT model, target, pred, sum(n)::bigint AS n
  FROM m GROUP BY ALL""", "r")
def matrix_sum(spark, sf_dir):
    per_run = V.replays(spark, sf_dir).groupBy("model", "seed", "target", "pred").agg(F.count(F.lit(1)).alias("n"))
    return per_run.groupBy("model", "target", "pred").agg(F.sum("n").alias("n"))


@query("""SELECT event_type, round(avg(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END), 6) AS mean,
  count(*) FILTER (event_id % 7 = 0) AS not_measured, round(avg(CASE WHEN event_id % 7 <> 0
  AND value > 0 THEN 1000 / value END), 6) AS throughput FROM events GROUP BY ALL""")
def nan_mean(spark, sf_dir):
    x = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = V.table(spark, sf_dir, "events").select("event_type", x.alias("x"))
    rate = F.when(~F.isnan("x") & (F.col("x") > 0), 1000 / F.when(F.col("x") > 0, F.col("x")))
    return e.groupBy("event_type").agg(F.round(F.avg(F.nanvl("x", F.lit(None).cast("double"))), 6).alias("mean"), F.count_if(F.isnan("x")).alias("not_measured"), F.round(F.avg(rate), 6).alias("throughput"))


@query("""SELECT block, round(100 * (avg((list_position(w, list_max(w)) = 1)::int) - (SELECT avg((list_position(w, list_max(w)) = 1)::int)
  FROM gates WHERE block = 0)), 6) AS delta_pp FROM gates GROUP BY ALL""", "gates")
def block_replacement(spark, sf_dir):
    a = V.gates(spark, sf_dir).groupBy("block").agg(F.avg((A.argmax(F.col("w")) == 0).cast("int")).alias("a"))
    base = F.broadcast(a.where("block = 0").select(F.col("a").alias("base")))
    return a.crossJoin(base).select("block", F.round(100 * (F.col("a") - F.col("base")), 6).alias("delta_pp"))  # one row of base


@query("""SELECT unnest(['finite', 'known_type', 'positive_id', 'valued']) AS id, unnest([f0 = 0, f1 = 0, f2 = 0, f3 = 0]) AS passed, unnest([f0, f1, f2, f3]) AS failures FROM (
SELECT count(*) FILTER (NOT coalesce(isfinite(value), false)) AS f0, count(*) FILTER (event_type NOT IN ('click', 'view')) AS f1,
  count(*) FILTER (event_id <= 0) AS f2, count(*) FILTER (value IS NULL) AS f3 FROM events)""")
def check_conjunction(spark, sf_dir):
    rules = {"finite": A.is_finite(F.col("value")), "known_type": F.col("event_type").isin("click", "view"), "positive_id": F.col("event_id") > 0, "valued": F.col("value").isNotNull()}
    return audit.check_table(V.table(spark, sf_dir, "events"), rules)


@query("""SELECT event_id, floor(100 * sum(score * (1 + event_id % 3)) OVER w / sum(1 + event_id % 3) OVER w + 0.001)::bigint AS running_loss_cents FROM runs WINDOW w AS (PARTITION BY model, seed_idx ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""", "runs")
def running_loss(spark, sf_dir):
    r = V.runs(spark, sf_dir).withColumn("n", 1 + F.col("event_id") % 3)
    return progress.running_loss(r, ["model", "seed_idx"], ["ts", "event_id"], "score", "n").select("event_id", F.floor(100 * F.col("running_loss") + 0.001).alias("running_loss_cents"))


@query("""WITH b AS (SELECT *, max(score) OVER (PARTITION BY model, seed_idx ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM runs)
SELECT event_id, p IS NULL OR score > p AS improved, round(greatest(coalesce(p, score), score), 6) AS best FROM b""", "runs")
def running_best_epoch(spark, sf_dir):
    r = progress.running_best(V.runs(spark, sf_dir), ["model", "seed_idx"], ["ts", "event_id"], "score")
    return r.select("event_id", "improved", F.round("best", 6).alias("best"))


@query("""WITH h AS (SELECT model, seed_idx, list(score ORDER BY ts, event_id) AS h FROM runs GROUP BY ALL) SELECT model, seed_idx,
  len(h) AS epochs, list_position(h, list_max(h))::int AS best_epoch, round(h[list_position(h, list_max(h))], 6) AS best_score
  FROM h""", "runs")
def selected_epoch(spark, sf_dir):
    return progress.selected_epoch(V.runs(spark, sf_dir), ["model", "seed_idx"], ["ts", "event_id"], "score")


PATIENCE = """SELECT model, seed_idx, best, best_at::int AS best_at, stale::int AS stale, stopped_at::int AS stopped_at{seen} FROM (
WITH RECURSIVE n AS (SELECT model, seed_idx, score, row_number() OVER (PARTITION BY model, seed_idx ORDER BY ts, event_id) AS p, count(*) OVER (PARTITION BY model, seed_idx) AS all_of FROM runs),
f AS (SELECT model, seed_idx, 0::bigint AS p, any_value(all_of) AS all_of, '-inf'::double AS best, 0::bigint AS best_at, 0::bigint AS stale, 0::bigint AS stopped_at FROM n GROUP BY ALL
  UNION ALL SELECT f.model, f.seed_idx, n.p, f.all_of, CASE WHEN up AND open THEN n.score ELSE best END, CASE WHEN up AND open THEN n.p ELSE best_at END,
    CASE WHEN NOT open THEN stale WHEN up THEN 0 ELSE stale + 1 END, CASE WHEN open AND NOT up AND stale + 1 >= 20 THEN n.p ELSE stopped_at END
  FROM (SELECT *, stopped_at = 0 AS open FROM f) f JOIN n ON n.model = f.model AND n.seed_idx = f.seed_idx AND n.p = f.p + 1, LATERAL (SELECT coalesce(n.score > f.best + 0.5, false) AS up))
SELECT * FROM f WHERE p = all_of)"""


@query(PATIENCE.format(seen=""), "runs")
def patience_stop(spark, sf_dir):
    """W07 with a least gain and a limit of stale epochs."""
    return progress.patience(V.runs(spark, sf_dir), ["model", "seed_idx"], ["ts", "event_id"], "score", 0.5, 20)


@query(PATIENCE.format(seen=", p::int AS seen"), "runs")
def stream_patience(spark, sf_dir):
    """W07 over the event log as a stream, with Spark's keyed state per run; the log is appended to in the order of time."""
    log, order = sinks.scratch(spark, "log"), ["ts", "event_id"]
    rows = digests.ranged_by(V.runs(spark, sf_dir), order, 1 << 20, least=3)
    ranges = sorted(x["_range"] for x in rows.select("_range").distinct().collect())
    for r in ranges:
        rows.where(F.col("_range") == r).drop("_range").coalesce(1).write.mode("append").parquet(log)
    events = stream.event_stream(spark, log, files_per_trigger=max(1, len(ranges) // 3))
    return patience.follow(events, sinks.scratch(spark, "follow"), ["model", "seed_idx"], order, "score", 0.5, 20)


@query("SELECT e::int AS epoch, round(0.001 * (1 + cos(e * pi() / 100)) / 2, 9) AS rate FROM (SELECT unnest(range(101)) AS e)")
def cosine_schedule(spark, sf_dir):
    return spark.range(101).select(F.col("id").cast("int").alias("epoch"), F.round(progress.cosine_rate(0.001, F.col("id"), 100), 9).alias("rate"))


@query("""SELECT a.model, a.seed, abs(a.x - b.x) <= greatest(3e-5 * greatest(abs(a.x), abs(b.x)), 3e-5) AS same FROM (SELECT model, seed,
  avg(ok) AS x FROM c GROUP BY ALL) a JOIN (SELECT model, seed, avg(ok) + CASE WHEN seed > 50 THEN 0.001 ELSE 0.00001 END AS x FROM c
  GROUP BY model, seed) b USING (model, seed)""", "c")
def approximate_equality(spark, sf_dir):
    a = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.avg("ok").alias("x"))
    recorded = F.col("x") + F.when(F.col("seed") > 50, 0.001).otherwise(0.00001)
    return a.select("model", "seed", A.close(F.col("x"), recorded).alias("same"))


#: Resamples whose draws are digests, for the comparison with SQL; the reports draw BOOTSTRAP_RESAMPLES, as in section 1.4 of the survey.
HASHED, BOOTSTRAP_RESAMPLES = 200, 10_000
BOOT = f"""dd AS (SELECT a.seed, a.vec_id, a.target, a.snr_db, a.ok - b.ok AS d, row_number() OVER (PARTITION BY a.seed, a.target, a.snr_db ORDER BY a.ok - b.ok) - 1 AS k FROM c a JOIN c b ON a.seed = b.seed AND a.vec_id = b.vec_id AND a.model = 'm1' AND b.model = 'm2'),
sz AS (SELECT seed, target, snr_db, count(*) AS m FROM dd GROUP BY ALL),
dr AS (SELECT b, slot, [13, 37, 73, 101, 137][1 + ('0x' || substr(md5('2026:' || b || ':' || slot), 1, 8))::bigint % 5] AS seed
  FROM (SELECT unnest(range({HASHED})) AS b), (SELECT unnest(range(5)) AS slot)),
ce AS (SELECT b, slot, dr.seed, target, snr_db, m, unnest(range(m)) AS p FROM dr JOIN sz ON dr.seed = sz.seed),
pk AS (SELECT *, ('0x' || substr(md5('2026:' || b || ':' || slot || ':' || target || ':' || snr_db || ':' || p), 1, 8))::bigint % m AS k FROM ce),
bs AS (SELECT pk.b, pk.snr_db, sum(dd.d) AS d, count(*) AS n FROM pk JOIN dd USING (seed, target, snr_db, k) GROUP BY ALL)"""
INTERVAL = """round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std, round(min(v), 9) AS lowest, round(max(v), 9) AS highest,
  round(quantile_cont(v, 0.025), 9) AS lower, round(quantile_cont(v, 0.975), 9) AS upper, count(*) FILTER (v > 0) AS positive,
  count(*) AS n"""


def _boot(spark, sf_dir, reference="m1", variant="m2"):
    d = resample.differences(V.checked(spark, sf_dir), reference, variant)
    return resample.hash_bootstrap(d, list(V.SEEDS), HASHED)


@query(f"WITH {BOOT}, v AS (SELECT b, sum(d) / sum(n) AS v FROM bs GROUP BY ALL) SELECT {INTERVAL} FROM v", "c")
def hash_bootstrap_accuracy(spark, sf_dir):
    b = _boot(spark, sf_dir).groupBy("b").agg((F.sum("d") / F.sum("n")).alias("v"))
    return resample.interval(b, "v")


@query(f"""WITH {BOOT}, v AS (SELECT 'overall' AS scope, b, sum(d) / sum(n) AS v FROM bs GROUP BY ALL UNION ALL SELECT 'snr' || printf('%+d', snr_db), b, sum(d) / sum(n) FROM bs GROUP BY b, snr_db
UNION ALL SELECT 'low', b, sum(d) / sum(n) FROM bs WHERE snr_db IN ({_LOW}) GROUP BY b) SELECT scope, {INTERVAL} FROM v GROUP BY ALL""", "c")
def hash_bootstrap_suite(spark, sf_dir):
    return _by_scope(_boot(spark, sf_dir))


def _by_scope(b):
    low = F.when(F.col("snr_db").isin(*V.LOW_SNR), F.lit("low"))
    scopes = F.filter(F.array(F.lit("overall"), F.concat(F.lit("snr"), F.format_string("%+d", "snr_db")), low), lambda x: x.isNotNull())
    v = b.select("b", "d", "n", F.explode(scopes).alias("scope")).groupBy("scope", "b").agg((F.sum("d") / F.sum("n")).alias("v"))
    return resample.interval(v, "v", ["scope"])


def _bootstrap(spark, sf_dir, metric="accuracy"):
    return resample.bootstrap(resample.predictions(V.checked(spark, sf_dir), "m1", "m2"), list(V.SEEDS), BOOTSTRAP_RESAMPLES, V.CLASSES, metric)


@query()
def generator_bootstrap(spark, sf_dir):
    """Accuracy over all levels."""
    b = _bootstrap(spark, sf_dir).groupBy("b").agg((F.sum("d") / F.sum("n")).alias("v"))
    return resample.interval(b, "v")


@query()
def bootstrap_suite(spark, sf_dir):
    """Accuracy overall, by level and over the low levels, all from the same draws."""
    return _by_scope(_bootstrap(spark, sf_dir))


@query()
def bootstrap_macro_f1(spark, sf_dir):
    return resample.interval(_bootstrap(spark, sf_dir, "macro_f1"), "v")


@query()
def contrast_row(spark, sf_dir):
    pairs = resample.predictions(V.checked(spark, sf_dir), "m1", "m2")
    return resample.contrast(pairs, list(V.SEEDS), BOOTSTRAP_RESAMPLES, V.CLASSES, V.LOW_SNR)


PERM = """pm AS (SELECT pm, avg(ok) FILTER (model = 'm1') - avg(CASE WHEN model = 'm2' AND md5(pm || ':' || vec_id) < '8' THEN ok
  WHEN model = 'm2' THEN 0 END) AS v FROM c, (SELECT unnest(range(13, 33)) AS pm) GROUP BY pm)"""


@query(f"WITH {PERM} SELECT {INTERVAL} FROM pm", "c")
def permutation_interval(spark, sf_dir):
    perms = F.broadcast(spark.range(13, 33).select(F.col("id").alias("pm")))
    c = V.checked(spark, sf_dir).where("model in ('m1', 'm2')").crossJoin(perms)  # twenty permutations
    kept = F.when(F.md5(F.concat_ws(":", F.col("pm").cast("string"), F.col("vec_id").cast("string"))) < "8", F.col("ok")).otherwise(0)
    v = c.groupBy("pm").agg((F.avg(F.when(F.col("model") == "m1", F.col("ok"))) - F.avg(F.when(F.col("model") == "m2", kept))).alias("v"))
    return resample.interval(v, "v")


DECIDE = f"""WITH {BOOT}, a AS (SELECT quantile_cont(v, 0.025) AS acc FROM (SELECT sum(d) / sum(n) AS v FROM bs GROUP BY b)), l AS (SELECT quantile_cont(v, 0.025) AS low FROM (SELECT sum(d) / sum(n) AS v FROM bs WHERE snr_db IN ({_LOW}) GROUP BY b)),
s AS (SELECT count(*) FILTER (m > 0) AS pos FROM (SELECT avg(d) AS m FROM dd GROUP BY seed))"""


@query(f"""{DECIDE} SELECT round(low, 9) AS low_lower, round(acc, 9) AS acc_lower, pos AS positive_seeds,
CASE WHEN low > 0 AND acc > 0 AND pos >= 4 THEN 'qualifies'
  WHEN low > 0 OR acc > 0 THEN 'evidence_insufficient' ELSE 'not_supported' END AS status FROM a, l, s""", "c")
def hash_formal_decision(spark, sf_dir):
    d = resample.differences(V.checked(spark, sf_dir), "m1", "m2")
    return _decided(resample.hash_bootstrap(d, list(V.SEEDS), HASHED), d)


@query()
def formal_decision(spark, sf_dir):
    return _decided(_bootstrap(spark, sf_dir), resample.differences(V.checked(spark, sf_dir), "m1", "m2"))


def _decided(b, d):
    low = F.when(F.col("snr_db").isin(*V.LOW_SNR), F.col("d")), F.when(F.col("snr_db").isin(*V.LOW_SNR), F.col("n"))
    v = b.groupBy("b").agg((F.sum("d") / F.sum("n")).alias("a"), (F.sum(low[0]) / F.sum(low[1])).alias("l"))
    v = v.agg(F.percentile("l", F.lit(0.025)).alias("low_lower"), F.percentile("a", F.lit(0.025)).alias("acc_lower"))
    s = d.groupBy("seed").agg(F.avg("d").alias("m")).agg(F.count_if(F.col("m") > 0).alias("positive_seeds"))
    both = v.crossJoin(s)  # one row each
    status = decisions.contribution(F.col("low_lower"), F.col("acc_lower"), F.lit(-1.0), F.col("positive_seeds"))
    return both.select(F.round("low_lower", 9).alias("low_lower"), F.round("acc_lower", 9).alias("acc_lower"), "positive_seeds", status.alias("status"))


DROPS = f"""a AS (SELECT model, avg(ok) AS acc, avg(ok) FILTER (snr_db IN ({_LOW})) AS low FROM c GROUP BY ALL), d AS (SELECT y.model AS variant, x.low - y.low AS low_drop, x.acc - y.acc AS all_drop FROM a x JOIN a y ON x.model = 'm3' AND y.model <> 'm3'),
s AS (SELECT *, CASE WHEN low_drop >= 0.010 AND all_drop >= 0.005 THEN 'clear_drop' WHEN abs(low_drop) <= 0.005
  AND abs(all_drop) <= 0.005 THEN 'unchanged' WHEN low_drop <= 0 AND all_drop <= 0 THEN 'not_worse' ELSE 'borderline' END AS status
  FROM d)"""


def _drops(spark, sf_dir):
    a = V.checked(spark, sf_dir).groupBy("model").agg(F.avg("ok").alias("acc"), F.avg(F.when(F.col("snr_db").isin(*V.LOW_SNR), F.col("ok"))).alias("low"))
    x = F.broadcast(a.where("model = 'm3'").select(F.col("acc").alias("xa"), F.col("low").alias("xl")))
    d = a.where("model <> 'm3'").crossJoin(x).select(F.col("model").alias("variant"), (F.col("xl") - F.col("low")).alias("low_drop"), (F.col("xa") - F.col("acc")).alias("all_drop"))  # one row of reference
    return d.withColumn("status", decisions.screening(F.col("low_drop"), F.col("all_drop")))


@query(f"WITH {DROPS} SELECT variant, round(low_drop, 9) AS low_drop, round(all_drop, 9) AS all_drop, status FROM s", "c")
def screening_decision(spark, sf_dir):
    return _drops(spark, sf_dir).select("variant", F.round("low_drop", 9).alias("low_drop"), F.round("all_drop", 9).alias("all_drop"), "status")


@query(f"""WITH {DROPS} SELECT string_agg(variant, ',' ORDER BY variant) FILTER (status IN ('clear_drop', 'borderline')) AS formal, CASE
  WHEN count(*) FILTER (status IN ('clear_drop', 'borderline')) = 0 THEN 'none'
  WHEN bool_and(status IN ('clear_drop', 'borderline')) THEN 'all' ELSE 'some' END AS scope FROM s""", "c")
def combined_screening(spark, sf_dir):
    return decisions.combined(_drops(spark, sf_dir))


@query(f"""WITH {DROPS} SELECT CASE WHEN a.status = 'clear_drop' AND b.status = 'clear_drop' THEN 'both'
  WHEN a.status = 'clear_drop' THEN 'first_only' WHEN b.status = 'clear_drop' THEN 'second_only' ELSE 'neither' END AS scope FROM s a
  JOIN s b ON a.variant = 'm1' AND b.variant = 'm2'""", "c")
def mainline_scope(spark, sf_dir):
    s = _drops(spark, sf_dir).agg(F.bool_or((F.col("variant") == "m1") & (F.col("status") == "clear_drop")).alias("a"), F.bool_or((F.col("variant") == "m2") & (F.col("status") == "clear_drop")).alias("b"))
    return s.select(decisions.scope(F.col("a"), F.col("b")).alias("scope"))


@query("""SELECT count(*) FILTER (d) AS decisive, count(*) FILTER (e) AS errors, CASE WHEN count(*) FILTER (d) > 0 THEN 'ineligible'
  WHEN count(*) FILTER (e) > 0 THEN 'indeterminate' ELSE 'eligible' END AS status FROM (SELECT contains(text, 'AKIA')
  AND contains(text, 'zzz') AS d, n_chars = 0 AS e FROM documents)""")
def independence_conclusion(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select((F.col("text").contains("AKIA") & F.col("text").contains("zzz")).alias("decisive"), (F.col("n_chars") == 0).alias("error"))
    return decisions.independence(d)


RULES = [
    ("late", "events", "$.k", "above", "95", True), ("window", "events", "$.k", "above", "40", False), ("window", "events", "$.k", "below", "43", False),
    ("no_key", "events", "$.none", "exists", None, True), ("licensed", "documents", None, "contains", "Licensed under", False),
    ("both", "documents", None, "contains", "Licensed", True), ("both", "documents", None, "contains", "\n", True), ("the", "documents", None, "contains", "the", False),
]
_RULES = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else "chr(10)" if x == "\n" else f"'{x}'" for x in r) + ")" for r in RULES)


@query(f"""WITH c AS (SELECT * FROM (VALUES {_RULES}) v(rule, source, path, op, value, decisive)),
t AS (SELECT 'events' AS source, event_id AS id, props::varchar AS text FROM events UNION ALL SELECT 'documents', doc_id, text FROM documents),
h AS (SELECT c.*, id, text FROM c JOIN t USING (source) WHERE CASE op WHEN 'contains' THEN contains(text, value) WHEN 'exists' THEN json_exists(text, path)
  WHEN 'above' THEN json_extract_string(text, path)::double > value::double ELSE json_extract_string(text, path)::double < value::double END),
f AS (SELECT rule, source, id, bool_or(decisive) AS decisive, count(*) AS met, min(value) FILTER (op = 'contains') AS s, any_value(text) AS text FROM h GROUP BY ALL)
SELECT rule, source, id, decisive, len(string_split(text[:position(s IN text) - 1], chr(10)))::int AS line
FROM f JOIN (SELECT rule, count(*) AS n FROM c GROUP BY rule) USING (rule) WHERE met = n""")
def evidence_rules(spark, sf_dir):
    """Rules as rows, over the events' JSON and the documents' texts."""
    rules = spark.createDataFrame(RULES, "rule string, source string, path string, op string, value string, decisive boolean")
    e = V.table(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("id"), F.col("props").cast("string").alias("text"))
    d = V.table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    return patterns.evidence(e.unionByName(d), rules)


LAYERS = [("conv1", 64, 2, 7, 128, 1), ("conv2", 64, 64, 5, 64, 1), ("depthwise", 64, 64, 3, 64, 64), ("fc", 11, 64, 1, 1, 1)]


@query("SELECT layer, (co * ci // g * k * w)::bigint AS macs, (co * ci // g * k)::bigint AS weights FROM (VALUES " + ", ".join(str(x) for x in LAYERS) + ") v(layer, co, ci, k, w, g)")
def layer_macs(spark, sf_dir):
    t = spark.createDataFrame(LAYERS, "layer string, co long, ci long, k long, w long, g long")
    return t.select("layer", F.expr("co * ci div g * k * w").alias("macs"), F.expr("co * ci div g * k").alias("weights"))


@query("""SELECT s.s_suppkey AS candidate, abs(s.s_acctbal - 5000) / 5000 < 0.05 AS within FROM supplier s ORDER BY abs(s.s_acctbal - 5000),
  s.s_suppkey LIMIT 1""")
def parameter_match(spark, sf_dir):
    s = V.table(spark, sf_dir, "supplier")
    best = s.agg(F.min_by(F.struct("s_suppkey", "s_acctbal"), F.struct(F.abs(F.col("s_acctbal") - 5000), "s_suppkey")).alias("b"))
    return best.select(F.col("b.s_suppkey").alias("candidate"), decisions.within_gap(F.col("b.s_acctbal"), F.lit(5000.0)).alias("within"))


@query("SELECT model, seed_idx, max_by(epoch, (ts, event_id)) AS latest_epoch FROM runs GROUP BY ALL", "runs")
def latest_epoch_per_run(spark, sf_dir):
    return progress.latest(V.runs(spark, sf_dir), ["model", "seed_idx"], "epoch", ["ts", "event_id"])


@query("SELECT model, seed_idx, max_by(epoch, (ts, event_id)) AS latest_epoch FROM runs GROUP BY ALL", "runs")
def stream_latest_epoch(spark, sf_dir):
    from ..sources.sinks import scratch
    from ..streaming.progress import event_stream, latest_epochs, run_to_end

    e = event_stream(spark, sf_dir, "events.parquet")
    runs = e.select("event_id", "ts", F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("seed_idx"), F.from_json("props", V.RUN_SCHEMA)["k"].alias("epoch"))
    return run_to_end(latest_epochs(runs), scratch(spark, "latest"))


@query("""WITH a AS (SELECT DISTINCT model || '-' || seed_idx AS run FROM runs), d AS (SELECT model || '-' || seed_idx AS run FROM runs GROUP BY ALL HAVING max(epoch) >= 99), s AS (SELECT DISTINCT model || '-' || seed_idx AS run FROM runs WHERE score > 50)
SELECT run, CASE WHEN run IN (FROM d) THEN 'done' WHEN run IN (FROM s) THEN 'running' ELSE 'queued' END AS status FROM a""", "runs")
def run_status(spark, sf_dir):
    r = V.runs(spark, sf_dir).withColumn("run", F.concat_ws("-", "model", F.col("seed_idx").cast("string")))
    done = r.groupBy("run").agg(F.max("epoch").alias("m")).where("m >= 99")
    return progress.status(r, done, r.where("score > 50"), "run")


@query("SELECT model, seed FROM models, seeds EXCEPT SELECT model, seed FROM c GROUP BY model, seed HAVING avg(ok) >= 0.6", "c")
def skip_completed(spark, sf_dir):
    grid = V.model_dim(spark).select("model").crossJoin(V.seed_dim(spark)).withColumn("run", F.struct("model", "seed"))
    done = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.avg("ok").alias("a")).where("a >= 0.6").select(F.struct("model", "seed").alias("run"))
    return progress.remaining(grid, done, "run").select("model", "seed")


@query("SELECT (props->>'k')::int AS k, count(*) AS n, count(DISTINCT event_type) AS types FROM events GROUP BY ALL")
def json_props_histogram(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_type", F.from_json("props", V.RUN_SCHEMA)["k"].alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("types"))


@query("""SELECT run, max(epoch)::int AS epoch FROM (SELECT CASE WHEN event_id % 3 < 2 THEN event_type END AS run, user_id % 7 AS epoch
  FROM events) WHERE run IS NOT NULL GROUP BY ALL""")
def progress_log(spark, sf_dir):
    epoch = (F.col("user_id") % 7).cast("string")
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"run": "'), "event_type", F.lit('", "epoch": '), epoch, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("run="), "event_type", F.lit(" | epoch="), epoch)).otherwise(F.lit("--"))
    return progress.parse_log(V.table(spark, sf_dir, "events").select(line.alias("value"))).groupBy("run").agg(F.max("epoch").alias("epoch"))


@query("SELECT doc_id, strlen(text) AS size, sha256(text) AS sha256, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(text, '{p}')" for p in found) + f" THEN '{n}' END" for n, found in T.ISSUES.items()) + "], lambda x: x IS NOT NULL), ',') AS issues FROM documents")
def content_audit(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), F.array_join(T.issues(F.col("text")), ",").alias("issues"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_append(regexp_extract_all(text, '[A-Za-z]+'), 'x1'))), ',') AS keys
  FROM documents WHERE regexp_matches(text, '[A-Za-z]')""")
def citation_keys(spark, sf_dir):
    """P32 over whole texts, every word of which is made a citation."""
    docs = V.table(spark, sf_dir, "documents").where(F.col("text").rlike("[A-Za-z]"))
    cited = docs.select("doc_id", F.regexp_replace("text", "([A-Za-z]+)", "[@$1; @x1]").alias("t"))
    return cited.select("doc_id", F.array_join(T.citation_keys(F.col("t")), ",").alias("keys"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)
SELECT doc_id, place::int AS place, md5('@misc{k' || place || ',' || chr(10) || line || '}' || chr(10)) AS entry FROM l""")
def entry_split(spark, sf_dir):
    """P33 over whole texts, every line of which is made an entry."""
    line = lambda x, i: F.concat(F.lit("@misc{k"), i.cast("string"), F.lit(",\n"), x, F.lit("}\n"))
    listed = V.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "").alias("t"))
    return listed.select("doc_id", F.posexplode(T.entries(F.col("t"))).alias("place", "e")).select("doc_id", "place", F.md5("e").alias("entry"))


@query("""SELECT doc_id, CASE WHEN contains(text, ' de ') THEN 1 + len(regexp_extract_all(split_part(text, ' de ', 1),
  chr(10)))::int END AS line FROM documents""")
def line_number(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", T.line_of(F.col("text"), F.lit(" de ")).alias("line"))


@query("SELECT o_orderkey, o_orderdate::date > DATE '1995-06-17' AS later FROM orders")
def date_after(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+09:00'")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", (T.written_date(stamp) > F.to_date(F.lit("1995-06-17"))).alias("later"))


@query("""SELECT text FROM documents INTERSECT SELECT text FROM benchmark UNION SELECT DISTINCT r_name FROM region
  WHERE r_name IN (SELECT r_name FROM region WHERE r_regionkey > 1)""")
def literal_intersection(spark, sf_dir):
    t = lambda n, c: V.table(spark, sf_dir, n).select(F.col(c).alias("text"))
    r = V.table(spark, sf_dir, "region")
    return t("documents", "text").intersect(t("benchmark", "text")).union(r.select(F.col("r_name").alias("text")).intersect(r.where("r_regionkey > 1").select("r_name")))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'epoch' END AS missing, CASE WHEN event_id % 5 = 0 THEN 'extra' END AS unexpected
  FROM events""")
def key_set_check(spark, sf_dir):
    keys = F.filter(F.array(F.lit("run"), F.when(F.col("event_id") % 4 != 0, F.lit("epoch")), F.when(F.col("event_id") % 5 == 0, F.lit("extra"))), lambda x: x.isNotNull())
    e = V.table(spark, sf_dir, "events").select("event_id", keys.alias("k"))
    want = F.array(F.lit("run"), F.lit("epoch"))
    one = lambda a: F.nullif(F.array_join(F.array_sort(a), ","), F.lit(""))
    return e.select("event_id", one(F.array_except(want, "k")).alias("missing"), one(F.array_except("k", want)).alias("unexpected"))


@query("""WITH s AS (SELECT event_id % 4 AS shard, event_type, user_id FROM events) SELECT count(DISTINCT shard) AS shards, count(*) AS n,
  (SELECT count(*) FROM (SELECT 1 FROM s GROUP BY event_type, user_id HAVING count(*) > 1)) AS repeated FROM s""")
def shard_union(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    shards = [e.where(F.col("event_id") % 4 == k).withColumn("shard", F.lit(k)) for k in range(4)]
    u = shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])
    again = audit.duplicates(u, ["event_type", "user_id"]).agg(F.count(F.lit(1)).alias("repeated"))
    return u.agg(F.countDistinct("shard").alias("shards"), F.count(F.lit(1)).alias("n")).crossJoin(again)  # one row each


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def membership(spark, sf_dir):
    allowed = spark.createDataFrame([("click",), ("view",)], "event_type string")
    return V.table(spark, sf_dir, "events").select("event_type").distinct().join(F.broadcast(allowed), "event_type", "left_anti")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 25")
def row_limit(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id").limit(25)


@query("""WITH b AS (SELECT model, seed, model || '-' || seed AS run_id, round(avg(ok), 6) AS f1, 100 AS epochs FROM c GROUP BY ALL), m AS (SELECT run_id, CASE WHEN seed = 37 THEN f1 + 0.1 ELSE f1 END AS f1, CASE WHEN model = 'm2' AND seed = 13 THEN 99 ELSE 100 END AS epochs, model = 'm3' AND seed = 101 AS test_accessed FROM b)
SELECT b.run_id, array_to_string(list_filter([CASE WHEN abs(b.f1 - m.f1) > 1e-12 THEN 'f1' END, CASE WHEN m.epochs <> 100 THEN 'epochs' END,
  CASE WHEN m.test_accessed THEN 'test_access' END], lambda x: x IS NOT NULL), ',') AS issues FROM b JOIN m USING (run_id)""", "c")
def run_audit(spark, sf_dir):
    b = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.round(F.avg("ok"), 6).alias("f1")).withColumn("run_id", F.concat_ws("-", "model", F.col("seed").cast("string")))
    odd = lambda m, s: (F.col("model") == m) & (F.col("seed") == s)
    m = b.select("run_id", (F.col("f1") + F.when(F.col("seed") == 37, 0.1).otherwise(0.0)).alias("mf1"), F.when(odd("m2", 13), 99).otherwise(100).alias("epochs"), odd("m3", 101).alias("test_accessed"))
    rules = {"f1": F.abs(F.col("f1") - F.col("mf1")) <= 1e-12, "epochs": F.col("epochs") == 100, "test_access": ~F.col("test_accessed")}
    return audit.violations(b.join(m, "run_id"), rules).select("run_id", F.array_join("issues", ",").alias("issues"))


@query()
def binding_verify(spark, sf_dir):
    from ..sources.files import listing

    kept = sinks.scratch(spark, "listing")
    listing(spark, sf_dir, "*.parquet", recursive=False).write.parquet(kept)  # each file is read once
    files = spark.read.schema("path string, size long, modified timestamp, sha256 string").parquet(kept)
    manifest = files.select("path", F.when(F.col("path").endswith("nation.parquet"), F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha256")
    return audit.bound(files, manifest)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem
  WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def sink_roundtrip(spark, sf_dir):
    from ..sources import sinks

    rows = V.table(spark, sf_dir, "lineitem").where("l_shipdate <= date'1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    path = sinks.scratch(spark, "report")
    sinks.publish(rows, path, "json")
    return spark.read.schema(rows.schema).json(path)
