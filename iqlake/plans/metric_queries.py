"""Queries over replays: metrics, alignment, paired differences, run selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import skyline
from . import views as V
from .registry import query

_LOW = ", ".join(map(str, V.LOW_SNR))
F1 = """f AS (SELECT model, seed, cls, count(*) FILTER (target = cls AND pred = cls) AS tp, count(*) FILTER (target = cls) AS a, count(*) FILTER (pred = cls) AS b
  FROM r, (SELECT unnest(range(10)) AS cls) GROUP BY ALL)"""


@query("SELECT model, seed, target, pred, count(*) AS n FROM r GROUP BY ALL", "r")
def confusion_matrix(spark, sf_dir):
    return M.confusion(V.replays(spark, sf_dir), ["model", "seed"])


@query("SELECT model, target, " + ", ".join(f"count(*) FILTER (pred = {k}) AS p{k}" for k in range(10)) + ", round(avg((pred = target)::int), 9) AS recall FROM r GROUP BY ALL", "r")
def confusion_pivot(spark, sf_dir):
    return M.confusion_pivot(V.replays(spark, sf_dir), ["model"], list(range(V.CLASSES)))


@query(f"""WITH {F1} SELECT model, seed, round(avg(CASE WHEN a + b > 0 THEN 2.0::double * tp / (a + b) ELSE 0 END), 9) AS macro_f1 FROM f
  GROUP BY ALL""", "r")
def macro_f1_fixed_classes(spark, sf_dir):
    return M.macro_f1(V.replays(spark, sf_dir), ["model", "seed"], V.class_dim(spark))


@query("""WITH k AS (SELECT model, seed, snr_db, target AS cls FROM r UNION SELECT model, seed, snr_db, pred FROM r),
g AS (SELECT k.*, count(*) FILTER (target = cls AND pred = cls) AS tp, count(*) FILTER (target = cls) AS a,
  count(*) FILTER (pred = cls) AS b FROM k JOIN r USING (model, seed, snr_db) GROUP BY ALL)
SELECT model, seed, snr_db, round(avg(2.0::double * tp / (a + b)), 9) AS macro_f1 FROM g GROUP BY ALL""", "r")
def macro_f1_observed_labels(spark, sf_dir):
    return M.macro_f1(V.replays(spark, sf_dir), ["model", "seed", "snr_db"])


@query("SELECT model, snr_db, round(avg(ok), 9) AS accuracy, count(*) AS n FROM c GROUP BY ALL", "c")
def per_snr_accuracy(spark, sf_dir):
    return M.accuracy(V.checked(spark, sf_dir), ["model", "snr_db"])


@query("""SELECT snr_db, round(avg(abs(snr_db + 4 * embedding[1]::double - snr_db)), 6) AS mae, count(*) AS n
FROM (SELECT *, ((vec_id % 10) * 2 - 10)::int AS snr_db FROM embeddings) GROUP BY ROLLUP (snr_db)""")
def snr_mae(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select(V.snr_of(F.col("vec_id")).alias("snr_db"), F.col("embedding")[0].cast("double").alias("x"))
    return M.error_by_level(e.withColumn("hat", F.col("snr_db") + 4 * F.col("x")), "snr_db", "hat")


@query(f"SELECT model, seed, round(avg(ok), 9) AS low_accuracy, count(*) AS n FROM c WHERE snr_db IN ({_LOW}) GROUP BY ALL", "c")
def low_snr_pooled(spark, sf_dir):
    rows = V.checked(spark, sf_dir).where(F.col("snr_db").isin(*V.LOW_SNR))
    return M.accuracy(rows, ["model", "seed"], "low_accuracy")


@query(f"""SELECT model, seed, round(avg(a), 9) AS mean FROM (SELECT model, seed, snr_db, avg(ok) AS a FROM c WHERE snr_db IN ({_LOW})
  GROUP BY ALL) GROUP BY ALL""", "c")
def low_snr_mean_of_means(spark, sf_dir):
    rows = V.checked(spark, sf_dir).where(F.col("snr_db").isin(*V.LOW_SNR))
    return M.mean_of_means(rows, ["model", "seed"], "snr_db")


@query(f"""SELECT model, target, snr_db, grouping(snr_db)::int AS all_levels, round(avg(ok), 9) AS accuracy, round(avg(ok) FILTER (lv IN ({_LOW})), 9) AS low_accuracy, count(*) AS n
FROM (SELECT *, snr_db AS lv FROM c) GROUP BY GROUPING SETS ((model, target), (model, target, snr_db))""", "c")
def accuracy_grouping_sets(spark, sf_dir):
    return M.by_grains(V.checked(spark, sf_dir).withColumn("snr_db_raw", F.col("snr_db")), V.LOW_SNR)


@query(f"""WITH {F1}, m AS (SELECT model, seed, round(avg(CASE WHEN a + b > 0 THEN 2.0::double * tp / (a + b) ELSE 0 END), 9) AS macro_f1 FROM f GROUP BY ALL),
s AS (SELECT model, seed, snr_db, avg(ok) AS a FROM c GROUP BY ALL),
t AS (SELECT model, seed, string_agg(printf('%+d=%.4f', snr_db, round(a, 4)), ';' ORDER BY snr_db) AS per_snr FROM s GROUP BY ALL)
SELECT model, seed, round(avg(ok), 9) AS accuracy, macro_f1, count(*) AS n, per_snr FROM c JOIN m USING (model, seed) JOIN t USING (model,
  seed) GROUP BY ALL""", "c")
def classification_metrics(spark, sf_dir):
    return M.metrics(V.checked(spark, sf_dir), ["model", "seed"], V.class_dim(spark))


@query("""WITH b AS (SELECT vec_id, target, snr_db FROM r WHERE model = 'm1' AND seed = 13),
x AS (SELECT model, seed, vec_id, CASE WHEN vec_id % 97 = 5 AND model = 'm2' THEN target + 1 ELSE target END AS target, snr_db FROM r
  WHERE NOT (model = 'm3' AND vec_id % 50 = 3)),
g AS (SELECT DISTINCT model, seed FROM x), w AS (SELECT * FROM g, b),
j AS (SELECT coalesce(x.model, w.model) AS model, coalesce(x.seed, w.seed) AS seed, x.vec_id AS xv, w.vec_id AS wv, x.target IS NOT DISTINCT
  FROM w.target AND x.snr_db IS NOT DISTINCT FROM w.snr_db AS same
  FROM x FULL JOIN w ON x.model = w.model AND x.seed = w.seed AND x.vec_id = w.vec_id)
SELECT model, seed, count(*) FILTER (xv IS NOT NULL AND wv IS NOT NULL AND same) AS matched, count(*) FILTER (xv IS NULL) AS missing,
  count(*) FILTER (wv IS NULL) AS extra,
  count(*) FILTER (xv IS NOT NULL AND wv IS NOT NULL AND NOT same) AS differing FROM j GROUP BY ALL""", "r")
def replay_alignment_check(spark, sf_dir):
    r = V.replays(spark, sf_dir)
    base = r.where("model = 'm1' and seed = 13").select("vec_id", "target", "snr_db")
    odd = r.where("not (model = 'm3' and vec_id % 50 = 3)").withColumn("target", F.when((F.col("vec_id") % 97 == 5) & (F.col("model") == "m2"), F.col("target") + 1).otherwise(F.col("target")))
    return M.alignment(odd, "vec_id", ["target", "snr_db"], ["model", "seed"], base)


@query("SELECT seed, vec_id, " + ", ".join(f"max(pred) FILTER (model = '{m}') AS pred_{m}, max(ok) FILTER (model = '{m}') AS ok_{m}" for m, _ in V.MODELS) + " FROM c GROUP BY ALL", "c")
def replay_wide_join(spark, sf_dir):
    return M.wide(V.checked(spark, sf_dir), [m for m, _ in V.MODELS])


@query(f"""WITH a AS (SELECT model, seed, avg(ok) AS acc, avg(ok) FILTER (snr_db IN ({_LOW})) AS low FROM c GROUP BY ALL), {F1},
m AS (SELECT model, seed, avg(CASE WHEN a + b > 0 THEN 2.0::double * tp / (a + b) ELSE 0 END) AS f1 FROM f GROUP BY ALL),
z AS (SELECT model, seed, acc, low, round(f1, 9) AS f1 FROM a JOIN m USING (model, seed)),
d AS (SELECT x.seed, x.acc - y.acc AS acc, x.low - y.low AS low, x.f1 - y.f1 AS f1 FROM z x JOIN z y ON x.seed = y.seed AND x.model = 'm3'
  AND y.model = 'm1'),
u AS (SELECT seed, 'accuracy' AS metric, acc AS diff FROM d UNION ALL SELECT seed, 'low_snr', low FROM d UNION ALL SELECT seed, 'macro_f1', f1 FROM d)
SELECT metric, round(avg(diff), 9) AS mean_diff, count(*) FILTER (diff > 0) AS positive_seeds, count(*) AS n FROM u GROUP BY ALL""", "c")
def paired_seed_differences(spark, sf_dir):
    c = V.checked(spark, sf_dir)
    by_seed = c.groupBy("model", "seed").agg(F.avg("ok").alias("accuracy"), F.avg(F.when(F.col("snr_db").isin(*V.LOW_SNR), F.col("ok"))).alias("low_snr"))
    rows = by_seed.join(M.macro_f1(c, ["model", "seed"], V.class_dim(spark)), ["model", "seed"])
    rows = rows.unpivot(["model", "seed"], ["accuracy", "low_snr", "macro_f1"], "metric", "value")
    diffs = M.paired(rows, "m3", "m1", ["metric", "seed"], "value")
    return diffs.groupBy("metric").agg(F.round(F.avg("diff"), 9).alias("mean_diff"), F.count_if(F.col("diff") > 0).alias("positive_seeds"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT model, seed, snr_db, avg(ok) AS acc FROM c GROUP BY ALL), d AS (SELECT x.seed, x.snr_db, round(x.acc - y.acc, 9) AS diff FROM a x JOIN a y ON x.seed = y.seed AND x.snr_db = y.snr_db AND x.model = 'm3' AND y.model = 'm2')
SELECT snr_db, round(avg(diff), 9) AS mean_diff, round(stddev_samp(diff), 9) AS std_diff, count(*) FILTER (diff > 0) AS positive_seeds
  FROM d GROUP BY ALL""", "c")
def paired_snr_differences(spark, sf_dir):
    rows = V.checked(spark, sf_dir).groupBy("model", "seed", "snr_db").agg(F.avg("ok").alias("a"))
    diffs = M.paired(rows, "m3", "m2", ["seed", "snr_db"], "a")
    return diffs.groupBy("snr_db").agg(F.round(F.avg("diff"), 9).alias("mean_diff"), F.round(F.stddev_samp("diff"), 9).alias("std_diff"), F.count_if(F.col("diff") > 0).alias("positive_seeds"))


@query("""WITH d AS (SELECT a.seed, avg(a.ok - b.ok) AS m FROM c a JOIN c b ON a.seed = b.seed AND a.vec_id = b.vec_id AND a.model = 'm1' AND b.model = 'm2' GROUP BY ALL)
SELECT round(avg(m), 9) AS mean_diff, count(*) AS seeds FROM d""", "c")
def observed_paired_difference(spark, sf_dir):
    c = V.checked(spark, sf_dir)
    d = M.paired(c, "m1", "m2", ["seed", "vec_id"], "ok")
    return d.groupBy("seed").agg(F.avg("diff").alias("m")).agg(F.round(F.avg("m"), 9).alias("mean_diff"), F.count(F.lit(1)).alias("seeds"))


@query(f"""WITH a AS (SELECT model, seed, avg(ok) AS acc, avg(ok) FILTER (snr_db IN ({_LOW})) AS low FROM c GROUP BY ALL)
SELECT model, round(avg(acc), 9) AS mean_accuracy, round(stddev_samp(acc), 9) AS std_accuracy, round(avg(low), 9) AS mean_low,
  round(stddev_samp(low), 9) AS std_low, count(DISTINCT seed) = 5 AS complete FROM a GROUP BY ALL""", "c")
def seed_summary(spark, sf_dir):
    a = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.avg("ok").alias("acc"), F.avg(F.when(F.col("snr_db").isin(*V.LOW_SNR), F.col("ok"))).alias("low"))
    complete = F.array_sort(F.collect_set("seed")) == F.array(*map(F.lit, sorted(V.SEEDS)))
    return a.groupBy("model").agg(F.round(F.avg("acc"), 9).alias("mean_accuracy"), F.round(F.stddev_samp("acc"), 9).alias("std_accuracy"), F.round(F.avg("low"), 9).alias("mean_low"), F.round(F.stddev_samp("low"), 9).alias("std_low"), complete.alias("complete"))


@query("""WITH a AS (SELECT model, seed, snr_db, avg(ok) AS x FROM c GROUP BY ALL)
SELECT model, snr_db, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, round(min(x), 9) AS lowest, round(max(x), 9) AS highest,
  count(*) AS n FROM a GROUP BY ALL""", "c")
def model_snr_summary(spark, sf_dir):
    a = V.checked(spark, sf_dir).groupBy("model", "seed", "snr_db").agg(F.avg("ok").alias("x"))
    return a.groupBy("model", "snr_db").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_samp("x"), 9).alias("std"), F.round(F.min("x"), 9).alias("lowest"), F.round(F.max("x"), 9).alias("highest"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT model, seed_idx, avg(score) AS s, max_by(epoch, (score, event_id)) AS e FROM runs GROUP BY ALL)
SELECT model, round(avg(s), 6) AS mean_score, round(stddev_samp(s), 6) AS std_score, round(avg(e), 6) AS mean_best_epoch,
  round(stddev_samp(e), 6) AS std_best_epoch, count(*) AS n FROM a GROUP BY ALL""", "runs")
def model_summary(spark, sf_dir):
    best = F.max_by("epoch", F.struct("score", "event_id"))
    a = V.runs(spark, sf_dir).groupBy("model", "seed_idx").agg(F.avg("score").alias("s"), best.alias("e"))
    return a.groupBy("model").agg(F.round(F.avg("s"), 6).alias("mean_score"), F.round(F.stddev_samp("s"), 6).alias("std_score"), F.round(F.avg("e"), 6).alias("mean_best_epoch"), F.round(F.stddev_samp("e"), 6).alias("std_best_epoch"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'raw' ELSE 'max_abs' END AS mode, model, seed, target, avg(ok) AS x FROM c GROUP BY ALL)
SELECT mode, target, grouping(target)::int AS all_classes, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std, count(*) AS n FROM a
  GROUP BY GROUPING SETS ((mode), (mode, target))""", "c")
def preprocessing_seed_aggregate(spark, sf_dir):
    mode = F.when(F.col("vec_id") % 2 == 0, "raw").otherwise("max_abs")
    a = V.checked(spark, sf_dir).groupBy(mode.alias("mode"), "model", "seed", "target").agg(F.avg("ok").alias("x"))
    return a.groupingSets([["mode"], ["mode", "target"]], "mode", "target").agg(F.grouping("target").cast("int").alias("all_classes"), F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_samp("x"), 9).alias("std"), F.count(F.lit(1)).alias("n"))


RUN_SCORES = """a AS (SELECT model, seed, model || '-' || seed AS run_id, round(avg(ok), 6) AS f1, round(avg(CASE
  WHEN ok = 1 THEN 0.1 ELSE 1.5 END), 6) AS loss FROM c GROUP BY ALL)"""


def _run_scores(spark, sf_dir):
    return V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.round(F.avg("ok"), 6).alias("f1"), F.round(F.avg(F.when(F.col("ok") == 1, 0.1).otherwise(1.5)), 6).alias("loss")).withColumn("run_id", F.concat_ws("-", "model", F.col("seed").cast("string")))


@query(f"""WITH {RUN_SCORES} SELECT model, run_id, f1, loss FROM a QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, loss,
  run_id) = 1""", "c")
def best_run_topk(spark, sf_dir):
    w = Window.partitionBy("model").orderBy(F.desc("f1"), "loss", "run_id")
    return _run_scores(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("model", "run_id", "f1", "loss")


@query(f"""WITH {RUN_SCORES} SELECT model, round(avg(f1), 6) AS mean_f1, round(avg(loss), 6) AS mean_loss FROM a
  GROUP BY ALL ORDER BY mean_f1 DESC, mean_loss, model LIMIT 1""", "c")
def best_family_member(spark, sf_dir):
    s = _run_scores(spark, sf_dir).groupBy("model").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.avg("loss"), 6).alias("mean_loss"))
    return s.orderBy(F.desc("mean_f1"), "mean_loss", "model").limit(1)


@query(f"""WITH {RUN_SCORES} SELECT model, round(avg(f1), 6) AS mean_f1 FROM a WHERE model <> 'm3' GROUP BY ALL ORDER BY mean_f1 DESC,
  model LIMIT 1""", "c")
def strongest_baseline(spark, sf_dir):
    s = _run_scores(spark, sf_dir).where("model <> 'm3'").groupBy("model").agg(F.round(F.avg("f1"), 6).alias("mean_f1"))
    return s.orderBy(F.desc("mean_f1"), "model").limit(1)


@query("""WITH a AS (SELECT modulation_id, acc, size, ms FROM (SELECT target AS modulation_id, round(avg(ok), 6) AS acc, count(DISTINCT pred) AS size, sum(abs(pred - target)) AS ms FROM c WHERE model = 'm2' GROUP BY ALL))
SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.acc >= a.acc AND b.size <= a.size AND b.ms <= a.ms
  AND (b.acc > a.acc OR b.size < a.size OR b.ms < a.ms))""", "c")
def pareto_front(spark, sf_dir):
    a = V.checked(spark, sf_dir).where("model = 'm2'").groupBy(F.col("target").alias("modulation_id")).agg(F.round(F.avg("ok"), 6).alias("acc"), F.countDistinct("pred").alias("size"), F.sum(F.abs(F.col("pred") - F.col("target"))).alias("ms"))
    return skyline.front(a, ["size", "ms"], ["acc"])


@query("""WITH p AS (SELECT l_discount AS d, l_tax AS t, min(l_extendedprice) AS e FROM lineitem GROUP BY ALL),
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.e <= p.e AND b.t <= p.t AND b.d >= p.d AND (b.e < p.e OR b.t < p.t OR b.d > p.d)))
SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax FROM lineitem JOIN f ON l_discount = d AND l_tax = t AND l_extendedprice = e""")
def pareto_lineitems(spark, sf_dir):
    """J13 over all lines: none is cheaper, less taxed and more discounted."""
    rows = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax")
    return skyline.front(rows, ["l_extendedprice", "l_tax"], ["l_discount"])


@query("""WITH o AS (SELECT DISTINCT model, seed FROM r WHERE NOT (model = 'm2' AND seed = 73) UNION ALL SELECT 'm9', 13), e AS (SELECT model, seed FROM models, seeds)
SELECT coalesce(o.model, e.model) AS model, coalesce(o.seed, e.seed) AS seed, CASE WHEN o.model IS NULL THEN 'missing'
  WHEN e.model IS NULL THEN 'unexpected' ELSE 'present' END AS status FROM o FULL JOIN e ON o.model = e.model AND o.seed = e.seed""", "r")
def run_matrix_audit(spark, sf_dir):
    from ..operators.audit import key_status

    seen = V.replays(spark, sf_dir).where("not (model = 'm2' and seed = 73)").select("model", "seed").distinct()
    seen = seen.union(spark.createDataFrame([("m9", 13)], "model string, seed int"))
    expected = V.model_dim(spark).select("model").crossJoin(V.seed_dim(spark))
    return key_status(expected, seen, ["model", "seed"])
