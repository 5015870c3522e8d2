"""Paired hierarchical bootstrap and permutation intervals. Ids A37-A43 of the survey."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Slots of a resampled stratum that are drawn in a row at most.
SLOTS = 1 << 12


def differences(rows: DataFrame, reference: str, variant: str) -> DataFrame:
    """(seed, target, snr_db, vec_id, d): per sample, the reference's hit less the variant's, joined by key."""
    a = rows.where(F.col("model") == reference).select("seed", "vec_id", "target", "snr_db", F.col("ok").alias("x"))
    b = rows.where(F.col("model") == variant).select("seed", "vec_id", F.col("ok").alias("y"))
    return a.join(b, ["seed", "vec_id"]).select("seed", "vec_id", "target", "snr_db", (F.col("x") - F.col("y")).alias("d"))


def draw(key, n):
    """A place in [0, n) that a digest of the key decides: the same in every engine."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % n).cast("int")


def hash_bootstrap(diffs: DataFrame, seeds: Sequence[int], resamples: int, seed: int = 2026) -> DataFrame:
    """(b, snr_db, d, n): sums of resampled differences for each resample and level, with draws that SQL can repeat.

    A resample draws as many seeds as there are, then within each drawn seed as many rows of every (target, snr_db) stratum as
    it has. Each slot's draw is a digest. A difference is -1, 0 or 1, so a stratum is known by its counts, and a drawn place in
    it, rows being in the order of d, tells the difference without a join. As every slot costs a digest, the work is resamples
    times rows, cut into runs of SLOTS slots at most that are dealt to all tasks, however few the strata are and whatever their
    sizes; ``bootstrap`` is the form whose cost doesn't follow the rows.
    """
    spark = diffs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    sizes = diffs.groupBy("seed", "target", "snr_db").agg(F.count_if(F.col("d") < 0).alias("less"), F.count_if(F.col("d") <= 0).alias("upto"), F.count(F.lit(1)).cast("int").alias("m"))
    b = spark.range(resamples).select(F.col("id").cast("int").alias("b"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(len(seeds) - 1))).alias("slot")
    drawn = b.select("b", slots).withColumn("seed", F.element_at(F.array(*map(F.lit, seeds)), draw(F.concat_ws(":", F.lit(str(seed)), "b", "slot"), len(seeds)) + 1))
    runs = drawn.join(sizes, "seed").select("b", "slot", "target", "snr_db", "less", "upto", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(SLOTS))).alias("first"))
    runs = runs.repartition(parts, "b", "slot", "target", "snr_db", "first").withColumn("key", F.concat_ws(":", F.lit(str(seed)), "b", "slot", "target", "snr_db"))
    last = F.least(F.col("first") + (SLOTS - 1), F.col("m") - 1)
    cells = runs.select("b", "snr_db", "less", "upto", "m", "key", F.explode(F.sequence("first", last)).alias("p"))
    k = draw(F.concat_ws(":", "key", "p"), F.col("m"))
    d = F.when(k < F.col("less"), -1).when(k < F.col("upto"), 0).otherwise(1)
    return cells.groupBy("b", "snr_db").agg(F.sum(d).alias("d"), F.count(F.lit(1)).alias("n"))


def interval(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., mean, std, lowest, highest, lower, upper, positive, n): 2.5 and 97.5 percentiles by linear interpolation. A39, A40."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"), p.alias("_p"), F.count_if(F.col(value) > 0).alias("positive"), F.count(F.lit(1)).alias("n"))
    r = lambda c: F.round(c, 9)
    return out.select(*by, r("mean").alias("mean"), r("std").alias("std"), r("lowest").alias("lowest"), r("highest").alias("highest"), r(F.col("_p")[0]).alias("lower"), r(F.col("_p")[1]).alias("upper"), "positive", "n")


def predictions(rows: DataFrame, reference: str, variant: str) -> DataFrame:
    """(seed, target, snr_db, x, y): both models' predictions of each sample, joined by key."""
    a = rows.where(F.col("model") == reference).select("seed", "vec_id", "target", "snr_db", F.col("pred").alias("x"))
    b = rows.where(F.col("model") == variant).select("seed", "vec_id", F.col("pred").alias("y"))
    return a.join(b, ["seed", "vec_id"]).select("seed", "target", "snr_db", "x", "y")


def f1_of(confusion: np.ndarray) -> np.ndarray:
    """Macro-F1 of confusion matrices (..., target, prediction); classes that don't occur count 0."""
    hits = np.diagonal(confusion, axis1=-2, axis2=-1)
    down = confusion.sum(-1) + confusion.sum(-2)
    return np.divide(2.0 * hits, down, out=np.zeros(down.shape), where=down > 0).mean(-1)


class Strata:
    """What a bootstrap draws from: by seed, the strata with their counts of (prediction of either model).

    ``tables[seed]`` is (target, level, x, y, share, size): one row per stratum, its pairs of predictions padded with share 0.
    """

    def __init__(self, pairs: DataFrame, seeds: Sequence[int], classes: int):
        counts = pairs.groupBy("seed", "target", "snr_db", "x", "y").agg(F.count(F.lit(1)).alias("n")).collect()
        self.seeds, self.classes, self.tables = list(seeds), classes, {}
        levels = sorted({r.snr_db for r in counts})
        self.levels = levels
        strata: dict[tuple, list] = {}
        for r in counts:
            strata.setdefault((r.seed, r.target, r.snr_db), []).append((r.x, r.y, r.n))
        for s in seeds:
            mine = sorted((k[1:], sorted(v)) for k, v in strata.items() if k[0] == s)
            width = max((len(v) for _, v in mine), default=1)
            x, y, n = (np.array([[c[k] for c in v] + [0] * (width - len(v)) for _, v in mine], np.int64).reshape(len(mine), width) for k in range(3))
            target = np.array([k[0] for k, _ in mine], np.int64)
            size = n.sum(1)
            self.tables[s] = (target, np.array([levels.index(k[1]) for k, _ in mine], np.int64), x, y, n / np.maximum(size, 1)[:, None], size, n)

    def confusions(self, s: int, n: np.ndarray) -> np.ndarray:
        """(2, classes, classes): the confusion matrices of either model for counts ``n`` of a seed's strata."""
        target, _, x, y, *_ = self.tables[s]
        out = np.zeros((2, self.classes, self.classes), np.int64)
        at = np.broadcast_to(target[:, None], x.shape)
        np.add.at(out[0], (at, x), n)
        np.add.at(out[1], (at, y), n)
        return out

    def hits(self, s: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(differences, rows) by level for counts ``n`` of a seed's strata."""
        target, level, x, y, *_ = self.tables[s]
        gap = (x == target[:, None]).astype(np.int64) - (y == target[:, None])
        return np.bincount(level, (gap * n).sum(1), len(self.levels)).astype(np.int64), np.bincount(level, n.sum(1), len(self.levels)).astype(np.int64)

    def observed(self, metric: str) -> float:
        """The mean over seeds of the metric's difference. A41."""
        found = []
        for s in self.seeds:
            n = self.tables[s][-1]
            d, m = self.hits(s, n)
            found.append(d.sum() / m.sum() if metric == "accuracy" else float(np.subtract(*f1_of(self.confusions(s, n)))))
        return float(np.mean(found))


def bootstrap(pairs: DataFrame, seeds: Sequence[int], resamples: int, classes: int, metric: str = "accuracy", seed: int = 2026, chunk: int = 64) -> DataFrame:
    """Paired hierarchical bootstrap over rows of ``predictions``. A37, A38.

    A resample draws as many seeds as there are, then within each drawn seed every (target, snr_db) stratum anew; sums are pooled
    over the drawn seeds. For accuracy the result is (b, snr_db, d, n), so one draw serves all levels and scopes; for macro_f1
    it is (b, v), the difference of the pooled confusion matrices' macro-F1.

    What a task gets are the strata's counts of pairs of predictions, whose number follows the classes and levels but not the
    rows, as resampling a stratum is a multinomial draw from these. A chunk of resamples is drawn with a generator of its own,
    so it comes out the same in every attempt.
    """
    if metric not in ("accuracy", "macro_f1"):
        raise ValueError("metric must be accuracy or macro_f1")
    strata = Strata(pairs, seeds, classes)
    if not strata.levels or any(not len(t[0]) for t in strata.tables.values()):
        raise ValueError("every seed needs rows")
    level = pairs.schema["snr_db"].dataType.simpleString()

    def resample(b: int, rng: np.random.Generator) -> pd.DataFrame:
        total, d, m = 0, 0, 0
        for s in rng.choice(strata.seeds, len(strata.seeds)).tolist():
            n = rng.multinomial(strata.tables[s][5], strata.tables[s][4])
            if metric == "accuracy":
                d, m = (u + v for u, v in zip((d, m), strata.hits(s, n), strict=True))
            else:
                total = total + strata.confusions(s, n)
        if metric == "accuracy":
            return pd.DataFrame({"b": b, "snr_db": strata.levels, "d": d, "n": m})
        return pd.DataFrame({"b": [b], "v": [float(np.subtract(*f1_of(total)))]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in (c for f in frames for c in f.id.tolist()):
            rng = np.random.default_rng([seed, c])
            yield pd.concat([resample(b, rng) for b in range(c * chunk, min(resamples, (c + 1) * chunk))])

    return pairs.sparkSession.range(-(-resamples // chunk)).mapInPandas(run, f"b int, snr_db {level}, d long, n long" if metric == "accuracy" else "b int, v double")


def contrast(pairs: DataFrame, seeds: Sequence[int], resamples: int, classes: int, low: Sequence[int], seed: int = 2026) -> DataFrame:
    """(metric, scope, mean_difference, bootstrap_mean, ci_lower, ci_upper, positive_seeds): both metrics, over all levels and over
    the low ones, which are drawn for themselves. A43."""
    d = (F.col("x") == F.col("target")).cast("int") - (F.col("y") == F.col("target")).cast("int")
    positive = pairs.groupBy("seed").agg(F.avg(d).alias("m")).agg(F.count_if(F.col("m") > 0).alias("positive_seeds"))
    out = None
    for metric in ("accuracy", "macro_f1"):
        for scope, rows in (("overall", pairs), ("low_snr", pairs.where(F.col("snr_db").isin(*low)))):
            b = bootstrap(rows, seeds, resamples, classes, metric, seed)
            if metric == "accuracy":
                b = b.groupBy("b").agg((F.sum("d") / F.sum("n")).alias("v"))
            p = F.percentile("v", F.array(F.lit(0.025), F.lit(0.975)))
            row = b.agg(F.avg("v").alias("bootstrap_mean"), p.alias("p"))
            row = row.select(F.lit(metric).alias("metric"), F.lit(scope).alias("scope"), F.lit(Strata(rows, seeds, classes).observed(metric)).alias("mean_difference"), "bootstrap_mean", F.col("p")[0].alias("ci_lower"), F.col("p")[1].alias("ci_upper"))
            out = row if out is None else out.unionByName(row)
    return out.crossJoin(F.broadcast(positive))  # one row of seeds
