"""Run logs and folds over epochs. Ids S22, S27, W07, W08, W11, W12, A47, Z01, Z02, Z06 of the survey."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ordered import before


def parse_log(lines: DataFrame) -> DataFrame:
    """(run, epoch) of JSON events and of ``key=value`` lines; other lines give nothing. S27."""
    j = F.when(F.col("value").startswith("{"), F.from_json("value", "run string, epoch int"))
    run = F.coalesce(j["run"], F.nullif(F.regexp_extract("value", r"run=(\S+)", 1), F.lit("")))
    epoch = F.coalesce(j["epoch"], F.regexp_extract("value", r"epoch=(\d+)", 1).try_cast("int"))
    return lines.select(run.alias("run"), epoch.alias("epoch")).where("run is not null and epoch is not null")


def latest(events: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The value of each group's last event. Works on streams too, in update or complete mode. Z01."""
    return events.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(f"latest_{value}"))


def place_of(time: str) -> Column:
    """A time as a number, for ``ordered``."""
    return F.col(time).cast("timestamp").cast("double")


def running_best(runs: DataFrame, by: list[str], order: list[str], score: str) -> DataFrame:
    """``runs`` with best (up to here) and improved (above all before); the first of ``order`` is a time. W07 without a minimal gain."""
    seen = before(runs, by, order, place_of(order[0]), {"_b": ("max", F.col(score))})
    return seen.withColumn("improved", F.col("_b").isNull() | (F.col(score) > F.col("_b"))).withColumn("best", F.greatest(F.coalesce("_b", score), score)).drop("_b")


def selected_epoch(runs: DataFrame, by: list[str], order: list[str], score: str) -> DataFrame:
    """(by..., epochs, best_epoch, best_score): number of rows, and place from 1 and score of the first of the best, by ``order``.

    Sums and extremes that are combined before the shuffle; no group is gathered. A group without scores has no best.
    """
    rows = runs.select(*by, score, F.struct(*order, score).alias("_x"))

    def beside(few: DataFrame) -> DataFrame:
        few = few.select(*(F.col(c).alias(f"_{c}") for c in by), few.columns[-1])
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        return rows.join(few, on, "left").drop(*(f"_{c}" for c in by))

    top = beside(rows.groupBy(*by).agg(F.max(score).alias("_top")))
    first = top.where(F.col(score) == F.col("_top")).groupBy(*by).agg(F.min("_x").alias("_first"))
    at = F.when(F.max("_first").isNotNull(), (F.count_if(F.col("_x") < F.col("_first")) + 1).cast("int"))
    out = beside(first).groupBy(*by).agg(F.count(F.lit(1)).alias("epochs"), at.alias("best_epoch"), F.max("_first")[score].alias("_s"))
    return out.select(*by, "epochs", "best_epoch", F.round("_s", 6).alias("best_score"))


@dataclass
class Patience:
    """How far a run has come: the best score and its place, stale epochs since, where it stopped (0: it hasn't), epochs seen."""

    best: float = -math.inf
    best_at: int = 0
    stale: int = 0
    stopped_at: int = 0
    seen: int = 0

    def fold(self, scores: np.ndarray, gain: float, most: int) -> Patience:
        """Go on with the scores of the next epochs; NaN is a stale one. Runs of stale epochs are skipped over, not stepped through."""
        at, n, width = 0, len(scores), 16
        while at < n and not self.stopped_at:
            better = scores[at : at + width] > self.best + gain
            found = bool(better.any())
            skip = int(better.argmax()) if found else len(better)
            if self.stale + skip >= most:
                self.stopped_at = self.seen + at + most - self.stale
                self.stale = most
                break
            self.stale += skip
            at += skip
            if found:
                at += 1
                self.best, self.best_at, self.stale, width = float(scores[at - 1]), self.seen + at, 0, 16
            else:
                width *= 2
        self.seen += n
        return self


def patience(runs: DataFrame, by: list[str], order: list[str], score: str, gain: float, most: int) -> DataFrame:
    """(by..., best, best_at, stale, stopped_at) of each run: an improvement is a gain of more than ``gain`` on the best so far,
    and the run stops after ``most`` stale epochs in a row; places count from 1, stopped_at 0 means that it ran to its end. A
    null or NaN score is stale. The general case of W07.

    Each step needs the one before, so a run is folded in order; its rows stream past in batches and only the state is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, Patience()

        def row() -> pa.RecordBatch:
            values = (*key, state.best, state.best_at, state.stale, state.stopped_at)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True))
            scores = batch.column(len(by)).to_numpy(zero_copy_only=False)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and keys[a] != key:
                    if key is not None:
                        yield row()
                    key, state = keys[a], Patience()
                state.fold(scores[a:b], gain, most)
        if key is not None:
            yield row()

    rows = runs.select(*by, F.col(score).cast("double").alias("_score"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *(f"_{i}" for i in range(len(order))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[: len(by)])
    schema = f"{kinds}, best double, best_at int, stale int, stopped_at int"
    out = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in rows.schema[: len(by)]] + [("best", pa.float64()), ("best_at", pa.int32()), ("stale", pa.int32()), ("stopped_at", pa.int32())])
    return dealt.select(*by, "_score").mapInArrow(run, schema)


def weighted_mean(value: str, weight: str) -> Column:
    """A36, A47."""
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def running_loss(batches: DataFrame, by: list[str], order: list[str], loss: str, n: str) -> DataFrame:
    """``batches`` with running_loss: losses so far, weighted by samples; the first of ``order`` is a time. W11."""
    sums = before(batches, by, order, place_of(order[0]), {"_l": ("sum", F.col(loss) * F.col(n)), "_n": ("sum", F.col(n))})
    so_far = lambda earlier, own: F.coalesce(earlier, F.lit(0)) + F.coalesce(own, F.lit(0))
    return sums.withColumn("running_loss", so_far(F.col("_l"), F.col(loss) * F.col(n)) / so_far(F.col("_n"), F.col(n))).drop("_l", "_n")


def cosine_rate(rate: float, epoch: Column, total: int) -> Column:
    """W12."""
    return rate * (1 + F.cos(epoch * math.pi / total)) / 2


def status(runs: DataFrame, done: DataFrame, started: DataFrame, key: str) -> DataFrame:
    """(key, status): done, running or queued. Z02."""
    d, s = done.select(key).distinct().withColumn("_d", F.lit(True)), started.select(key).distinct().withColumn("_s", F.lit(True))
    out = runs.select(key).distinct().join(d, key, "left").join(s, key, "left")
    return out.select(key, F.when(F.col("_d"), "done").when(F.col("_s"), "running").otherwise("queued").alias("status"))


def remaining(runs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Runs that are still to do. Z06."""
    return runs.join(done.select(key), key, "left_anti")
