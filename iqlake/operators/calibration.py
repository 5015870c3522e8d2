"""Calibration of class scores. Ids A27-A30, P16, P17 of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

BINS, FLOOR = 15, 1e-12


def probabilities(rows: DataFrame, logits: str = "l") -> DataFrame:
    """``rows`` with p (softmax), pred (first maximum), confidence and hit. P16, P17."""
    out = rows.withColumn("_e", A.softmax(F.col(logits))).withColumn("_s", A.total(F.col("_e")))
    out = out.withColumn("p", F.transform("_e", lambda x: x / F.col("_s"))).drop("_e", "_s")
    return out.withColumn("pred", A.argmax(F.col(logits))).withColumn("confidence", F.array_max("p")).withColumn("hit", (F.col("pred") == F.col("target")).cast("int"))


def ece(rows: DataFrame, bins: int = BINS, closed_left: bool = True) -> DataFrame:
    """One row: expected calibration error over equal bins. [lo, hi) with the last one closed (A29), or (lo, hi], which has no
    place for a confidence of 0 (A30)."""
    c, edge = F.col("confidence"), lambda k: k / F.lit(bins)
    if closed_left:
        near = F.floor(c * bins)
        k = F.least(F.when(c < edge(near), near - 1).when(c >= edge(near + 1), near + 1).otherwise(near), F.when(c <= 1, F.lit(bins - 1)))
    else:
        near = F.ceil(c * bins) - 1
        k = F.when(c <= edge(near), near - 1).when(c > edge(near + 1), near + 1).otherwise(near)
    binned = rows.select("confidence", "hit", k.alias("bin")).where(F.col("bin").between(0, bins - 1))
    per_bin = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("k"), F.avg("hit").alias("acc"), F.avg("confidence").alias("conf"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    gaps = per_bin.agg(F.sum(F.col("k") * F.abs(F.col("acc") - F.col("conf"))).alias("g"), F.sum("k").alias("binned"))
    return gaps.crossJoin(F.broadcast(total)).select(F.round(F.col("g") / F.col("n"), 9).alias("ece"), "binned", "n")


def losses(rows: DataFrame, classes: int) -> DataFrame:
    """One row: mean negative log likelihood with its floor, and Brier score. A27, A28."""
    own = F.element_at("p", F.col("target") + 1)
    brier = A.total(F.zip_with("p", A.one_hot(F.col("target"), classes), lambda p, y: (p - y) * (p - y)))
    return rows.agg(F.round(F.avg(-F.log(F.greatest(own, F.lit(FLOOR)))), 9).alias("nll"), F.round(F.avg(brier), 9).alias("brier"), F.round(F.avg("hit"), 9).alias("accuracy"))
