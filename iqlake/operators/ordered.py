"""Numbers, totals and extremes along the order of long groups, without a task for each whole group.

A group is cut where quantiles of its position fall. What a chunk adds up to is one row, so that the sums over earlier chunks are
cheap, and within a chunk a plain window does. Few rows make one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a chunk is meant to have, and chunks at most; bytes of a table that isn't counted first, as it makes one chunk.
ROWS, CHUNKS, SMALL = 1 << 20, 4096, 64 << 20


def small(rows: DataFrame, most: int = SMALL) -> bool:
    """Whether the optimiser's estimate of the rows' size is at most ``most`` bytes; no job runs for it."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def chunked(rows: DataFrame, position: Column, per: int | None = None) -> tuple[DataFrame, bool]:
    """(``rows`` with _chunk, whether there are several). Chunks ascend with ``position``, a number; null comes first."""
    n = 0 if per is None and small(rows) else rows.count()
    k = min(CHUNKS, math.ceil(n / (per or ROWS)))
    at = F.coalesce(position.cast("double"), F.lit(float("-inf")))
    cuts = rows.agg(F.percentile_approx(at, F.array(*(F.lit(i / k) for i in range(1, k))), 100 * k)).first()[0] if k > 1 else None
    cuts = sorted({c for c in cuts or [] if math.isfinite(c)})
    if not cuts:
        return rows.withColumn("_chunk", F.lit(0)), False
    from pyspark.ml.feature import Bucketizer

    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_chunk", handleInvalid="keep")
    return split.transform(rows.withColumn("_at", at)).withColumn("_chunk", F.col("_chunk").cast("int")).drop("_at"), True


def before(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], position: Column, values: dict[str, tuple[str, Column]], per: int | None = None) -> DataFrame:
    """``rows`` with, for each name in ``values``, the sum or max of a column over the rows of its group that come before it.

    ``values``: name -> ("sum" or "max", column). Nothing before gives null. ``position`` is a number that ascends with the first
    of ``order``; rows that tie on all of ``order`` come in any order.
    """
    kinds = {"sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)), "max": (F.max, lambda a, b: F.greatest(a, b))}
    own, several = chunked(rows.select("*", F.struct(*by).alias("_by")), position, per)
    dealt = own
    within = Window.partitionBy("_by", "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, column) in values.items():
        dealt = dealt.withColumn(name, kinds[kind][0](column).over(within))
    if not several:
        return dealt.drop("_by", "_chunk")
    totals = own.groupBy("_by", "_chunk").agg(*(kinds[k][0](c).alias(f"_{n}") for n, (k, c) in values.items()))
    earlier = Window.partitionBy("_by").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_by", "_chunk", *(kinds[k][0](f"_{n}").over(earlier).alias(f"_{n}") for n, (k, _) in values.items()))
    out = dealt.join(totals, ["_by", "_chunk"])
    for name, (kind, _) in values.items():
        out = out.withColumn(name, kinds[kind][1](F.col(f"_{name}"), F.col(name))).drop(f"_{name}")
    return out.drop("_by", "_chunk")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], position: Column, name: str, per: int | None = None) -> DataFrame:
    """``rows`` with ``name``, each row's number in its group by ``order``, from 0 on."""
    out = before(rows, by, order, position, {name: ("sum", F.lit(1).cast("long"))}, per)
    return out.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], per: int | None = None) -> DataFrame:
    """(by..., n, q0, q1...): exact quantiles with linear interpolation of the values that aren't null.

    Values are counted first; cumulative counts then tell between which two different values a quantile lies.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    ranked = before(counts, by, ["_v"], F.col("_v"), {"_b": ("sum", F.col("_m"))}, per).withColumn("_b", F.coalesce("_b", F.lit(0)))
    total = counts.groupBy(*by).agg(F.sum("_m").alias("n"))
    ranked = ranked.join(total.select(F.struct(*by).alias("_g"), "n"), F.struct(*by) == F.col("_g")).drop("_g")
    held = lambda i: F.max(F.when((F.col("_b") <= i) & (i < F.col("_b") + F.col("_m")), F.col("_v")))
    picks = []
    for k, q in enumerate(shares):
        at = F.lit(q) * (F.col("n") - 1)
        picks += [held(F.floor(at)).alias(f"_l{k}"), held(F.ceil(at)).alias(f"_h{k}")]
    out = ranked.groupBy(*by, "n").agg(*picks)
    between = lambda k, q: F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * (F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)))
    return out.select(*by, "n", *(between(k, q).alias(f"q{k}") for k, q in enumerate(shares)))
