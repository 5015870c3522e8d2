"""Deterministic stratified splits and their checks. Ids W01-W05, W09, X01-X04, T07 of the survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import before, numbered

#: Splits in order, with their weights.
WEIGHTS = (("train", 7), ("validation", 1), ("test", 2))


def allocate(strata: DataFrame, keys: Sequence[str], n: str = "n", weights: Sequence[tuple[str, int]] = WEIGHTS) -> DataFrame:
    """(keys..., ord, split, cnt): largest remainder, ties by split order. W04."""
    spark = strata.sparkSession
    total = sum(w for _, w in weights)
    dim = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(weights)], "ord int, split string, w int")
    x = strata.select(*keys, F.col(n).alias("_n")).crossJoin(F.broadcast(dim))
    x = x.withColumn("base", F.expr(f"_n * w div {total}")).withColumn("rem", F.col("_n") * F.col("w") % total)
    of = Window.partitionBy(*keys)
    seat = F.row_number().over(of.orderBy(F.desc("rem"), "ord"))
    left = F.col("_n") - F.sum("base").over(of)
    return x.select(*keys, "ord", "split", (F.col("base") + F.when(seat <= left, 1).otherwise(0)).alias("cnt"))


def assign(rows: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Sequence[tuple[str, int]] = WEIGHTS) -> DataFrame:
    """``rows`` with split: rank within the stratum by ``order``, then contiguous stretches of the allocated sizes. W01, W03, W05.

    The first of ``order`` is a lower-case hexadecimal digest. Strata are ranked in chunks of it, and sizes come from one
    aggregate, so no stratum is in one task.
    """
    strata = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys).orderBy("ord")
    sizes = allocate(strata, keys, weights=weights).withColumn("hi", F.sum("cnt").over(upto))
    bounds = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "hi", "split"))).alias("bounds"))  # one entry per split
    digits = F.conv(F.substring(order[0], 1, 12), 16, 10).cast("double")
    ranked = numbered(rows, keys, order, digits, "rk").withColumn("rk", F.col("rk") + 1)
    first = F.filter("bounds", lambda b: b.hi >= F.col("rk"))[0]["split"]
    return ranked.join(bounds, list(keys)).withColumn("split", first).drop("rk", "bounds")


def partition_check(assigned: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    """One row: rows assigned twice, assigned but unknown, known but unassigned, and whether all is well. X01, X02."""
    a = assigned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    u = universe.select(key).distinct().withColumn("_u", F.lit(1))
    both = a.join(u, key, "full_outer")
    out = both.agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("_u").isNull()).alias("unknown"), F.count_if(F.col("n").isNull()).alias("unassigned"))
    return out.withColumn("passed", F.expr("twice = 0 and unknown = 0 and unassigned = 0"))


def strictly_ordered(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by..., ordered): every value above all before it, ``order`` being a number. W09."""
    seen = before(rows, by, [order], F.col(order), {"_p": ("max", F.col(value))})
    return seen.groupBy(*by).agg(F.coalesce(F.bool_and(F.col(value) > F.col("_p")), F.lit(True)).alias("ordered"))


def hash_half(rows: DataFrame, by: Sequence[str], key: str, seed: int) -> DataFrame:
    """Half of each group's rows, without replacement, by the order of a keyed digest. T07."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    digits = F.conv(F.substring("_d", 1, 12), 16, 10).cast("double")
    ranked = numbered(rows.withColumn("_d", digest), by, ["_d", key], digits, "_k")
    sizes = rows.groupBy(F.struct(*by).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, F.struct(*by) == F.col("_g")).where("_k < _n div 2").select(*rows.columns)
