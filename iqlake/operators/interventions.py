"""Gate interventions in table form. Ids U04, U05, W06, J12, A32-A36, A45, A53, P23-P25 of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .ordered import numbered


def mean_gate(gates: DataFrame) -> DataFrame:
    """(block, branch, mean, n): the average weight of each branch. A45."""
    cells = gates.select("block", F.posexplode("w").alias("branch", "x"))
    return cells.groupBy("block", "branch").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def replaced(gates: DataFrame, means: DataFrame) -> DataFrame:
    """``gates`` with every sample's weights replaced by the means of its block: a few rows, broadcast. U04."""
    dim = means.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("branch", "mean"))).alias("m"))
    return gates.join(F.broadcast(dim), "block").withColumn("w", F.transform("m", lambda x: x["mean"])).drop("m")


def positions(rows: DataFrame, group: str, order: str, batch: int) -> DataFrame:
    """``rows`` with batch and position: consecutive batches of ``batch`` rows within each group, the last one short. ``order``
    is a numeric column. W06."""
    return numbered(rows, [group], [order], F.col(order), "_k").withColumn("batch", F.floor(F.col("_k") / batch).cast("int")).withColumn("position", (F.col("_k") % batch).cast("int")).drop("_k")


def donors(placed: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """(group, batch, key, donor_key): each row's donor in its batch. The permutation of a batch is the order of a keyed digest,
    so donors are a self-join on (group, batch, place). U05, J12."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    order = Window.partitionBy(group, "batch").orderBy(digest, key)
    shuffled = placed.select(group, "batch", F.col(key).alias("donor_key"), (F.row_number().over(order) - 1).cast("int").alias("position"))
    return placed.select(group, "batch", "position", key).join(shuffled, [group, "batch", "position"]).select(group, "batch", key, "donor_key")


def mechanism(gates: DataFrame) -> DataFrame:
    """By block, by SNR, and overall: mean weight of the first branch, its population deviation, entropy, share collapsed. A34."""
    g = gates.select("block", "snr_db", F.col("w")[0].alias("first"), A.entropy(F.col("w")).alias("e"), A.collapsed(F.col("w"), 0.6).cast("int").alias("c"))
    return g.groupingSets([[], ["block"], ["snr_db"]], "block", "snr_db").agg(
        F.grouping_id("block", "snr_db").cast("int").alias("grain"), F.round(F.avg("first"), 9).alias("mean"), F.round(F.stddev_pop("first"), 9).alias("std"), F.round(F.avg("e"), 9).alias("entropy"), F.round(F.avg("c"), 9).alias("collapsed"), F.count(F.lit(1)).alias("n")
    )
