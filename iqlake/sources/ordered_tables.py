"""Tables whose files are in an order that is recorded and can be checked. Id T04 of the survey."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import create_once, small_text

#: Rows of a file at most, but for ties.
ROWS = 1 << 22
RANGE = "_range"


def write_ordered(rows: DataFrame, path: str, order: Sequence[str], per: int = ROWS) -> None:
    """Write ``rows`` by ``order``: a folder for each range of it, ascending, with one sorted file; the order is recorded beside.

    Ranges are cut by a sample and sorted by all tasks at once. An existing path raises; the record comes last, so a table without
    it isn't whole.
    """
    n = max(1, math.ceil(rows.count() / per))
    dealt = rows.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(RANGE, *order)
    dealt.write.mode("errorifexists").partitionBy(RANGE).parquet(path)
    create_once(rows.sparkSession, f"{path}.order.json", json.dumps({"order": list(order), "columns": rows.columns}))


def read_ordered(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(rows with their range and place in it, the recorded order)."""
    text = small_text(spark, f"{path}.order.json")
    if text is None:
        raise FileNotFoundError(f"{path} has no recorded order")
    known = json.loads(text)
    rows = spark.read.parquet(path)
    return rows.select(*known["columns"], F.col(RANGE), F.col("_metadata.row_index").alias("_place")), known["order"]


def numbered_in_order(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """The rows with their number from 1 on: rows of earlier ranges, one number per range, and the place in the file."""
    rows, _ = read_ordered(spark, path)
    sizes = rows.groupBy(RANGE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = sizes.select(RANGE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), RANGE).withColumn(name, F.col("_before") + F.col("_place") + 1).drop(RANGE, "_place", "_before")


def out_of_order(spark: SparkSession, path: str) -> DataFrame:
    """(range, place) of rows that come before the row ahead of them, or, at a range's start, before the end of an earlier one.

    Each range is checked by itself, and ranges by their extremes; nulls come first, as they are sorted.
    """
    rows, order = read_ordered(spark, path)
    key = F.struct(*order)
    ahead = F.lag("_key").over(Window.partitionBy(RANGE).orderBy("_place"))
    inside = rows.select(RANGE, "_place", key.alias("_key")).withColumn("_ahead", ahead).where(F.col("_key") < F.col("_ahead"))
    ends = rows.groupBy(RANGE).agg(F.min(key).alias("_low"), F.max(key).alias("_high"))
    highest = F.max("_high").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    between = ends.withColumn("_before", highest).where(F.col("_low") < F.col("_before"))
    return inside.select(F.col(RANGE).alias("range"), F.col("_place").alias("place")).unionByName(between.select(F.col(RANGE).alias("range"), F.lit(0).cast("long").alias("place")))
