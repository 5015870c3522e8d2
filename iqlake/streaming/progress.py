"""Streaming forms of the run log. Ids Z01, Z03, Z04, Z08, U08 of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.progress import latest


def event_stream(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """The event files of an append-only folder as a stream; wall-clock times are taken as UTC."""
    schema = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def latest_epochs(events: DataFrame) -> DataFrame:
    """The latest epoch of each (model, seed_idx); the state is one row per run, however long the log. Z01."""
    return latest(events, ["model", "seed_idx"], "epoch", ["ts", "event_id"])


def epochs_in_windows(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and mean score per model and tumbling window, state dropped behind the watermark. An extension of Z01."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "model")
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")).select(F.col("window.start").alias("start"), "model", "n", "score")


def progress_events(runs: DataFrame) -> DataFrame:
    """(value): one JSON event per finished epoch of (model, seed_idx, epoch, score), the input of Z01. Z08."""
    return runs.select(F.to_json(F.struct(F.lit("epoch_complete").alias("event"), F.concat_ws("-", "model", F.col("seed_idx").cast("string")).alias("run"), "epoch", "score")).alias("value"))


def run_to_end(stream: DataFrame, folder: str, mode: str = "complete", seen: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process what is there now and return the result, which each batch writes anew below ``folder``. Z03's single refresh.

    ``seen`` is called with each batch's table, before it is replaced. Z04's observer.
    """
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch-{batch}")
        last.append(batch)
        if seen:
            seen(stream.sparkSession.read.parquet(f"{folder}/batch-{batch}"), batch)

    last: list[int] = []
    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.parquet(f"{folder}/batch-{last[-1]}")


def refresh(stream: DataFrame, show: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Call ``show`` with each refreshed table: the polling loop, and a per-batch observer. Z03, Z04, U08."""
    return stream.writeStream.outputMode("complete").foreachBatch(show).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
