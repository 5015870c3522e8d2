"""W07's patience over a stream of epochs, Z01 and Z05: Spark keeps the state of each run from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import Patience

#: Fixed value: keyed state needs this store, which spills to disk and writes changes only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "best double, best_at int, stale int, stopped_at int, seen int"


class _Runs(StatefulProcessor):
    """Folds each run's new epochs, by time within a batch, into what is known of the run."""

    def __init__(self, by: Sequence[str], places: int, gain: float, most: int):
        self.by, self.places, self.gain, self.most = list(by), [f"place_{i}" for i in range(places)], gain, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("run", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        run = Patience(*self.held.get()) if self.held.exists() else Patience()
        new = pd.concat(list(rows)).sort_values(self.places)
        run.fold(new["epoch_score"].to_numpy(float), self.gain, self.most)
        self.held.update(astuple(run))
        yield pd.DataFrame([(*key, *astuple(run))], columns=[*self.by, "best", "best_at", "stale", "stopped_at", "seen"])

    def close(self) -> None:
        pass


def patience_stream(events: DataFrame, by: Sequence[str], order: Sequence[str], score: str, gain: float, most: int) -> DataFrame:
    """(by..., best, best_at, stale, stopped_at, seen) of each run that a batch has epochs of, for update mode.

    The same fold as ``operators.progress.patience``, whose result it has once all events have come. State is one row per run.
    ``by`` has no columns named epoch_score or place_0... Batches have to come in the order of time; within a batch any order will do. The session's state store must be STORE.
    """
    rows = events.select(*by, F.col(score).cast("double").alias("epoch_score"), *(F.col(c).alias(f"place_{i}") for i, c in enumerate(order)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[: len(by)])
    return rows.groupBy(*by).transformWithStateInPandas(_Runs(by, len(order), gain, most), f"{kinds}, {_STATE}", "Update", "None")


def follow(events: DataFrame, folder: str, by: Sequence[str], order: Sequence[str], score: str, gain: float, most: int) -> DataFrame:
    """Fold what is there now and return the last state of every run, (by..., best, best_at, stale, stopped_at, seen).

    Each batch writes the runs that it changed to a folder of its own, replaced if the batch is done again; ``folder`` also holds
    the stream's state, so another call goes on where this one, or one that died, ended.
    """
    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = patience_stream(events, by, order, score, gain, most)
        put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/runs/batch={batch}")
        stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    names = [f.name for f in stream.schema]
    rows = spark.read.schema(stream.schema).option("basePath", f"{folder}/runs").parquet(f"{folder}/runs")
    last = rows.groupBy(*by).agg(F.max_by(F.struct(*names), "seen").alias("r"))
    return last.select(*(F.col(f"r.{n}").alias(n) for n in names))
