"""Adapters from the driver's tables to labelled windows, replays, gates, logits and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered

SEEDS = (13, 37, 73, 101, 137)
LOW_SNR = (-10, -8, -6, -4, -2, 0)
#: Model names with the first digest digit from which a replay is wrong.
MODELS = (("m1", "a"), ("m2", "8"), ("m3", "c"))
CLASSES = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snr_of(vec_id) -> F.Column:
    return (vec_id % 10 * 2 - 10).cast("int")


def iq_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, modulation, snr_db, source_index, i, q): an embedding's halves as the two channels."""
    e = table(spark, sf_dir, "embeddings").withColumn("snr_db", snr_of(F.col("vec_id")))
    e = numbered(e, ["label", "snr_db"], ["vec_id"], F.col("vec_id"), "source_index")
    return e.select(
        "vec_id", F.col("label").alias("modulation"), "snr_db", "source_index",
        F.slice("embedding", 1, 32).alias("i"), F.slice("embedding", 33, 32).alias("q"),
    )


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``iq_samples`` with its sample_id."""
    s = iq_samples(spark, sf_dir)
    return s.withColumn("sample_id", F.format_string("emb:%02d:%+03d:%04d", "modulation", "snr_db", "source_index"))


def model_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, thr string")


def seed_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SEEDS], "seed int")


def class_dim(spark: SparkSession) -> DataFrame:
    return spark.range(CLASSES).select(F.col("id").cast("int").alias("cls"))


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, seed, vec_id, target, snr_db, pred): predictions that a digest of the key decides."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("target"))
    grid = model_dim(spark).crossJoin(seed_dim(spark))  # models x seeds, a fixed few rows
    h = F.md5(F.concat_ws(":", "model", F.col("seed").cast("string"), F.col("vec_id").cast("string")))
    wrong = (F.ascii(F.substring("h", 2, 1)) + F.col("target")) % CLASSES
    rows = e.crossJoin(F.broadcast(grid)).withColumn("h", h)
    pred = F.when(F.substring("h", 1, 1) < F.col("thr"), F.col("target")).otherwise(wrong)
    return rows.select("model", "seed", "vec_id", "target", snr_of(F.col("vec_id")).alias("snr_db"), pred.alias("pred"))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays with ``ok``, 1 where the prediction is right."""
    return replays(spark, sf_dir).withColumn("ok", (F.col("pred") == F.col("target")).cast("int"))


def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, block, w): three positive weights per block that add up to 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("block"))
    raw = F.transform(F.slice("embedding", F.col("block") * 3 + 1, 3), lambda x: F.abs(x.cast("double")) + 0.001)
    e = e.withColumn("raw", raw)
    total = F.col("raw")[0] + F.col("raw")[1] + F.col("raw")[2]
    return e.select("vec_id", "block", F.transform("raw", lambda x: x / total).alias("w"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, target, snr_db, l): the first ten components as class scores."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("target"), snr_of(F.col("vec_id")).alias("snr_db"), F.transform(F.slice("embedding", 1, CLASSES), lambda x: x.cast("double")).alias("l"))


RUN_SCHEMA = "k int"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, model, seed_idx, epoch, score): the event log as training progress."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("seed_idx"), F.from_json("props", RUN_SCHEMA)["k"].alias("epoch"), F.col("value").alias("score"))
