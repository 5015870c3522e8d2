"""Scans with the reference's access rules. Ids S12-S17, S21-S31, S33, S34, F02, F07 of the survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import numbered

OPEN_SPLITS = ("train", "validation")


def split_view(rows: DataFrame, split: str, authorised: bool = False) -> DataFrame:
    """The rows of one split; ``test`` needs an authorisation. S12, S15, S16, F02."""
    if split not in OPEN_SPLITS and not (authorised and split == "test"):
        raise PermissionError(f"split {split!r} can't be read")
    return rows.where(F.col("split") == split)


def pool(rows: DataFrame) -> DataFrame:
    """Train and validation rows together. S33, X04."""
    return split_view(rows, "train").unionByName(split_view(rows, "validation"))


def gather(rows: DataFrame, key: str, wanted: Sequence[int]) -> DataFrame:
    """The rows with the wanted keys and ``pos``, their place in the request; repeated requests repeat rows. S13, S14, S17, T06."""
    if any(isinstance(k, bool) for k in wanted):
        raise TypeError("keys must be integers")
    dim = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(wanted)], f"pos int, {key} long")
    return rows.join(F.broadcast(dim), key)


def mini_batches(rows: DataFrame, key: str, batch: int, seed: int) -> DataFrame:
    """``rows`` with batch and position: all rows in the order of a keyed digest, cut into batches; the last one may be short. The
    same rows give the same batches, however they are partitioned. S34."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = rows.withColumn("_d", digest).withColumn("_all", F.lit(1))
    digits = F.conv(F.substring("_d", 1, 12), 16, 10).cast("double")
    out = numbered(dealt, ["_all"], ["_d", key], digits, "_k")
    return out.select(*rows.columns, F.floor(F.col("_k") / batch).alias("batch"), (F.col("_k") % batch).cast("int").alias("position"))


def json_objects(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON files, one object each; what doesn't fit the schema raises. S21, S22."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def replays_of(spark: SparkSession, path: str, seeds: Sequence[int]) -> DataFrame:
    """Replays partitioned by model and seed; every model must have all seeds. S23-S25."""
    rows = spark.read.parquet(path).where(F.col("seed").isin(*seeds))
    lacking = rows.groupBy("model").agg(F.countDistinct("seed").alias("n")).where(F.col("n") != len(seeds)).take(1)
    if lacking:
        raise ValueError(f"model {lacking[0].model} has {lacking[0].n} of {len(seeds)} seeds")
    return rows


def framed_log(spark: SparkSession, path: str) -> DataFrame:
    """Records ended by 0x1E with six fields divided by 0x1F. S29."""
    parts = F.split("value", "\x1f")
    rows = spark.read.option("lineSep", "\x1e").text(path).where(F.length(F.trim("value")) > 0)
    names = ("commit", "author_name", "author_email", "committer_name", "committer_email", "authored_at")
    return rows.select(*(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)), (F.size(parts) == 6).alias("whole"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema. S30."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def matrix_csv(spark: SparkSession, path: str, labels: Sequence[str], value: str = "long") -> DataFrame:
    """A labelled square matrix as (target, pred, n). S31."""
    schema = ", ".join(["target string", *(f"`{x}` {value}" for x in labels)])
    return csv_rows(spark, path, schema).unpivot(["target"], list(labels), "pred", "n")


def text_tree(spark: SparkSession, path: str, glob: str = "*", most: int = 4 << 20) -> DataFrame:
    """(path, size, sha256, text) of a tree's files: content only of those up to ``most`` bytes. S26, S28, K11."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.when(F.col("length") <= most, F.try_validate_utf8(F.col("content").cast("string"))).alias("text"))
