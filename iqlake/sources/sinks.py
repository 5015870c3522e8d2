"""Sinks that refuse to overwrite. Ids K01-K10, K12, K15, Z05, Z07 of the survey."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import cache
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_folder() -> str:
    """A temporary folder of this process."""
    return f"file://{tempfile.mkdtemp(prefix='iqlake-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder; on a cluster that would be each machine's own, so it raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if (spark.conf.get("spark.master", None) or "").split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own_folder()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def publish(rows: DataFrame, path: str, kind: str = "parquet", replace: bool = False, **options: str) -> None:
    """Write once: an existing target is an error unless ``replace``. Spark's commit makes the files visible together. K02, K04, K05, K15."""
    rows.write.mode("overwrite" if replace else "errorifexists").options(**options).format(kind).save(path)


def publish_cells(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Canonical table: one folder per cell, sorted within; a cell's rows meet in one task, cells are many. K01, K08."""
    rows.repartition(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").partitionBy(*keys).parquet(path)


def publish_predictions(rows: DataFrame, path: str) -> None:
    """Replays with narrow types, partitioned for scans by model and seed. K07."""
    narrow = rows.withColumn("target", F.col("target").cast("tinyint")).withColumn("pred", F.col("pred").cast("tinyint")).withColumn("snr_db", F.col("snr_db").cast("tinyint"))
    narrow.write.mode("errorifexists").partitionBy("model", "seed").parquet(path)


def publish_evidence(rows: DataFrame, path: str) -> DataFrame:
    """JSON lines, and the digests of the files written. K09."""
    from .files import listing

    rows.write.mode("errorifexists").json(path)
    return listing(rows.sparkSession, path, "*.json")


def _file(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) by Spark's own layer, so that any store it reaches will do."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_once(spark: SparkSession, path: str, text: str = "") -> None:
    """Create a small file that must not be there yet; a second attempt raises FileExistsError. Z07's marker."""
    fs, p = _file(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        if fs.exists(p):
            raise FileExistsError(path) from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def small_text(spark: SparkSession, path: str, most: int = 64 << 10) -> str | None:
    """The text of a small file, null where there is none; over ``most`` bytes it raises before reading."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    if (size := fs.getFileStatus(p).getLen()) > most:
        raise ValueError(f"{path} has {size} bytes, at most {most} are read")
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content).decode()


@contextmanager
def writer_lock(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds ``path``.lock while the block runs; raises FileExistsError where another writer holds it. K03."""
    create_once(spark, f"{path}.lock")
    try:
        yield
    finally:
        fs, p = _file(spark, f"{path}.lock")
        fs.delete(p, False)


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside ``path`` to write several tables to. It becomes ``path`` when the block ends well and is dropped when it
    doesn't, so readers see all of a report or nothing; an existing ``path`` raises. K10."""
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    fs, target = _file(spark, path)
    _, source = _file(spark, stage)
    with writer_lock(spark, path):
        try:
            if fs.exists(target):
                raise FileExistsError(path)
            fs.mkdirs(source)
            yield stage
            if not fs.rename(source, target):
                raise OSError(f"{stage} can't become {path}")
        finally:
            fs.delete(source, True)


def bound_folder(spark: SparkSession, path: str, bindings: Mapping[str, Any]) -> bool:
    """Whether ``path`` holds work to resume, i.e. was bound to the same ``bindings`` before; else binds it to them now.

    Work that was begun under other bindings (data, code, settings) raises, so that nothing is mixed. Z05.
    """
    text = json.dumps(bindings, sort_keys=True, separators=(",", ":"))
    known = small_text(spark, f"{path}/bindings.json")
    if known is None:
        create_once(spark, f"{path}/bindings.json", text)
        return False
    if known != text:
        raise ValueError(f"{path} was begun with {known}, not with {text}")
    return True


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report's table as Markdown; over ``most`` rows it raises, as it is made on the driver. K12."""
    few = rows.limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"a report has at most {most} rows")
    shown = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *few]
    return "".join(f"| {' | '.join(map(shown, line))} |\n" for line in lines)
