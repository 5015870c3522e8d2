"""Digests of ordered rows of any number, range by range: a digest's state goes from one to the next. Ids H04-H06 of the survey."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sha256 import Sha256
from ..sources.sinks import scratch

#: Rows of a range at most, but for ties, which one task digests.
ROWS = 1 << 22


def raw_bytes(column: pa.Array) -> bytes:
    """The little-endian bytes of all values in a row: whole numbers as 64 bits, floats as they are, lists one after the other."""
    kind = column.type
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return raw_bytes(column.flatten())
    if pa.types.is_integer(kind):
        return column.to_numpy(zero_copy_only=False).astype("<i8").tobytes()
    if pa.types.is_floating(kind):
        return column.to_numpy(zero_copy_only=False).astype("<f4" if kind == pa.float32() else "<f8").tobytes()
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        column = column.cast(pa.large_binary())
    return b"".join(x for x in column.to_pylist() if x is not None)


def ranged_by(rows: DataFrame, order: Sequence[str], per: int = ROWS, least: int = 1) -> DataFrame:
    """``rows`` with _range, ascending with ``order``, kept with a folder for each of ``least`` or more ranges of about ``per`` rows
    at most: sampled cuts, one shuffle."""
    n = max(least, math.ceil(rows.count() / per))
    path = scratch(rows.sparkSession, "ranges")
    rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    if rows.isEmpty():
        return rows.limit(0).withColumn("_range", F.lit(0))
    return rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)


def _chained(ranged: DataFrame, order: Sequence[str], raw: str, digest: Sha256, per: int) -> Sha256:
    """``digest`` after all rows, range by range: tasks of about ``per`` rows, one after the other, as SHA-256 demands.

    Only its state, some hundred bytes, comes back to the driver and goes out again. Ranges that are small follow each other in one
    task.
    """
    sizes = sorted((r["_range"], r.n) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    steps: list[list[int]] = []  # first range, last range, rows
    for k, n in sizes:
        if steps and steps[-1][2] + n <= per:
            steps[-1][1:] = [k, steps[-1][2] + n]
        else:
            steps.append([k, k, n])
    for first, last, _ in steps:
        state = digest.state()

        def fold(batches: Iterator[pa.RecordBatch], state: bytes = state) -> Iterator[pa.RecordBatch]:
            own = Sha256(state)
            for batch in batches:
                own.update(raw_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([own.state()], pa.binary())], names=["state"])

        rows = ranged.where(F.col("_range").between(first, last)).coalesce(1).sortWithinPartitions(*order).select(raw)
        found = rows.mapInArrow(fold, "state binary").first()
        digest = Sha256(bytes(found.state)) if found else digest
    return digest


def ordered_digest(rows: DataFrame, order: Sequence[str], raw: str, digest: Sha256 | None = None, per: int = ROWS) -> Sha256:
    """``digest``, or a new one, after the bytes of column ``raw`` of all rows by ``order``. No task has more than about ``per`` rows."""
    ranged = ranged_by(rows.select(*dict.fromkeys([*order, raw])), order, per)
    return _chained(ranged, order, raw, digest or Sha256(), per)


def group_digests(rows: DataFrame, by: Sequence[str], order: Sequence[str], raw: str, per: int = ROWS) -> DataFrame:
    """(by..., n, digest): SHA-256 over the bytes of ``raw`` of each group's rows by ``order``.

    Groups of up to ``per`` rows stream through the tasks that they are dealt to, all at once; a larger one, of which there can't be
    many, is cut into ranges and digested range after range with its state carried on.
    """
    rows = rows.select(*by, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(raw).alias("_raw"))
    places, kinds = [f"_o{i}" for i in range(len(order))], rows.schema[: len(by)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "n long", "digest string"])
    out = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in kinds), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, digest = None, 0, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, n, digest.hexdigest()), out, strict=True)], schema=out)

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    if key is not None:
                        yield row()
                    key, n, digest = keys[a], 0, hashlib.sha256()
                n += b - a
                digest.update(raw_bytes(batch.column(len(by)).slice(a, b - a)))
        if key is not None:
            yield row()

    wide = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per).collect()
    narrow = rows
    if wide:
        few = rows.sparkSession.createDataFrame([tuple(g[c] for c in by) for g in wide], T.StructType(list(kinds))).toDF(*(f"_k{i}" for i in range(len(by))))
        narrow = rows.join(F.broadcast(few), [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], "left_anti")
    found = narrow.repartition(*by).sortWithinPartitions(*by, *places).select(*by, "_raw").mapInArrow(run, schema)
    rest = [(*(g[c] for c in by), g.n, ordered_digest(rows.where(_same(g, by)).select(*places, "_raw"), places, "_raw", None, per).hexdigest()) for g in wide]
    return found.unionByName(rows.sparkSession.createDataFrame(rest, schema)) if rest else found


def _same(group: Row, by: Sequence[str]):
    out = F.lit(True)
    for c in by:
        out = out & F.col(c).eqNullSafe(F.lit(group[c]))
    return out


#: The splits of an assignment in the order in which its digest covers them.
SPLITS = ("train", "validation", "test")


def framed(*parts: bytes) -> bytes:
    """Each part after its length as 8 big-endian bytes."""
    return b"".join(len(p).to_bytes(8, "big") + p for p in parts)


def assignment_digest(assigned: DataFrame, key: str, split: str = "split", splits: Sequence[str] = SPLITS, per: int = ROWS) -> DataFrame:
    """One row (n, digest): SHA-256 over all splits in order: the framed name, the number of keys as 8 big-endian bytes, then the
    sorted keys as 64-bit little-endian numbers. H06.

    Keys are whole numbers; a null one raises, as it has no bytes. Rows of other splits aren't covered. Repeated keys count.
    """
    spark: SparkSession = assigned.sparkSession
    rows = assigned.select(F.col(split).alias("split"), F.col(key).cast("long").alias("key"))
    held = {r.split: r for r in rows.where(F.col("split").isin(*splits)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("key").alias("keys")).collect()}
    if any(r.n != r["keys"] for r in held.values()):
        raise ValueError("an assignment's keys must not be null")
    digest, n = Sha256(), 0
    for name in splits:
        count = held[name].n if name in held else 0
        digest.update(framed(name.encode()) + count.to_bytes(8, "big"))
        if count:
            digest = ordered_digest(rows.where(F.col("split") == name).select("key"), ["key"], "key", digest, per)
        n += count
    return spark.createDataFrame([(n, digest.hexdigest())], "n long, digest string")
