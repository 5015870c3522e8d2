"""Rows that no other row dominates. Id J13 of the survey."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch

#: Strong points at most that every task knows beforehand; points that are compared with as many others at once.
STRONG, BLOCK = 512, 4096


def dominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points another one is better than: at most as large everywhere, smaller somewhere. Rows are points."""
    out = np.zeros(len(points), bool)
    for k in range(0, len(by), 256):
        rest = np.flatnonzero(~out)
        if not len(rest):
            break
        few = by[k : k + 256]
        le = np.ones((len(rest), len(few)), bool)
        lt = np.zeros((len(rest), len(few)), bool)
        for d in range(points.shape[1]):
            a, b = few[:, d][None], points[rest, d][:, None]
            le &= a <= b
            lt |= a < b
        out[rest[(le & lt).any(1)]] = True
    return out


def local_front(points: np.ndarray) -> np.ndarray:
    """The points of a set that none of it dominates; a point can only be dominated by one with a smaller sum, so these come first."""
    points = points[np.argsort(points.sum(1), kind="stable")]
    front = points[:0]
    for k in range(0, len(points), 1024):
        part = points[k : k + 1024]
        part = part[~dominated(part, front)]
        front = np.vstack([front, part[~dominated(part, part)]])
    return front


def front(rows: DataFrame, least: Sequence[str], most: Sequence[str] = ()) -> DataFrame:
    """The rows that no other row dominates: as small in all of ``least`` and as large in all of ``most``, and better in one.

    Different points are compared, once each. A few strong points, which are sent to all tasks, drop nearly all others where they
    are; each task keeps the front of its own rest. What is left is compared block with block, so no task has to hold a front of any
    size. Rows on the front that are equal in all measures all stay; rows with a null or NaN measure are left out.
    """
    named = [*least, *most]
    sign = [F.col(c).cast("double") for c in least] + [-F.col(c).cast("double") for c in most]
    ids = [f"_m{k}" for k in range(len(named))]
    marked = rows.select("*", *(s.alias(i) for s, i in zip(sign, ids, strict=True)))
    whole = marked
    for i in ids:
        whole = whole.where(F.col(i).isNotNull() & ~F.isnan(i))
    points = whole.select(*ids).distinct()
    limits = points.agg(*(F.min(i).alias(f"lo{i}") for i in ids), *(F.max(i).alias(f"hi{i}") for i in ids)).first()
    wide = [max(limits[f"hi{i}"] - limits[f"lo{i}"], 1e-300) if limits[f"lo{i}"] is not None else 1.0 for i in ids]
    near = sum(((F.col(i) - F.lit(limits[f"lo{i}"] or 0.0)) / F.lit(w) for i, w in zip(ids, wide, strict=True)), F.lit(0.0))
    best = points.orderBy(near, *ids).limit(STRONG).collect()
    strong = np.array([tuple(r) for r in best], float).reshape(len(best), len(ids))
    schema = ", ".join(f"{i} double" for i in ids)

    def batch_of(points: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(points[:, d]) for d in range(points.shape[1])], names=ids)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(ids)))
        for batch in batches:
            x = np.column_stack([batch.column(d).to_numpy(zero_copy_only=False) for d in range(len(ids))])
            held = local_front(np.vstack([held, x[~dominated(x, strong)]]))
            if len(held) > BLOCK:  # a front of any size goes on piece by piece
                yield batch_of(held)
                held = held[:0]
        if len(held):
            yield batch_of(held)

    path = scratch(rows.sparkSession, "front")
    points.mapInArrow(keep, schema).write.parquet(path)
    left = rows.sparkSession.read.schema(schema).parquet(path)
    n = max(1, math.ceil(left.count() / BLOCK))

    def compare(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(i).to_numpy() for i in ids])
        tested = table.column("_tested").to_numpy()
        x, others = x[tested], x[~tested]
        x = x[~dominated(x, others)]
        return pa.table({i: x[:, d] for d, i in enumerate(ids)})

    dealt = left.withColumn("_b", F.pmod(F.xxhash64(*ids), F.lit(n)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tested = dealt.select(*ids, F.lit(True).alias("_tested"), F.col("_b").alias("_x"), every.alias("_y"))
    others = dealt.select(*ids, F.lit(False).alias("_tested"), every.alias("_x"), F.col("_b").alias("_y"))
    survived = tested.unionByName(others).groupBy("_x", "_y").applyInArrow(compare, schema)
    survived = survived.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).drop("_n")
    return whole.join(survived, ids, "left_semi").drop(*ids)
