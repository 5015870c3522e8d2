"""Helpers that several corpus operators share: storage, batching, word hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import scratch

U64 = np.uint64
#: Text bytes that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Fixed parameters of the hashes: generator seed, and odd multipliers for positions in a word and in a sequence.
_SEED, WORD_BASE, SEQ_BASE = 20240607, U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet; ``drop_since`` knows of it."""
    path = scratch(spark, name)
    _MADE.append(path)
    return path


_MADE: list[str] = []


def made() -> int:
    """How many paths this process has made so far, for ``drop_since``."""
    return len(_MADE)


def drop_since(spark: SparkSession, mark: int) -> None:
    """Delete what operators wrote to the shared folder since ``mark``, which their results read from: once these have been
    written elsewhere, or aren't wanted any more, nothing else needs it."""
    for path in _MADE[mark:]:
        drop_path(spark, path)
    del _MADE[mark:]


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    ``folder``: a path from ``new_path``, which an operator drops as a whole once nothing reads its tables any more.
    """
    path = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, folder: str) -> str:
    """Name of a table with the rows of ``df`` in ``parts`` buckets by ``key``, kept below ``folder``: joins on ``key`` don't shuffle it.

    ``df`` should be partitioned that way already, so that each task writes one file. The caller drops the table.
    """
    name = f"iqlake_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", f"{folder}/{name}").bucketBy(parts, key).saveAsTable(name)
    return name


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores added until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    codes = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    codes[space] = 0
    return codes, space


CODES, SPACE = _tables()
#: The same codes with A-Z taken for a-z.
LOWER_CODES = CODES.copy()
LOWER_CODES[65:91] = CODES[97:123]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_WORD_POWERS = powers(WORD_BASE, 4096)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block of texts.

    starts, ends: byte ranges in ``data``; bounds[i]:bounds[i+1] are the words of text i.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(raw, np.uint8, hi - lo, lo) if raw is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets = offsets - lo
        solid = ~SPACE[self.data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(solid))]
        first[edges] |= solid[edges]
        last[edges - 1] |= solid[edges - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.starts):
            return np.zeros(0, U64)
        lengths = self.ends - self.starts
        place = np.arange(len(self.data)) - np.repeat(np.r_[0, self.starts], np.diff(np.r_[0, self.starts, len(self.data)]))
        np.maximum(place, 0, out=place)
        if lengths.max() < len(_WORD_POWERS):
            np.minimum(place, len(_WORD_POWERS) - 1, out=place)
            pows = _WORD_POWERS
        else:
            pows = powers(WORD_BASE, int(place.max()) + 1)
        value = (LOWER_CODES if lower else CODES)[self.data]
        value *= pows[place]
        return mix(np.add.reduceat(value, self.starts) + lengths.astype(U64))


def _seq_power(n: int) -> np.uint64:
    return U64(pow(int(SEQ_BASE), n, 1 << 64))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive words from each place (len(h)-k+1 of them), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, part, size = None, 0, h, 1
    left = k
    while left:
        if left & 1:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out + piece * _seq_power(done)
            done += size
        left >>= 1
        if left:
            part = part[:-size] + part[size:] * _seq_power(size)
            size *= 2
    return mix(out)


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes.astype(np.int64)) // most
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Arrays as a record batch; unsigned 64-bit values are reinterpreted as signed ones."""
    cols = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == U64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with component the smallest node reachable over ``edges``; nodes without edges are absent.

    Large-star/small-star contraction, whose number of rounds is logarithmic. Neighbour lists are never gathered: each
    round is two minima by node (combined before the shuffle) and two joins. A count and a sum of hashes tell when a round
    changed nothing.
    """
    spark = edges.sparkSession

    def keep(e: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = new_path(spark, "cc")
        e.write.parquet(path)
        e = spark.read.schema("u long, v long").parquet(path)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return path, e, tuple(mark)

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    path, e, mark = keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        small = large.join(low, "u").select(F.explode(ends).alias("x")).select("x.*").where("u <> v").distinct()
        before, old = mark, path
        path, e, mark = keep(small)
        drop_path(spark, old)
        if mark == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


def spanning(label: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the given pairs of places, as many as connect what all of them connect, by rounds of hooking to a smaller label.

    Places of one label (numbers below their count) are connected from the start.
    """
    n, out = len(label), []
    for i, j in near:
        while True:
            a, b = label[i], label[j]
            cross = a != b
            if not cross.any():
                break
            i, j = i[cross], j[cross]
            high, low = np.maximum(a, b)[cross], np.minimum(a, b)[cross]
            order = np.lexsort((low, high))
            first = order[np.r_[True, np.diff(high[order]) != 0]]
            out += zip(i[first].tolist(), j[first].tolist(), strict=True)
            to = np.arange(n)
            to[high[first]] = low[first]
            while (nxt := to[to]).tolist() != to.tolist():
                to = nxt
            label = to[label]
    return out
