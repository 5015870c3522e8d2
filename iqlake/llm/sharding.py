"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of the row hash that can be used as a directory prefix.
HASH_BITS = 60
#: Levels that the directory reaches beyond the depth at which an even load would fit.
SLACK_BITS = 6
#: Bytes of a shard: what a reader takes at once.
SHARD_BYTES = 1 << 20


def _fitting(sizes: DataFrame, by: str, bits: int, first: int, last: int, limit: int) -> DataFrame:
    """(by, depth, prefix, b, n): the bucket of fewest bits, ``first`` to ``last``, that holds the first ``bits`` bits in the
    column ``by`` and fits; without a row where none does. ``sizes`` (by, b, n) holds each value once."""
    levels = sizes.select(by, "b", "n", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright({by}, {bits} - depth)"))
    fits = stored(levels.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).where(F.col("b") <= limit), "fits")
    # no bucket above this depth fits: without those levels, few leaves share a bucket that is looked up
    least = fits.agg(F.min("depth")).first()[0]
    found = levels.drop("b", "n").where(F.col("depth") >= (first if least is None else least)).join(fits, ["depth", "prefix"])
    return found.groupBy(by).agg(F.min(F.struct("depth", "prefix", "b", "n")).alias("d")).select(by, "d.*")


def _assigned(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (key, bytes, hash and whatever else) with depth, prefix, part, shard_bytes, shard_rows."""
    if limit < 2:
        raise ValueError("limit must be at least 2 bytes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    first = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    rows = rows.withColumn("leaf", F.shiftright("hash", HASH_BITS - first))
    sums = F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")
    leaves = stored(rows.groupBy("leaf").agg(*sums, F.min("hash").alias("low"), F.max("hash").alias("high")), "leaves")
    names = {"b": "shard_bytes", "n": "shard_rows"}
    whole = rows.join(_fitting(leaves, "leaf", first, 0, first, limit), "leaf").withColumn("part", F.lit(0).cast("long")).withColumnsRenamed(names)
    out = ["depth", "prefix", "part", "shard_bytes", "shard_rows"]
    columns = [*(c for c in rows.columns if c not in ("hash", "leaf")), *out]
    whole, over = whole.select(columns), leaves.where(F.col("b") > limit).select("leaf", (F.col("low") < F.col("high")).alias("mixed"))
    if over.isEmpty():
        return whole
    # only the directory of overfull leaves grows, by all bits that are left
    over = rows.join(over, "leaf").drop("leaf")
    sizes = stored(over.where("mixed").groupBy("hash").agg(*sums), "hashes")
    deeper = _fitting(sizes, "hash", HASH_BITS, min(first + 1, HASH_BITS), HASH_BITS, limit)
    split = over.join(deeper, "hash").withColumn("part", F.lit(0).cast("long")).withColumnsRenamed(names).select(columns)
    # what all bits can't split has equal keys or is one row
    alone = over.join(deeper.select("hash"), "hash", "left_anti").drop("mixed").withColumn("depth", F.lit(HASH_BITS)).withColumnRenamed("hash", "prefix")
    return whole.unionByName(split).unionByName(_parts(alone, limit).select(columns))


def _parts(over: DataFrame, limit: int) -> DataFrame:
    """Rows of buckets that no bit can split, cut into parts of at most ``limit`` bytes by running totals.

    A bucket may hold any share of all rows, so totals run in two steps: over the chunks that the rows lie in once they are
    written, of which there are as many as tasks that wrote them, and within each chunk.
    """
    half = limit // 2
    over = stored(over.withColumn("chunk", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "over")
    small = F.when(F.col("bytes") <= half, F.col("bytes")).otherwise(0)
    large = F.when(F.col("bytes") > half, 1).otherwise(0)
    chunks = over.groupBy("prefix", "chunk").agg(F.sum(small).alias("s"), F.sum(large).alias("l"))
    earlier = Window.partitionBy("prefix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("prefix", "chunk", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s"), F.coalesce(F.sum("l").over(earlier), F.lit(0)).alias("l"))
    within = Window.partitionBy("prefix", "chunk").orderBy("place")
    before = F.col("s") + F.coalesce(F.sum(small).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = F.col("l") + F.sum(large).over(within.rowsBetween(Window.unboundedPreceding, 0))
    cut = F.when(F.col("bytes") > half, -alone).otherwise(F.floor(before / half)).cast("long")
    over = over.join(chunks, ["prefix", "chunk"]).withColumn("part", cut).drop("s", "l", "chunk", "place")
    parts = over.groupBy("prefix", "part").agg(F.sum("bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return over.join(parts, ["prefix", "part"])


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row a shard of at most ``limit`` bytes of text.

    The directory is indexed by the first ``depth`` bits of a hash of the key. A bucket over its limit is split on the next
    bit, and only such buckets are. Sizes of all depths come from one aggregate of the level at which an even load would have
    2^SLACK_BITS leaves a shard, and another over the keys of the leaves that are overfull there, so nothing is read once per
    split.

    Returns (key, bytes, depth, prefix, part, shard_bytes, shard_rows). ``part`` is 0 but in buckets over the limit that none of
    the HASH_BITS bits can split, i.e. of one key: there, rows are cut into parts by a running total, which keeps a part within
    the limit unless one row is larger than it; a row over half the limit has a part of its own.
    Null text counts 0 bytes; a null key is hashed as the empty string. An empty table gives no rows. Other columns are not
    looked at.
    """
    rows = docs.select(F.col(key).alias("key"), _size(text).alias("bytes"), _hash(key).alias("hash"))
    return _assigned(rows, limit).select(F.col("key").alias(key), "bytes", "depth", "prefix", "part", "shard_bytes", "shard_rows")


def _size(text: str):
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def _hash(key: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all rows of ``docs`` with one folder per shard, named in the column ``shard``; returns (shard, bytes, rows).

    Rows with null or repeated keys are written like others. An input column named ``shard`` is replaced.
    """
    docs = docs.drop("shard")
    rows = docs.select(F.struct("*").alias("row"), _size(text).alias("bytes"), _hash(key).alias("hash"))
    name = F.format_string("%02d-%x-%d", "depth", "prefix", "part").alias("shard")
    _assigned(rows, limit).select("row.*", name).repartition("shard").write.partitionBy("shard").parquet(path)
    written = docs.sparkSession.read.schema(f"`{text}` string, shard string").parquet(path)
    return written.groupBy("shard").agg(F.sum(_size(text)).alias("bytes"), F.count(F.lit(1)).alias("rows"))
