"""Importance resampling towards a target text distribution, by a position table of n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Buckets that features are hashed to, and the most words of a feature.
BUCKETS, ORDERS = 10_000, 3
#: Least words of a document that can be drawn, share of these that is drawn in percent, seed of the draw.
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: What parts words (every ASCII character that is neither a digit nor a letter), and the letters' two cases.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def positions(docs: DataFrame) -> DataFrame:
    """(row, doc_id, pos, word): the table of all words and their places, whole texts.

    A row's text is shuffled once, by the row's number in the table, so that a window along the row doesn't shuffle its words. Each
    row has an empty word before its first one, and may have one after its last, so rows without words stay in the table.
    """
    text = F.concat(F.lit(" "), F.coalesce("text", F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = rows.repartition("row").select("row", "doc_id", F.posexplode(F.split("text", APART, -1)).alias("pos", "word"))
    plain = F.octet_length("word") == F.char_length("word")  # letters beyond ASCII keep their case
    return words.withColumn("word", F.when(plain, F.lower("word")).otherwise(F.translate("word", UPPER, LOWER)))


def features(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(row, doc_id, b1, b2...): for each place, the buckets of the runs of 1 to ``orders`` words from there, null where a text
    ends before.

    The words that follow are read off the position table by ``lead`` and put together order by order.
    """
    order = Window.partitionBy("row").orderBy("pos")
    table = positions(docs).select("*", *(F.lead("word", k).over(order).alias(f"w{k}") for k in range(1, orders)))
    runs, whole, run = [], F.lit(True), None
    for k in range(orders):
        word = F.col(f"w{k}") if k else F.col("word")
        whole = whole & (word != "")
        run = word if run is None else F.concat(run, F.lit(" "), word)
        runs.append(F.when(whole, bucket(run)).alias(f"b{k + 1}"))
    return table.select("row", "doc_id", *runs)


def _buckets(found: DataFrame) -> list[str]:
    return [c for c in found.columns if c not in ("row", "doc_id")]


def bucket(feature: Column) -> Column:
    """The bucket of a feature: its bytes' CRC-32 modulo BUCKETS."""
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def counts(found: DataFrame) -> DataFrame:
    """(bucket, n), at most BUCKETS rows, which each task sums up before the shuffle."""
    return found.select(F.explode(F.array(*_buckets(found))).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """(bucket, gain) of the buckets in ``raw``: thousandths of the log ratio of smoothed shares, rounded down."""
    total = lambda c, name: F.broadcast(c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)))
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.crossJoin(total(raw, "all_s")).crossJoin(total(target, "all_t"))  # one row each
    smooth = F.lit(float(BUCKETS))
    ratio = (F.coalesce("t", F.lit(0)) + F.lit(1.0)) * (F.col("all_s") + smooth) / ((F.col("s") + F.lit(1.0)) * (F.col("all_t") + smooth))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a digest of seed and doc_id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))


def score(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_features, weight, score) of every row of ``docs``; ``target`` has the texts to resemble.

    The buckets are kept in the shared folder, as counts and weights both need them. The gains, which are sent to all tasks, are
    at most BUCKETS rows.
    """
    found = stored(features(docs), "features")
    raw = stored(counts(found), "counts")
    aim = stored(counts(features(target.select(F.lit(None).alias("doc_id"), "text"))), "counts")
    gain, places = gains(raw, aim), _buckets(found)
    for b in places:
        found = found.join(F.broadcast(gain.select(F.col("bucket").alias(b), F.col("gain").alias(f"g_{b}"))), b, "left")
    n = sum(F.when(F.col(b).isNotNull(), 1).otherwise(0) for b in places)
    weight = sum(F.coalesce(f"g_{b}", F.lit(0)) for b in places)
    out = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(n).alias("n_features"), F.sum(weight).alias("weight"))
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, 1 for the first by ``order``, which should tell all rows apart.

    Rows are cut into ranges of the order, kept in the shared folder with the range they are in; a rank is the number of rows
    in earlier ranges, one number per range, and the place in the own one.
    """
    cut = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in cut.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for k, n in sizes:
        starts.append((k, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "_range int, _before long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = cut.withColumn("_own", within).join(F.broadcast(starts), "_range")
    return placed.withColumn("rank", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Weigh every document by how much its n-grams resemble ``target``, and draw a share of them without replacement.

    Features are all runs of 1 to 3 words; each is hashed, the buckets' counts in ``docs`` and ``target`` give gains, and a
    document's weight is the sum of its features' gains. Gumbel noise added to the weights makes the highest scores a draw.

    Returns (doc_id, n_features, weight, score, rank): rank is 1, 2, 3... of the floor(percent * N / 100) highest scores among
    the N documents with at least ``least_words`` words, ties to the smaller doc_id, and null for all others. Null and empty texts
    have no features, weight 0 and are never drawn. Rows that share a doc_id are documents of their own with the same noise;
    ties between them go to the one with more features. A null doc_id comes after others in ties. An empty ``target`` or an
    empty table is no error. Other columns are not looked at. A row's words are in one task's memory, as the row itself is.
    """
    scored = stored(score(docs, target, seed), "scores")
    able = F.col("n_features") >= sum(max(0, least_words - k) for k in range(ORDERS))  # what so many words have
    drawn = percent * scored.where(able).count() // 100
    order = F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"), F.desc("weight"), F.asc("row")
    first = ranked(scored.where(able), *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
