"""Duplicates, leakage and window similarity. Ids A18-A20, A48-A50, H01, H09, H10, J08, W10 of the survey."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def groups(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """(digest, n, first): digests that occur more than once, with their smallest key. W10, A18."""
    return rows.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).where("n > 1")


def summary(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """One row: duplicated digests, and occurrences beyond the first. A18."""
    return groups(rows, digest, key).agg(F.count(F.lit(1)).alias("distinct_hashes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("beyond_first"))


def leakage(rows: DataFrame, digest: str, split: str) -> DataFrame:
    """One row: groups of equal content across splits and within one, rows in them, passed. Only counts are gathered. A19, A20."""
    g = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("splits")).where("n > 1")
    out = g.agg(F.count_if(F.col("splits") > 1).alias("across"), F.count_if(F.col("splits") == 1).alias("within"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    return out.withColumn("passed", F.col("across") == 0)


def float_digest(*channels: str) -> F.Column:
    """SHA-256 of the channels' bytes, little-endian, one channel after the other, bit for bit: -0.0 and 0.0 differ. H01.

    Spark has no cast from floats to bytes, so this is a function over Arrow batches, which hashes slices of their buffers.
    """

    def rows_of(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all lists in a row, and where each list begins and ends in them."""
        kind = np.dtype("<f8" if a.type.value_type == pa.float64() else "<f4")
        flat = np.ascontiguousarray(a.flatten().to_numpy(zero_copy_only=False), kind)
        sizes = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return flat.view(np.uint8), kind.itemsize * np.r_[0, np.cumsum(sizes)]

    @F.arrow_udf("string")
    def digest(rows: pa.Array) -> pa.Array:
        parts, out = [rows_of(c) for c in rows.flatten()], []
        for k in range(len(rows)):
            h = hashlib.sha256()
            for raw, at in parts:
                h.update(raw[at[k] : at[k + 1]])
            out.append(h.hexdigest())
        return pa.array(out, pa.string())

    return digest(F.struct(*channels))


def pair_scores(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(left, right, score) of all pairs of a bounded sample of at most 64 windows, as the contract demands an unindexed
    comparison of such samples. J08, H09."""
    few = rows.limit(65)
    if few.count() > 64:
        raise ValueError("exhaustive pairs are for samples of at most 64 windows")
    b = F.broadcast(few.select(F.col(key).alias("right"), F.col("i").alias("bi"), F.col("q").alias("bq")))
    pairs = few.select(F.col(key).alias("left"), F.col("i").alias("ai"), F.col("q").alias("aq")).join(b, F.col("left") < F.col("right"))
    return pairs.select("left", "right", A.circular_correlation(F.col("ai"), F.col("aq"), F.col("bi"), F.col("bq"), n).alias("score"))


def correlate(pairs: DataFrame) -> DataFrame:
    """(left, right, score) by FFT, for pairs (left, right, ai, aq, bi, bq) of any number. H09's fast path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                a = np.stack(f.ai).astype(float) + 1j * np.stack(f.aq)
                b = np.stack(f.bi).astype(float) + 1j * np.stack(f.bq)
                peak = np.abs(np.fft.ifft(np.fft.fft(a, axis=1) * np.conj(np.fft.fft(b, axis=1)), axis=1)).max(1)
                yield pd.DataFrame({"left": f.left, "right": f.right, "score": np.minimum(peak / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)), 1.0)})

    return pairs.mapInPandas(run, "left long, right long, score double")


def score_summary(scores: DataFrame, score: str = "score") -> DataFrame:
    """Count, extremes, mean and a digest of the sorted scores' text at 9 decimals. A48.

    The digest covers one bounded report's scores; it is not for whole corpora.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.format_string("%.9f", score))), lambda x: x), ",")
    return scores.agg(F.count(F.lit(1)).alias("n"), F.round(F.min(score), 9).alias("lowest"), F.round(F.max(score), 9).alias("highest"), F.round(F.avg(score), 9).alias("mean"), F.sha2(text, 256).alias("digest"))


def calibrate(scores: DataFrame, recall: float = 1.0, most_false: float = 0.001) -> DataFrame:
    """One row: threshold = the least positive score, floored at 12 decimals; recall, false positive rate, gate. A49."""
    t = scores.where("positive").agg(A.floor12(F.min("score")).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    out = scores.crossJoin(F.broadcast(t)).groupBy("threshold").agg(F.avg(F.when(F.col("positive"), hit.cast("int"))).alias("recall"), F.avg(F.when(~F.col("positive"), hit.cast("int"))).alias("false_rate"))
    return out.withColumn("passed", (F.col("recall") >= recall) & (F.col("false_rate") <= most_false))


def pair_audit(found: DataFrame, expected: DataFrame, keys: Sequence[str] = ("left", "right")) -> DataFrame:
    """One row: found, expected, true, missed and false pairs, recall. A50."""
    both = found.select(*keys, F.lit(1).alias("_f")).join(expected.select(*keys, F.lit(1).alias("_e")), list(keys), "full_outer")
    hit = F.col("_f").isNotNull() & F.col("_e").isNotNull()
    out = both.agg(F.count("_f").alias("found"), F.count("_e").alias("expected"), F.count_if(hit).alias("true_pairs"), F.count_if(F.col("_f").isNull()).alias("missed"), F.count_if(F.col("_e").isNull()).alias("false_pairs"))
    return out.withColumn("recall", F.when(F.col("expected") > 0, F.round(F.col("true_pairs") / F.col("expected"), 9)))
