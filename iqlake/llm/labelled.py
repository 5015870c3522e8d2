"""Labelled rows for the classifiers: which rows may be learnt from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Labelled documents that a classifier is fitted on, at most.
SAMPLE = 20_000
#: One fold of this many is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True for rows of fold 0, whose labels are never learnt from; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, limit: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents outside fold 0, the same ones in every run.

    The ids are few by ``limit``, so they are broadcast to the scan of the documents. Ids that are labelled several times
    have their largest label, documents that share an id are known by their smallest text. The sample is written to the shared
    folder, so the documents are read once for it.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return stored(rows, "labelled")
