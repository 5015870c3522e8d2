"""The corpus pipeline: five stages over ``documents``, each over all that its predecessor kept.

All stages but the last return the columns of their input, whatever these are; ``doc_id`` and ``text`` are what they look at.
Columns that an operator would add may be there already: the stages hide them from the operators. Null and empty texts, rows
without doc_id and rows that share one are documents like others; each stage says what becomes of them. An empty table gives
an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.llm import decontamination, jaccard, packing, substrings, toxicity
from iqlake.llm.common import drop_path, drop_since, made, new_path, stored
from iqlake.llm.queries import read, tokenizer_file


def _hidden(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with its other columns under names that no operator uses, and the way back, with changes (old value -> new one)
    of some columns."""
    other = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}

    def back(rows: DataFrame, **changes: Callable[[Column], Column]) -> DataFrame:
        return rows.select(*(changes.get(c, lambda x: x)(F.col(other.get(c, c))).alias(c) for c in docs.columns))

    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in other.items())), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on the labelled rows of the corpus as it came in.

    Null and empty texts have the score of a text without words.
    """
    model = toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    rows, back = _hidden(docs)
    return back(toxicity.score(rows, model).where("predicted = 0"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that the n-gram similarity join connects, the one with the smallest doc_id stays.

    A document with a null doc_id, or without words, is linked with nothing and stays. Rows that share the smallest doc_id of
    a group all stay.
    """
    gone = jaccard.join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go. A text that loses none stays as it is, white space too; one that loses all goes.

    A column n_chars follows its text. Documents with a null doc_id keep all words.
    """
    rows, back = _hidden(docs)
    cut = substrings.dedup(rows).where("n_removed = 0 or n_removed < n_words")
    where_cut = lambda new: lambda old: F.when(F.col("n_removed") > 0, new).otherwise(old)
    counted = {"n_chars": where_cut(F.length("kept").cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {}
    return back(cut, text=where_cut(F.col("kept")), **counted)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go, with or without doc_id; of rows that share one, those with a find."""
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids. A null text is empty."""
    return packing.pack(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("jaccard", one_of_each_group), ("substrings", cut_repeats), ("decontamination", drop_leaks), ("packing", pack)]

#: No stage but the first few could be told in SQL; the tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written and read again as the next one's input. Once
    it is written, what its operator wrote on the way is dropped, and so is the stage before."""
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder, mark = new_path(spark, f"stage-{name}"), made()
        docs = stored(stage(spark, docs, sf_dir), name, folder)
        drop_since(spark, mark)
        if last:
            drop_path(spark, last)
        last = folder
    return docs
