"""Registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, chat, decontamination, embeddings, importance, jaccard, packing, quality, secrets, sharding, sql, substrings, toxicity, whitening
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 ids."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file()).drop("ids")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, half of each version, converted to WARC and read back."""
    pages = read(spark, sf_dir, "pages")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    odd = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)) == 1
    archive.write_arc(pages.where(odd), f"{arc}/v1", version=1)
    archive.write_arc(pages.where(~odd), f"{arc}/v2", version=2)
    archive.convert(archive.read_arc(spark, arc), warc)
    return archive.read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every find of a benchmark item in a document."""
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard(read(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue from the point of view of each of its speakers."""
    return chat.rotate(read(spark, sf_dir, "conversations"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated windows leaves of every document."""
    cut = substrings.dedup(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under the n-gram similarity join."""
    return jaccard.join(read(spark, sf_dir, "documents"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document in a draw that resembles the benchmark texts."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the first 16 whitened components; deviation is null where it is beyond 64 bits."""
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.report(read(spark, sf_dir, "documents"), tokenizer_file())


OPERATORS = (
    op1_toxicity, op2_packing, op3_quality, op4_warc, op5_decontamination, op6_sharding, op7_embeddings,
    op8_chat, op9_substrings, op10_jaccard, op11_importance, op12_whitening, op13_secrets,
)


def queries() -> dict[str, Query]:
    """All queries of this subpackage by name."""
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that SQL can express on whole tables."""
    return {"op4_warc": sql.WARC, "op6_sharding": sql.SHARDING, "op8_chat": sql.CHAT, "op11_importance": sql.IMPORTANCE}
