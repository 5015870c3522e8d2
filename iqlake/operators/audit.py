"""Completeness, closure and conformity checks. Ids F05, F06, J10, J14, J15, X05-X07, A46, G06-G15, G22 of the survey."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_status(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., status): present, missing or unexpected, from one full join of the key sets. J10, J14, J15."""
    e, o = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), observed.select(*keys).distinct().withColumn("_o", F.lit(1))
    status = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").otherwise("present")
    return e.join(o, list(keys), "full_outer").select(*keys, status.alias("status"))


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n) of keys that occur more than once. J15, X07."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``rows`` with issues, the names of the rules that each row breaks; a rule that is null counts as broken. F05, P31."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.withColumn("issues", F.filter(broken, lambda x: x.isNotNull()))


def run_rules(epochs: int | None = None) -> dict[str, Column]:
    """What every completed run has to keep, over the columns of a run table. G08-G13.

    bindings (a struct) are those expected; the test split is untouched, by the run and by its summary; the checkpoint is the
    one whose digest metrics and summary name; no last state is left; recorded and recomputed scores agree within 1e-12. With
    ``epochs``, the run has exactly so many, and a history of that length.
    """
    rules = {
        "bindings": F.col("bindings").eqNullSafe(F.col("expected_bindings")),
        "test_access": ~F.col("test_accessed") & ~F.col("summary_test_accessed"),
        "checkpoint": (F.col("checkpoint_sha256") == F.col("stored_sha256")) & (F.col("summary_sha256") == F.col("stored_sha256")),
        "last_state": ~F.col("keeps_last"),
        "score": F.abs(F.col("score") - F.col("recorded_score")) <= 1e-12,
    }
    if epochs is not None:
        rules |= {"epochs": F.col("epochs") == epochs, "history": F.size("history") == epochs}
    return rules


def queue_audit(runs: DataFrame, expected: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(keys..., issues) of a queue's runs: the rules that a run breaks, ``repeated`` where its keys occur again, ``missing`` and
    ``unexpected`` against the keys of the queue's matrix. G09-G12."""
    n = runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    status = key_status(expected, runs, keys)
    checked = violations(runs, rules).select(*keys, "issues").join(n, list(keys)).join(status, list(keys))
    more = F.filter(F.array(F.when(F.col("_n") > 1, F.lit("repeated")), F.when(F.col("status") == "unexpected", F.lit("unexpected"))), lambda x: x.isNotNull())
    lacking = status.where("status = 'missing'").select(*keys, F.array(F.lit("missing")).alias("issues"))
    return checked.select(*keys, F.concat("issues", more).alias("issues")).unionByName(lacking)


def check_table(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(id, passed, failures): one row per rule over all rows, in one pass. A46, G22."""
    counts = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("id"), F.col(n).alias("failures")) for n in rules)))
    return counts.select(pairs.alias("e")).select("e.id", (F.col("e.failures") == 0).alias("passed"), "e.failures")


def require(checks: DataFrame) -> None:
    """Strict mode: raise with the names of failed checks."""
    failed = [r.id for r in checks.where("not passed").select("id").take(20)]
    if failed:
        raise ValueError(f"checks failed: {', '.join(failed)}")


def bound(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, status) of a file listing (path, size, sha256) against a manifest of the same columns. H07, G14."""
    m = manifest.select("path", F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    both = files.select("path", "size", "sha256").join(m, "path", "full_outer")
    status = F.when(F.col("size").isNull(), "missing").when(F.col("_size").isNull(), "unlisted").when(F.col("size") != F.col("_size"), "size").when(F.col("sha256") != F.col("_sha"), "digest").otherwise("ok")
    return both.select("path", status.alias("status"))
