"""Classification metrics over (group, target, pred) rows. Ids A01-A11, A41-A44, J02-J05, K06, P20 of the survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., target, pred, n). Spark combines counts within tasks first, so this is also the incremental form. A02, A03, A51."""
    return rows.groupBy(*by, "target", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_pivot(rows: DataFrame, by: Sequence[str], classes: Sequence[int]) -> DataFrame:
    """One column p<k> per class, and each row's share of its own class. K06, P20."""
    wide = confusion(rows, by).groupBy(*by, "target").pivot("pred", list(classes)).agg(F.sum("n"))
    total = sum((F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in classes[1:]), F.coalesce(F.col(f"`{classes[0]}`"), F.lit(0)))
    own = F.coalesce(F.coalesce(*[F.when(F.col("target") == k, F.col(f"`{k}`")) for k in classes]), F.lit(0))
    cells = [F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(f"p{k}") for k in classes]
    return wide.select(*by, "target", *cells, F.round(own / F.greatest(total, F.lit(1)), 9).alias("recall"))


def class_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., cls, tp, n_target, n_pred): one pass over the confusion matrix, which is as small as the classes are few."""
    cells = confusion(rows, by)
    pairs = F.explode(F.array(F.struct(F.col("target").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    return cells.select(*by, "n", (F.col("target") == F.col("pred")).alias("hit"), pairs.alias("e")).groupBy(*by, F.col("e.cls").alias("cls")).agg(
        F.sum(F.when(F.col("hit") & (F.col("e.t") == 1), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("e.t")).alias("n_target"), F.sum(F.col("n") * F.col("e.p")).alias("n_pred")
    )


def _f1(tp: str, a: str, b: str):
    down = F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return F.when(down > 0, 2.0 * F.coalesce(F.col(tp), F.lit(0)) / down).otherwise(0.0)


def macro_f1(rows: DataFrame, by: Sequence[str], classes: DataFrame | None = None) -> DataFrame:
    """(by..., macro_f1). With ``classes`` (cls), over that fixed list, absent ones counting 0 (A04); without, over the labels
    that occur as target or prediction (A05)."""
    counts = class_counts(rows, by)
    if classes is not None:
        groups = counts.select(*by).distinct()
        counts = groups.crossJoin(F.broadcast(classes)).join(counts, [*by, "cls"], "left")
    return counts.groupBy(*by).agg(F.round(F.avg(_f1("tp", "n_target", "n_pred")), 9).alias("macro_f1"))


def accuracy(rows: DataFrame, by: Sequence[str], name: str = "accuracy") -> DataFrame:
    """(by..., accuracy, n). A06, A09 after a filter."""
    return rows.groupBy(*by).agg(F.round(F.avg("ok"), 9).alias(name), F.count(F.lit(1)).alias("n"))


def mean_of_means(rows: DataFrame, by: Sequence[str], inner: str, value: str = "ok") -> DataFrame:
    """(by..., mean): the plain mean of the inner groups' means. A10, A41, A44."""
    return rows.groupBy(*by, inner).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.round(F.avg("m"), 9).alias("mean"))


def by_grains(rows: DataFrame, low: Sequence[int]) -> DataFrame:
    """Accuracy by (model, class), (model, class, snr) and, for low levels, (model, class): one pass for all. A11."""
    sets = rows.groupingSets([["model", "target"], ["model", "target", "snr_db"]], "model", "target", "snr_db")
    return sets.agg(F.grouping("snr_db").cast("int").alias("all_levels"), F.round(F.avg("ok"), 9).alias("accuracy"), F.round(F.avg(F.when(F.col("snr_db_raw").isin(*low), F.col("ok"))), 9).alias("low_accuracy"), F.count(F.lit(1)).alias("n"))


def metrics(rows: DataFrame, by: Sequence[str], classes: DataFrame) -> DataFrame:
    """(by..., accuracy, macro_f1, n, per_snr): the levels' accuracies as signed-key text. A01."""
    levels = rows.groupBy(*by, "snr_db").agg(F.avg("ok").alias("a"), F.sum("ok").alias("hits"), F.count(F.lit(1)).alias("n"))
    joined = levels.groupBy(*by).agg(
        F.round(F.sum("hits") / F.sum("n"), 9).alias("accuracy"), F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct("snr_db", F.format_string("%+d=%.4f", "snr_db", F.round("a", 4)).alias("t")))).alias("levels"),
    )
    return joined.join(macro_f1(rows, by, classes), list(by)).select(*by, "accuracy", "macro_f1", "n", F.array_join(F.transform("levels", lambda x: x.t), ";").alias("per_snr"))


def alignment(rows: DataFrame, key: str, fields: Sequence[str], by: Sequence[str], base: DataFrame) -> DataFrame:
    """(by..., matched, missing, extra, differing) of each group against ``base`` by key, null-safe on the fields. J01, J02.

    ``base`` has each key once. Rows meet it by key; what a group lacks is what ``base`` has beyond the group's different keys.
    """
    wanted = base.select(key, *(F.col(c).alias(f"_{c}") for c in fields), F.lit(1).alias("_in"))
    both = rows.select(*by, key, *fields).join(wanted, key, "left")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = F.col("_in").isNotNull()
    counts = both.groupBy(*by).agg(F.count_if(known & same).alias("matched"), F.countDistinct(F.when(known, F.col(key))).alias("_keys"), F.count_if(~known).alias("extra"), F.count_if(known & ~same).alias("differing"))
    total = base.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(*by, "matched", (F.col("_total") - F.col("_keys")).alias("missing"), "extra", "differing")  # one row of total


def wide(rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per (seed, vec_id) with each model's prediction and hit. J05."""
    picks = [x for m in models for x in (F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"pred_{m}"), F.max(F.when(F.col("model") == m, F.col("ok"))).alias(f"ok_{m}"))]
    return rows.groupBy("seed", "vec_id").agg(*picks)


def paired(rows: DataFrame, reference: str, variant: str, on: Sequence[str], value: str) -> DataFrame:
    """(on..., diff): the reference's value less the variant's. J03, J04, A42, A54."""
    a = rows.where(F.col("model") == reference).select(*on, F.col(value).alias("x"))
    b = rows.where(F.col("model") == variant).select(*on, F.col(value).alias("y"))
    return a.join(b, list(on)).select(*on, F.round(F.col("x") - F.col("y"), 9).alias("diff"))


def error_by_level(rows: DataFrame, truth: str, estimate: str) -> DataFrame:
    """(level, mae, n) with the overall row under a null level. A07, A08."""
    return rows.rollup(truth).agg(F.round(F.avg(F.abs(F.col(estimate) - F.col(truth))), 6).alias("mae"), F.count(F.lit(1)).alias("n"))
