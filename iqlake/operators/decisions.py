"""Decision rules over summary rows. Ids G01-G06, G23 of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the screening rule: clear drop on low levels, clear drop overall, unchanged.
CLEAR_LOW, CLEAR_ALL, SAME = 0.010, 0.005, 0.005


def contribution(low_lower: Column, acc_lower: Column, f1_lower: Column, positive: Column, least: int = 4) -> Column:
    """Qualifies where the low-level interval is above 0, so is that of accuracy or macro-F1, and enough seeds agree. G01."""
    shown = (low_lower > 0) & ((acc_lower > 0) | (f1_lower > 0))
    return F.when(shown & (positive >= least), "qualifies").when((low_lower > 0) | (acc_lower > 0) | (f1_lower > 0), "evidence_insufficient").otherwise("not_supported")


def scope(first: Column, second: Column) -> Column:
    """What two contributions' statuses leave of the main line. G02."""
    return F.when(first & second, "both").when(first, "first_only").when(second, "second_only").otherwise("neither")


def screening(low_drop: Column, all_drop: Column) -> Column:
    """Order matters: clear drop, unchanged, not worse, borderline. G03, G04."""
    return (
        F.when((low_drop >= CLEAR_LOW) & (all_drop >= CLEAR_ALL), "clear_drop")
        .when((F.abs(low_drop) <= SAME) & (F.abs(all_drop) <= SAME), "unchanged")
        .when((low_drop <= 0) & (all_drop <= 0), "not_worse")
        .otherwise("borderline")
    )


def combined(rows: DataFrame) -> DataFrame:
    """One row: variants whose status asks for formal runs, in name order, and the scope that follows. G05."""
    needs = F.col("status").isin("clear_drop", "borderline")
    names = F.array_join(F.array_sort(F.collect_list(F.when(needs, F.col("variant")))), ",")
    out = rows.agg(names.alias("formal"), F.count_if(needs).alias("k"), F.count(F.lit(1)).alias("n"))
    return out.select("formal", F.when(F.col("k") == 0, "none").when(F.col("k") == F.col("n"), "all").otherwise("some").alias("scope"))


def independence(evidence: DataFrame) -> DataFrame:
    """One row: ineligible with any decisive evidence, else indeterminate with any error, else eligible. G06."""
    d, e = F.count_if("decisive"), F.count_if("error")
    return evidence.agg(d.alias("decisive"), e.alias("errors"), F.when(d > 0, "ineligible").when(e > 0, "indeterminate").otherwise("eligible").alias("status"))


def within_gap(a: Column, b: Column, most: float = 0.05) -> Column:
    """Relative gap below the gate. G23."""
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-30)) < most
