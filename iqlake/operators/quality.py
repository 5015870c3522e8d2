"""Numeric quality of array-valued samples and of plain columns. Ids A12-A18, A20-A22, F03-F05, S18, T04 of the survey."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A


def _sums(a: Column) -> Column:
    """struct of a window's finite count, sum, sum of squares, min and max, and its NaN, infinity and zero counts."""
    d = A.doubles(a)
    ok = F.filter(d, A.is_finite)
    count = lambda test: F.size(F.filter(d, test)).cast("long")
    return F.struct(
        F.size(ok).cast("long").alias("n"), A.total(ok).alias("s"), A.total(F.transform(ok, lambda x: x * x)).alias("ss"), F.array_min(ok).alias("lo"), F.array_max(ok).alias("hi"),
        count(F.isnan).alias("nan"), count(lambda x: x == A.INF).alias("pinf"), count(lambda x: x == -A.INF).alias("ninf"), count(lambda x: x == 0).alias("zero"),
    )


def partials(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per sample, what the reports add up: channel sums, complex power where both channels are finite, zero energy."""
    both = F.filter(F.zip_with("i", "q", lambda x, y: F.when(A.is_finite(x) & A.is_finite(y), x.cast("double") * x + y.cast("double") * y)), lambda x: x.isNotNull())
    return rows.select(*by, _sums(F.col("i")).alias("a"), _sums(F.col("q")).alias("b"), A.total(both).alias("power"), F.size(both).alias("pairs"), A.all_zero(F.col("i"), F.col("q")).cast("int").alias("silent"))


def report(parts: DataFrame, digits: int = 6) -> list[Column]:
    """Aggregates of ``partials`` rows; means of nothing are null. A12, A13, A15-A17."""
    add = lambda f: F.sum(F.col(f"a.{f}") + F.col(f"b.{f}"))
    n = add("n")
    r = lambda x: F.round(x, digits)
    nothing = F.when(n > 0, n)
    return [
        F.count(F.lit(1)).alias("samples"), n.alias("finite"), add("nan").alias("nan"), add("pinf").alias("pos_inf"), add("ninf").alias("neg_inf"), add("zero").alias("zeros"), F.sum("silent").alias("zero_energy"),
        r(F.min(F.least("a.lo", "b.lo"))).alias("lowest"), r(F.max(F.greatest("a.hi", "b.hi"))).alias("highest"), r(add("s") / nothing).alias("mean"), r(add("ss") / nothing).alias("mean_square"), r(F.sqrt(add("ss") / nothing)).alias("rms"),
        r(F.sum("a.s") / F.when(F.sum("a.n") > 0, F.sum("a.n"))).alias("dc_i"), r(F.sum("b.s") / F.when(F.sum("b.n") > 0, F.sum("b.n"))).alias("dc_q"), r(F.sum("power") / F.when(F.sum("pairs") > 0, F.sum("pairs"))).alias("mean_power"),
    ]


def cells(rows: DataFrame, by: Sequence[str] = ("modulation", "snr_db")) -> DataFrame:
    """One report per cell. A13."""
    parts = partials(rows, by)
    return parts.groupBy(*by).agg(*report(parts))


def overall(rows: DataFrame) -> DataFrame:
    """The report over all cells. A14."""
    parts = partials(rows, [])
    return parts.agg(*report(parts))


def in_order(report_rows: DataFrame, by: Sequence[str] = ("modulation", "snr_db")) -> DataFrame:
    """A report's rows in canonical order; ``sources.ordered_tables`` keeps tables of any size in one. T04."""
    return report_rows.orderBy(*by)


def audit(rows: DataFrame, length: int) -> DataFrame:
    """One row over a whole table: all values finite, rows, cells, all windows of ``length``. One pass with one aggregate. S18."""
    return rows.agg(
        F.bool_and(A.all_finite(F.col("i")) & A.all_finite(F.col("q"))).alias("finite"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("modulation", "snr_db").alias("cells"), F.bool_and((F.size("i") == length) & (F.size("q") == length)).alias("shaped"),
    )


def column_summary(rows: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """(column, n, lowest, highest, mean, mean_square, nan, zeros): all columns in one pass over the table. A12, A15."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        ok = F.when(A.is_finite(x), x)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(ok).alias("n"), F.round(F.min(ok), digits).alias("lowest"), F.round(F.max(ok), digits).alias("highest"), F.round(F.avg(ok), digits).alias("mean"), F.round(F.avg(ok * ok), digits).alias("mean_square"), F.count_if(F.isnan(x)).alias("nan"), F.count_if(x == 0).alias("zeros")).alias(c))
    return rows.agg(*aggs).select(F.explode(F.array(*columns)).alias("e")).select("e.*")


def population_stats(rows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of either channel over all values. A21."""
    p = partials(rows, [])
    out = []
    for c, name in (("a", "i"), ("b", "q")):
        n, s, ss = F.sum(f"{c}.n"), F.sum(f"{c}.s"), F.sum(f"{c}.ss")
        out += [(s / n).alias(f"mu_{name}"), F.sqrt(ss / n - (s / n) * (s / n)).alias(f"sigma_{name}")]
    return p.agg(*out)
