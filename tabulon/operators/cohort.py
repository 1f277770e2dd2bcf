"""Retention and value by cohort.

Rows are first combined to one per (member, period), so that everything after the first shuffle is
bounded by members x periods and a member with very many rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import InsufficientDataError
from tabulon.plans.longform import freeze, numeric_columns, ref

MONTHS = "month"


def _period_index(period, first, grain: str):
    if grain == MONTHS:
        return (F.year(period) - F.year(first)) * 12 + (F.month(period) - F.month(first))
    days = F.datediff(period, first)
    return F.floor(days / (7 if grain == "week" else 1)).cast("int")


def cohort_cells(df: DataFrame, member: str, time: str, value: str, grain: str = MONTHS) -> DataFrame:
    """(cohort, index) cells: members active, value, cohort size, retention."""
    kept = df.select(ref(member).alias("m"), F.date_trunc(grain, ref(time)).alias("period"), ref(value).alias("v"))
    active = kept.na.drop().groupBy("m", "period").agg(F.sum("v").alias("v"))
    first = F.min("period").over(Window.partitionBy("m"))
    indexed = active.withColumn("cohort", first)
    cells = indexed.groupBy(
        "cohort", _period_index(F.col("period"), F.col("cohort"), grain).alias("cohort_index")
    ).agg(F.count(F.lit(1)).alias("members"), F.sum("v").alias("value"))
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("members"))).over(Window.partitionBy("cohort"))
    return cells.withColumn("cohort_size", size).select(
        F.to_date("cohort").alias("cohort"),
        "cohort_index",
        "members",
        "cohort_size",
        F.round(F.col("members") / F.col("cohort_size"), 4).alias("retention"),
        F.round("value", 2).alias("value"),
    )


def average_retention(cells: DataFrame) -> DataFrame:
    """Mean over the full cohort x index grid without index 0; absent cells count as 0."""
    out = cells.agg(
        F.count_distinct("cohort").alias("cohort_count"),
        F.count_distinct("cohort_index").alias("period_count"),
        F.sum(F.when(F.col("cohort_index") > 0, F.col("retention")).otherwise(0.0)).alias("later"),
        F.avg(F.when(F.col("cohort_index") == 0, F.col("retention"))).alias("initial"),
    )
    grid = F.col("cohort_count") * (F.col("period_count") - 1)
    return out.select(
        "cohort_count",
        "period_count",
        F.round(F.when(grid > 0, F.col("later") / grid).otherwise(F.col("initial")), 4).alias("average_retention"),
    )


def pivot_cells(cells: DataFrame, value: str, periods: int | None = None) -> DataFrame:
    """Wide matrix of the indexes present, or of the first `periods` ones; absent cells are 0. Columns follow the
    calendar: one for each period that a cohort can be away."""
    if periods is None:
        found = [r[0] for r in cells.select("cohort_index").distinct().orderBy("cohort_index").collect()]
    else:
        found = list(range(periods))
    wide = cells.groupBy("cohort").pivot("cohort_index", found).agg(F.first(value))
    return wide.na.fill(0).toDF("cohort", *[f"p{i}" for i in found])


def dimension_cells(df: DataFrame, cohort: str, period, metric: str) -> DataFrame:
    """Sum of the metric (its row count if not numeric) and rows by cohort value and period."""
    amount = F.sum(ref(metric)) if metric in numeric_columns(df) else F.count(F.lit(1)).cast("double")
    kept = df.filter(ref(cohort).isNotNull())
    grouped = kept.groupBy(ref(cohort).cast("string").alias("cohort_name"), period.alias("period")).agg(
        amount.alias("value"), F.count(F.lit(1)).alias("count")
    )
    sizes = grouped.groupBy("cohort_name").agg(F.sum("count").alias("cohort_size"))
    return grouped.join(sizes, "cohort_name").select(
        "cohort_name", "cohort_size", "period", F.round("value", 2).alias("value"), "count"
    )


def dimension_extremes(cells: DataFrame, min_cohorts: int = 3) -> DataFrame:
    """Best and worst cohort by total value; ties by the smaller name."""
    totals = cells.groupBy("cohort_name").agg(F.round(F.sum("value"), 2).alias("total"))
    out = freeze(
        totals.agg(
            F.count(F.lit(1)).alias("total_cohorts"),
            F.min(F.struct(-F.col("total"), "cohort_name"))["cohort_name"].alias("best_cohort"),
            F.max("total").alias("best_total"),
            F.min(F.struct("total", "cohort_name"))["cohort_name"].alias("worst_cohort"),
            F.min("total").alias("worst_total"),
        )
    )
    got = out.first()["total_cohorts"]
    if got < min_cohorts:
        raise InsufficientDataError("cohorts", min_cohorts, got)
    return out
