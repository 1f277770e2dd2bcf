"""Findings as rows: key candidates, table warnings and automatic insights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.aggregate import distinct_counts, fences, group_aggregate, outlier_counts, value_counts
from tabulon.operators.correlation import pair_correlations
from tabulon.plans.longform import numeric_columns, per_column, ref, text_columns
from tabulon.plans.quantiles import numeric


def key_candidates(df: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Columns named like keys, as primary or foreign key candidates, and strongly related pairs."""
    named = [c for c in df.columns if c.lower() == "id" or c.lower().endswith("_id")]
    parts = []
    if named:
        rows = df.agg(F.count(F.lit(1))).scalar()
        unique = F.col("distinct") >= F.greatest(F.lit(1), rows - 1)
        parts.append(
            distinct_counts(df, named).select(
                F.col("column").alias("left_column"),
                F.lit(None).cast("string").alias("right_column"),
                F.when(unique, "primary_key_candidate").otherwise("foreign_key_candidate").alias("relationship_type"),
                F.when(unique, 0.9).otherwise(0.75).alias("confidence"),
            )
        )
    if len(numeric_columns(df)) >= 2:
        r = F.col("correlation")
        parts.append(
            pair_correlations(df)
            .filter(F.abs(r) >= threshold)
            .select(
                F.col("left").alias("left_column"),
                F.col("right").alias("right_column"),
                F.lit("statistical_correlation").alias("relationship_type"),
                F.round(F.abs(r), 2).alias("confidence"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Check of a foreign key candidate: child keys without a parent and the rows that carry them."""
    lost = child.filter(ref(key).isNotNull()).groupBy(ref(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).join(
        parent.select(ref(parent_key).alias("k")), "k", "left_anti"
    )
    return lost.agg(F.count(F.lit(1)).alias("orphan_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))


def _outlier_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    bounds = {c: b for c, b in fences(df, columns).items() if b[0] != b[1]} if columns else {}
    if not bounds:
        return None
    n = df.agg(*[F.count(numeric(df, c)).alias(f"n{i}") for i, c in enumerate(bounds)]).first()
    far = outlier_counts(df, {c: b[2:] for c, b in bounds.items()})
    rows = [(c, n[i], far[c]) for i, c in enumerate(bounds)]
    return df.sparkSession.createDataFrame(rows, "column string, n long, outliers long")


def table_insights(df: DataFrame, numbers: int | None = None, words: int | None = None) -> DataFrame:
    """Outlier warnings, unique and constant text columns, missing share; (type, column, severity, value). Over all numeric and text columns, or the first ones."""
    parts = []
    far = _outlier_counts(df, numeric_columns(df)[:numbers])
    if far is not None:
        share = F.col("outliers") / F.col("n")
        parts.append(
            far.filter(F.col("outliers") > 0).select(
                F.lit("anomaly_warning").alias("type"),
                "column",
                F.when(share > 0.05, "high").otherwise("low").alias("severity"),
                F.round(share * 100, 1).alias("value"),
            )
        )
    texts = text_columns(df)[:words]
    if texts:
        rows = df.agg(F.count(F.lit(1))).scalar()
        d = F.col("distinct")
        parts.append(
            distinct_counts(df, texts)
            .withColumn("type", F.when(d == rows, "unique_identifier").when(d == 1, "constant_column"))
            .filter(F.col("type").isNotNull())
            .select("type", "column", F.lit(None).cast("string").alias("severity"), d.cast("double").alias("value"))
        )
    cells = [F.avg(ref(c).isNull().cast("double")) for c in df.columns]
    missing = (sum(cells[1:], cells[0]) / len(cells)) * 100
    parts.append(
        df.agg(missing.alias("p"))
        .filter(F.col("p") > 5)
        .select(
            F.lit("data_quality").alias("type"),
            F.lit(None).cast("string").alias("column"),
            F.when(F.col("p") > 20, "high").otherwise("medium").alias("severity"),
            F.round("p", 1).alias("value"),
        )
    )
    return reduce(lambda a, b: a.unionByName(b), parts)


def auto_insights(
    df: DataFrame,
    date: str | None = None,
    tie: Sequence[str] = (),
    numbers: Sequence[str] | None = None,
    texts: Sequence[str] | None = None,
) -> DataFrame:
    """Trend, anomaly, correlation, distribution and comparison findings as rows.

    First and last values in time order are taken with min_by and max_by, so no sort is needed.
    """
    numbers = list(numbers or numeric_columns(df))
    texts = list(texts or text_columns(df))
    parts = []

    def rows(frame, kind, severity, metric, value, detail):
        parts.append(
            frame.select(
                F.lit(kind).alias("type"),
                severity.alias("severity"),
                metric.alias("metric"),
                value.cast("double").alias("value"),
                detail.cast("string").alias("detail"),
            )
        )

    if date:
        def ends(c):
            kept = F.when(ref(date).isNotNull() & ref(c).isNotNull(), F.struct(ref(date), *[ref(k) for k in tie]))
            return {
                "n": F.count(kept),
                "a": F.min_by(ref(c).cast("double"), kept),
                "b": F.max_by(ref(c).cast("double"), kept),
            }

        trend = per_column(df, numbers, ends).withColumn(
            "pct", F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100).otherwise(0.0)
        )
        trend = trend.filter((F.col("n") >= 10) & (F.abs("pct") > 20))
        rows(
            trend, "trend", F.when(F.abs("pct") > 50, "high").otherwise("medium"), F.col("column"),
            F.round("pct", 1), F.when(F.col("pct") > 0, "increased").otherwise("decreased"),
        )
    far = _outlier_counts(df, numbers)
    if far is not None:
        share = F.col("outliers") / F.col("n") * 100
        rows(
            far.filter((F.col("n") >= 20) & (share > 5)), "anomaly", F.lit("medium"), F.col("column"),
            F.col("outliers"), F.round(share, 1),
        )
    if len(numbers) >= 2:
        r = F.col("correlation")
        rows(
            pair_correlations(df, numbers).filter(F.abs(r) > 0.7), "correlation",
            F.when(F.abs(r) > 0.9, "high").otherwise("medium"),
            F.concat_ws(" vs ", "left", "right"), F.round(r, 2), F.when(r > 0, "positive").otherwise("negative"),
        )
    if texts:
        total = df.agg(F.count(F.lit(1))).scalar()
        tops = (
            value_counts(df, texts)
            .groupBy("column")
            .agg(
                F.count(F.lit(1)).alias("values"),
                F.min(F.struct(-F.col("count"), "value"))["value"].alias("top"),
                F.max("count").alias("n"),
            )
            .withColumn("pct", F.col("n") * 100 / total)
            .filter((F.col("values") <= 10) & (F.col("pct") > 50))
        )
        rows(tops, "distribution", F.lit("low"), F.col("column"), F.round("pct", 1), F.col("top"))
    for c in texts:
        for x in numbers:
            means = group_aggregate(df.filter(ref(c).isNotNull()), c, x, ["AVG"])
            m = F.col(f"avg_{x}")
            best = means.agg(
                F.count(m).alias("groups"),
                F.max(m).alias("hi"),
                F.min(m).alias("lo"),
                F.min(F.when(m.isNotNull(), F.struct((-m).alias("m"), ref(c).alias("top"))))["top"].alias("top"),
            ).withColumn("pct", F.when(F.col("lo") != 0, (F.col("hi") - F.col("lo")) / F.col("lo") * 100).otherwise(0.0))
            rows(
                best.filter((F.col("groups") >= 2) & (F.abs("pct") > 50)), "comparison", F.lit("medium"),
                F.lit(f"{c} -> {x}"), F.round("pct", 1), F.col("top"),
            )
    return reduce(lambda a, b: a.unionByName(b), parts)
