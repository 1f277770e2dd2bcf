"""Data-quality metrics, issues and scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import (
    EmptyInputError,
    InsufficientDataError,
    InsufficientFeaturesError,
    MissingColumnError,
    NoVarianceError,
)
from tabulon.functions.stats import round4
from tabulon.functions.text import parse_number
from tabulon.operators.aggregate import (
    distinct_counts,
    duplicate_rows,
    fence,
    fences,
    missing_counts,
    outlier_counts,
)
from tabulon.plans.longform import identity, numeric_columns, per_column, ref, text_columns, unpivot_text
from tabulon.plans.quantiles import column_summaries, numeric
from tabulon.plans.slots import joint_counts
from tabulon.plans.stage import stage


def quality_metrics(df: DataFrame) -> DataFrame:
    """One row per measured concern of the table and of each column.

    Passes over the table: one wide count, one value count of the text columns (staged, it answers
    duplicates and mixed types), one digest count, and the quantile passes of the numeric columns.
    """
    words, numbers = text_columns(df), numeric_columns(df)
    head = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(ref(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)],
        *[F.count_if(F.trim(ref(c)) != ref(c)).alias(f"w{i}") for i, c in enumerate(words)],
    ).first()
    rows = head["rows"]
    missing = {c: head[f"m{i}"] for i, c in enumerate(df.columns)}

    def share(count, base):
        return count / base if base else None

    out = [("completeness", "table", None, sum(missing.values()), share(sum(missing.values()), rows * len(missing)))]
    out += [("completeness", "column", c, n, share(n, rows)) for c, n in missing.items()]
    out.append(("consistency", "table", None, sum(rows > 0 and n == rows for n in missing.values()), None))
    out += [("consistency", "column", c, head[f"w{i}"], None) for i, c in enumerate(words)]
    copies = duplicate_rows(df).first()["duplicate_rows"]
    out.append(("duplicates", "table", None, copies, share(copies, rows)))
    if words:
        value = F.col("value")
        reads = F.when(value.isNotNull(), parse_number(value).isNotNull().cast("double")).alias("number")
        values = stage(
            unpivot_text(df, words).groupBy("column", identity(value).alias("value"), reads).agg(F.count(F.lit(1)).alias("n"))
        )
        number = F.avg("number")
        per = values.groupBy("column").agg(F.sum(F.col("n") - 1).alias("extra"), F.round(number, 4).alias("mix"))
        for row in per.collect():
            out.append(("duplicates", "column", row["column"], row["extra"], None))
            out.append(("data_types", "column", row["column"], None, row["mix"]))
    for c, (n, iqr, z) in _far_counts(df, numbers).items():
        if n >= 10:
            out.append(("outliers_iqr", "column", c, iqr, share(iqr, n)))
        if n >= 30:
            out.append(("outliers_zscore", "column", c, z, share(z, n)))
    return df.sparkSession.createDataFrame(
        out, "category string, scope string, column string, issue_count long, ratio double"
    )


def _far_counts(df: DataFrame, numbers: list[str]) -> dict[str, tuple[int, int, int]]:
    """{column: (values, outside the fences, beyond three deviations)} of columns with a spread."""
    if not numbers:
        return {}
    found = column_summaries(df, numbers, (0.25, 0.75), {"mean": F.avg, "std": F.stddev_pop})
    slots = {}
    for c, r in found.items():
        pair = fence(r)
        if pair is None:
            continue
        x = numeric(df, c)
        z = F.abs((x - F.lit(r.extra["mean"])) / F.lit(r.extra["std"])) > 3
        slots[c] = ((x < F.lit(pair[0])) | (x > F.lit(pair[1]))).cast("int") + F.lit(2) * z.cast("int")
    counts = joint_counts(df, slots) if slots else {}
    return {
        c: (found[c].n, sum(k.get(s, 0) for s in (1, 3)), sum(k.get(s, 0) for s in (2, 3))) for c, k in counts.items()
    }


def quality_issues(df: DataFrame) -> DataFrame:
    """Metrics that cross a threshold, with their severity."""
    return issues_of(quality_metrics(df))


def issues_of(metrics: DataFrame) -> DataFrame:
    ratio, count = F.col("ratio"), F.col("issue_count")
    category, on_table = F.col("category"), F.col("scope") == "table"
    severity = (
        F.when(
            (category == "completeness") & on_table,
            F.when(ratio > 0.5, "critical").when(ratio > 0.2, "error").when(ratio > 0.05, "warning"),
        )
        .when(category == "completeness", F.when(ratio > 0.5, "error").when(ratio > 0.2, "warning"))
        .when(
            (category == "duplicates") & on_table, F.when(ratio > 0.1, "error").when(ratio > 0.01, "warning")
        )
        .when(category == "duplicates", F.when(count > 0, "info"))
        .when(category == "data_types", F.when((ratio > 0.2) & (ratio < 0.8), "warning"))
        .when(category == "outliers_iqr", F.when(ratio > 0.1, "warning"))
        .when(category == "outliers_zscore", F.when(ratio > 0.05, "info"))
        .when((category == "consistency") & on_table, F.when(count > 0, "error"))
        .when(category == "consistency", F.when(count > 0, "info"))
    )
    return (
        metrics.withColumn("severity", severity)
        .filter(F.col("severity").isNotNull())
        .select("severity", "category", "scope", "column", "issue_count", round4(ratio).alias("ratio"))
    )


def quality_score(df: DataFrame) -> DataFrame:
    """0..100 from issue severities, the missing share and the duplicate share."""
    metrics = quality_metrics(df)
    on_table = F.col("scope") == "table"
    shares = metrics.agg(
        F.coalesce(F.max(F.when(on_table & (F.col("category") == "completeness"), F.col("ratio"))), F.lit(0.0)).alias("nulls"),
        F.coalesce(F.max(F.when(on_table & (F.col("category") == "duplicates"), F.col("ratio"))), F.lit(0.0)).alias("copies"),
    ).first()
    issues = issues_of(metrics).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    raw = (
        100 - 20 * F.col("critical") - 10 * F.col("errors") - 3 * F.col("warnings")
        - 30 * F.lit(shares["nulls"]) - 20 * F.lit(shares["copies"])
    )
    return issues.select(
        "critical", "errors", "warnings",
        F.greatest(F.lit(0), F.least(F.lit(100), F.rint(raw).cast("int"))).alias("quality_score"),
    )


def quality_report(df: DataFrame) -> DataFrame:
    """Upload summary: duplicates, mean missing share, sparse columns, columns with outliers."""
    missing = missing_counts(df)
    numbers = numeric_columns(df)
    bounds = {c: b for c, b in fences(df, numbers).items() if b[0] != b[1]} if numbers else {}
    far = outlier_counts(df, {c: b[2:] for c, b in bounds.items()})
    means = missing.agg(
        F.round(F.avg("missing_pct"), 2).alias("average_missing_pct"),
        F.array_sort(F.collect_list(F.when(F.col("missing_pct") >= 20, F.col("column")))).alias("sparse"),
    )
    copies = duplicate_rows(df).select(F.struct("duplicate_rows", "duplicate_pct").alias("d")).scalar()
    return means.select(
        copies["duplicate_rows"].alias("duplicate_rows"),
        copies["duplicate_pct"].alias("duplicate_pct"),
        "average_missing_pct",
        F.array_join("sparse", ",").alias("high_missing_columns"),
        F.lit(sum(n > 0 for n in far.values())).cast("long").alias("columns_with_outliers"),
        F.round(100 - F.col("average_missing_pct"), 2).alias("completeness_score"),
    )


def column_scores(df: DataFrame) -> DataFrame:
    """Completeness, cardinality, variability and their weighted score per column."""
    numbers = set(numeric_columns(df))
    rows = F.count(F.lit(1))

    def measures(c):
        is_number = c in numbers
        x = numeric(df, c) if is_number else F.lit(None).cast("double")
        return {
            "type": F.lit("numeric" if is_number else "categorical" if c in text_columns(df) else "datetime"),
            "rows": rows,
            "completeness": F.coalesce(F.try_divide(F.count(ref(c)), rows), F.lit(0.0)),
            "mean": F.avg(x),
            "std": F.stddev(x),
        }

    base = per_column(df, df.columns, measures).join(F.broadcast(distinct_counts(df, df.columns)), "column")
    cardinality = F.coalesce(F.try_divide(F.col("distinct"), F.col("rows")), F.lit(0.0))
    swing = F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(0.0)
    swing_part = F.when(F.col("type") == "numeric", F.greatest(F.lit(0.0), F.least(swing / 10, F.lit(1.0)))).otherwise(0.5)
    score = F.col("completeness") * 0.4 + (1 - F.least(cardinality, F.lit(1.0))) * 0.3 + F.coalesce(swing_part, F.lit(0.0)) * 0.3
    return base.select(
        "column",
        "type",
        round4(F.col("completeness")).alias("completeness"),
        round4(cardinality).alias("cardinality"),
        F.col("distinct").alias("unique_count"),
        round4(score).alias("quality_score"),
    )


def overall_score(df: DataFrame) -> DataFrame:
    return column_scores(df).agg(round4(F.avg("quality_score")).alias("overall_score"))


def table_checks(df: DataFrame) -> DataFrame:
    """Row and column counts, duplicates, missing share and whether the table passes."""
    share = sum((F.avg(ref(c).isNull().cast("double")) for c in df.columns), F.lit(0.0)) / len(df.columns)
    copies = duplicate_rows(df).select("duplicate_rows").scalar()
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        round4(F.coalesce(share, F.lit(0.0))).alias("null_ratio"),
    ).withColumn("duplicate_rows", copies)
    return base.withColumn(
        "valid", (F.col("row_count") > 0) & (F.col("null_ratio") <= 0.5) & (F.col("duplicate_rows") == 0)
    )


# -- preconditions -----------------------------------------------------------------------------


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = set(columns) - set(df.columns)
    if missing:
        raise MissingColumnError(missing, df.columns)


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise EmptyInputError("the input has no rows")


def check_time_series(df: DataFrame, date: str, value: str, points: int = 24) -> None:
    require_columns(df, [date, value])
    got = df.agg(F.count(ref(value))).first()[0]
    if got < points:
        raise InsufficientDataError("time series points", points, got)


def check_clustering(df: DataFrame, rows: int = 30, features: int = 2) -> None:
    got = df.count()
    if got < rows:
        raise InsufficientDataError("clustering rows", rows, got)
    numbers = numeric_columns(df)
    if len(numbers) < features:
        raise InsufficientFeaturesError("clustering features", features, len(numbers))


def check_regression(df: DataFrame, target: str, features: int = 2) -> None:
    require_columns(df, [target])
    spread = df.agg(F.stddev(ref(target))).first()[0]
    if spread == 0:
        raise NoVarianceError(f"target {target} is constant")
    others = [c for c in numeric_columns(df) if c != target]
    if len(others) < features:
        raise InsufficientFeaturesError("regression predictors", features, len(others))


def check_rfm(df: DataFrame, customer: str, date: str, amount: str, customers: int = 20, days: int = 30) -> None:
    require_columns(df, [customer, date, amount])
    row = (
        df.groupBy(ref(customer))
        .agg(F.min(ref(date)).alias("a"), F.max(ref(date)).alias("b"))
        .agg(F.count(ref(customer)).alias("n"), F.datediff(F.max("b"), F.min("a")).alias("d"))
        .first()
    )
    if row["n"] < customers:
        raise InsufficientDataError("customers", customers, row["n"])
    if (row["d"] or 0) < days:
        raise InsufficientDataError("days of history", days, row["d"] or 0)
