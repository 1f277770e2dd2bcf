"""Outliers by fences and z-scores. Bounds are two scalars, so rows are filtered at the scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import InsufficientDataError
from tabulon.operators.aggregate import fences
from tabulon.plans.longform import per_column, ref
from tabulon.plans.quantiles import numeric


def iqr_rows(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the interquartile fences."""
    bounds = fences(df, [column], k).get(column)
    if bounds is None:
        return df.limit(0)
    x = numeric(df, column)
    return df.filter((x < F.lit(bounds[2])) | (x > F.lit(bounds[3])))


def iqr_summary(df: DataFrame, columns: Iterable[str], k: float = 1.5) -> DataFrame:
    """Fences, count and percentage of outliers per column."""
    bounds = fences(df, columns, k)

    def measures(c):
        x = numeric(df, c)
        _, _, low, high = bounds[c]
        out = F.count_if((x < F.lit(low)) | (x > F.lit(high)))
        return {
            "total_points": F.count(x),
            "lower": F.round(F.lit(low), 4),
            "upper": F.round(F.lit(high), 4),
            "anomaly_count": out,
            "anomaly_pct": F.round(F.try_divide(out * 100.0, F.count(x)), 2),
        }

    return per_column(df, list(bounds), measures)


def _moments(df: DataFrame, columns, population: bool):
    spread = F.stddev_pop if population else F.stddev
    row = df.agg(
        *[F.struct(F.avg(numeric(df, c)).alias("m"), spread(numeric(df, c)).alias("s")).alias(f"z{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: (row[i]["m"], row[i]["s"]) for i, c in enumerate(columns)}


def zscore_rows(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose population z-score exceeds the threshold, with the score."""
    mean, std = _moments(df, [column], population=True)[column]
    if not std:
        return df.withColumn("z_score", F.lit(None).cast("double")).limit(0)
    x = numeric(df, column)
    far = (x < F.lit(mean - threshold * std)) | (x > F.lit(mean + threshold * std))
    return df.filter(far).withColumn("z_score", (x - F.lit(mean)) / F.lit(std))


def zscore_summary(df: DataFrame, columns: Iterable[str], threshold: float = 3.0) -> DataFrame:
    columns = list(columns)
    moments = _moments(df, columns, population=True)

    def measures(c):
        mean, std = moments[c]
        x = numeric(df, c)
        out = F.count_if(F.abs((x - F.lit(mean)) / F.lit(std)) > threshold) if std else F.lit(0).cast("long")
        return {
            "total_points": F.count(x),
            "threshold": F.lit(float(threshold)),
            "anomaly_count": out,
            "anomaly_pct": F.round(F.try_divide(out * 100.0, F.count(x)), 2),
        }

    return per_column(df, columns, measures)


def ranked_deviation(df: DataFrame, column: str, key: list[str], n: int = 100) -> DataFrame:
    """The n rows farthest from the mean, with their sample z-score; ties by key."""
    mean, std = _moments(df, [column], population=False)[column]
    x = ref(column)
    distance = F.abs(x - F.lit(mean))
    score = (x - F.lit(mean)) / F.lit(std) if std else F.lit(None).cast("double")
    return (
        df.filter(x.isNotNull())
        .withColumn("z_score", score)
        .orderBy(F.desc(distance), *[ref(k) for k in key])
        .limit(n)
    )


def require_points(df: DataFrame, column: str, needed: int = 10) -> None:
    got = df.agg(F.count(numeric(df, column))).first()[0]
    if got < needed:
        raise InsufficientDataError(column, needed, got)
