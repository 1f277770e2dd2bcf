"""Aggregate and scalar expressions for descriptive statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(c: Column) -> Column:
    return F.round(c, 4)


def skew_corrected(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from the population form; null below three values."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_corrected(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from the population form; null below four values."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def normality_k2(g1: Column, g2: Column, n: Column) -> Column:
    """D'Agostino-Pearson K^2 from population skewness, population excess kurtosis and n."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(scaled + F.sqrt(scaled * scaled + 1)) / F.sqrt(0.5 * F.log(w2))

    mean_b2 = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean_b2) / F.sqrt(var_b2)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    base = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(base) * F.pow((1 - 2 / a) / F.abs(base), F.lit(1.0 / 3))
    z_kurt = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    return z_skew * z_skew + z_kurt * z_kurt


def normality_p(k2: Column) -> Column:
    return F.exp(-k2 / 2)


def distribution_label(skew: Column) -> Column:
    s = F.coalesce(skew, F.lit(0.0))
    return F.when(F.abs(s) <= 0.5, "normal").when(s > 0, "right_skewed").otherwise("left_skewed")


def cardinality_label(distinct: Column, rows: Column) -> Column:
    ratio = F.when(rows > 0, distinct / rows).otherwise(0.0)
    return (
        F.when((distinct <= 10) | (ratio <= 0.1), "low")
        .when((distinct <= 50) | (ratio <= 0.5), "medium")
        .otherwise("high")
    )


def cardinality_ratio_label(distinct: Column, rows: Column) -> Column:
    ratio = F.when(rows > 0, distinct / rows).otherwise(0.0)
    return F.when(ratio < 0.1, "low").when(ratio < 0.5, "medium").otherwise("high")


def correlation_band(r: Column) -> Column:
    return F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.3, "moderate").otherwise("weak")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def frequency_label(median_days: Column) -> Column:
    return (
        F.when(median_days <= 1.5, "daily")
        .when(median_days <= 8, "weekly")
        .when(median_days <= 32, "monthly")
        .when(median_days <= 100, "quarterly")
        .when(median_days.isNotNull(), "yearly")
    )
