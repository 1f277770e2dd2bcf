"""Pairwise correlation: every pair is one codegen aggregate in a single scan."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.stats import correlation_band, round4
from tabulon.plans.longform import numeric_columns
from tabulon.plans.quantiles import numeric


def _pair_cells(df: DataFrame, columns: list[str]) -> list:
    cells = []
    for a, b in combinations(columns, 2):
        x, y = numeric(df, a).cast("double"), numeric(df, b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        cells.append(
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                F.count_if(both).alias("n"),
                F.corr(x, y).alias("correlation"),
            )
        )
    return cells


def pair_correlations(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(left, right, n, correlation) of each column pair over the rows where both are present."""
    cells = _pair_cells(df, list(columns or numeric_columns(df)))
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows"))


def correlation_matrix(df: DataFrame, columns: Iterable[str] | None = None, digits: int = 4) -> DataFrame:
    """Full symmetric matrix as (row, column, value) cells; undefined cells are left out."""
    columns = list(columns or numeric_columns(df))
    own = []
    for c in columns:
        x = numeric(df, c).cast("double")
        one = F.when(F.var_pop(x) > 0, 1.0)
        own.append(F.struct(F.lit(c).alias("left"), F.lit(c).alias("right"), F.count(x).alias("n"), one.alias("correlation")))
    cells = df.agg(F.array(*own, *_pair_cells(df, columns)).alias("rows")).select(F.inline("rows"))
    a, b = F.col("left"), F.col("right")
    there = F.struct(a.alias("row"), b.alias("column"), F.col("correlation").alias("value"))
    back = F.struct(b.alias("row"), a.alias("column"), F.col("correlation").alias("value"))
    both = F.when(a == b, F.array(there)).otherwise(F.array(there, back))
    return (
        cells.select(F.explode(both).alias("c"))
        .select("c.*")
        .filter(F.col("value").isNotNull())
        .withColumn("value", F.round("value", digits))
    )


def strong_pairs(df: DataFrame, columns=None, threshold: float = 0.5, top: int = 20) -> DataFrame:
    """Pairs whose correlation reaches the threshold, strongest first, with their band."""
    r = F.col("correlation")
    return (
        pair_correlations(df, columns)
        .filter(F.abs(r) >= threshold)
        .select("left", "right", round4(r).alias("correlation"), correlation_band(r).alias("strength"))
        .orderBy(F.desc(F.abs(r)), "left", "right")
        .limit(top)
    )


def band_counts(df: DataFrame, columns=None) -> DataFrame:
    """Pairs per band: strong and moderate on both sides, weak in between."""
    r = F.col("correlation")
    return pair_correlations(df, columns).agg(
        F.count_if(r > 0.7).alias("strong_positive"),
        F.count_if((r > 0.3) & (r <= 0.7)).alias("moderate_positive"),
        F.count_if((r >= -0.3) & (r <= 0.3)).alias("weak"),
        F.count_if((r >= -0.7) & (r < -0.3)).alias("moderate_negative"),
        F.count_if(r < -0.7).alias("strong_negative"),
    )
