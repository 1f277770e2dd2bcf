"""One wide aggregate for many columns, returned as one row per column."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, TimestampType, DateType, TimestampNTZType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType))]


def ref(name: str) -> Column:
    return F.col(f"`{name}`")


def per_column(
    df: DataFrame,
    columns: Iterable[str],
    measures: Callable[[str], Mapping[str, Column]],
    derive: Callable[[], Mapping[str, Column]] | None = None,
) -> DataFrame:
    """Aggregate every column in one scan and turn the single wide row into one row per column.

    derive adds expressions over the measures; they run on the few result rows, which keeps the
    generated code of the wide aggregate small.
    """
    rows = [
        F.struct(F.lit(c).alias("column"), *[e.alias(n) for n, e in measures(c).items()]) for c in columns
    ]
    out = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    if derive is not None:
        out = out.select("*", *[e.alias(n) for n, e in derive().items()])
    return out


def unpivot_text(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value) rows of the given columns as text, one scan."""
    pairs = [F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


LONG_TEXT = 64


def identity(value: Column) -> Column:
    """A short stand-in for a text when only equality matters: long texts become their SHA-256.

    Counting distinct or repeated documents then shuffles 64 characters each, not whole texts.
    """
    return F.when(F.length(value) <= LONG_TEXT, value).otherwise(F.sha2(value.cast("binary"), 256))


def freeze(result: DataFrame) -> DataFrame:
    """A small result (a row per model, cohort or column) computed now, so that later uses cost no rescan."""
    return result.sparkSession.createDataFrame(result.collect(), result.schema)
