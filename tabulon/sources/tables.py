"""Table sink, pages, schema rows and the append-only event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tabulon.operators.clean import sanitize_names
from tabulon.plans.longform import ref


def storable(df: DataFrame) -> DataFrame:
    """Safe column names; nested values as JSON text."""
    safe = sanitize_names(df, "sql")
    return safe.select(
        *[
            F.to_json(ref(f.name)).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else ref(f.name)
            for f in safe.schema
        ]
    )


def append_rows(df: DataFrame, path: str) -> None:
    storable(df).write.mode("append").parquet(path)


def save_table(df: DataFrame, name: str, mode: str = "append") -> None:
    storable(df).write.mode(mode).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def table_page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in the order of a key, so that pages neither overlap nor miss rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def schema_rows(df: DataFrame) -> DataFrame:
    """(position, name, type) of the columns."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def event_rows(df: DataFrame, name: str, source: str, payload: Sequence[str]) -> DataFrame:
    """Event records with the payload columns as JSON text."""
    rest = [ref(c) for c in df.columns if c not in payload and c != name]
    return df.select(
        *rest,
        ref(name).alias("event_name"),
        F.lit(source).alias("source"),
        F.to_json(F.struct(*[ref(c) for c in payload])).alias("payload"),
    )
