"""Average ranks of a column over the whole table.

Distinct values with their counts are range-partitioned and staged, each partition adds up its own
counts, and the partition totals (one row per partition) give the offsets. No task sees more than
one range, and there are no ties left that could pile up in one range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.plans.stage import stage


def average_ranks(values: DataFrame, column: str, weight: str) -> DataFrame:
    """(column, rank) for each distinct value, tied rows sharing their mean rank; weight counts rows."""
    counts = values.groupBy(column).agg(F.sum(weight).alias("n"))
    ranged = stage(counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("n").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_less", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "_part")
        .select(column, (F.col("_before") + F.col("_less") + (F.col("n") + 1) / 2).alias("rank"))
    )


def row_ranks(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """rows with `rank`, 1 to the number of rows, by column and then keys; the keys spread ties over ranges."""
    ranged = stage(rows.repartitionByRange(column, *keys).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(column, *keys)
    return (
        ranged.withColumn("_at", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .select(*rows.columns, (F.col("_before") + F.col("_at")).alias("rank"))
    )
