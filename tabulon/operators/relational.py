"""Joins, set operations, ordering, paging and sampling of rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.plans.longform import ref, unpivot_text
from tabulon.plans.sample import smallest_hashes
from tabulon.plans.stage import stage


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join; the optimizer broadcasts a side it knows to be small and splits skewed partitions."""
    return left.join(right, left[left_key] == right[right_key], how)


def owned_or_shared(df: DataFrame, owned: Column, shared: DataFrame, key: str, shared_key: str) -> DataFrame:
    """Rows that satisfy a condition or whose key occurs in another table, each once."""
    keys = shared.select(ref(shared_key).alias("_shared_key")).distinct()
    flagged = df.join(keys, ref(key) == F.col("_shared_key"), "left")
    return flagged.filter(owned | F.col("_shared_key").isNotNull()).drop("_shared_key")


def in_ids(df: DataFrame, key: str, ids: DataFrame, id_column: str) -> DataFrame:
    return df.join(ids.select(ref(id_column).alias("_id")), ref(key) == F.col("_id"), "left_semi")


def aligned_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both columns are present, as (x, y)."""
    return df.select(ref(x).alias("x"), ref(y).alias("y")).na.drop()


def in_year(c: Column, year: int) -> Column:
    """A range instead of year(c) = n, so that the scan can skip files and row groups."""
    return (c >= F.lit(f"{year}-01-01").cast("timestamp")) & (c < F.lit(f"{year + 1}-01-01").cast("timestamp"))


def page(df: DataFrame, sort: str, tie: Sequence[str], limit: int, offset: int, descending: bool = False) -> DataFrame:
    """One page in a fixed order with the total row count."""
    first = F.desc(sort) if descending else F.asc(sort)
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(first, *[F.asc(k) for k in tie]).offset(offset).limit(limit).withColumn("total", total)


def top_rows(df: DataFrame, sort: str, tie: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(sort), *tie).limit(n)


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def missing_grid(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    """Which cells are missing in the first n rows of an order."""
    return first_rows(df, order, n).select(
        *[ref(c) for c in order], *[ref(c).isNull().alias(f"{c}_missing") for c in df.columns]
    )


def union_inputs(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(ref(column)).distinct()


def filter_options(df: DataFrame, columns: Iterable[str], most: int = 20) -> DataFrame:
    """Sorted distinct values of the columns that have few of them.

    Only the first most + 1 values of a column are gathered, which is enough to tell.
    """
    order = Window.partitionBy("column").orderBy("value")
    return (
        unpivot_text(df, columns)
        .filter(F.col("value").isNotNull())
        .distinct()
        .withColumn("k", F.row_number().over(order))
        .filter(F.col("k") <= most + 1)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list("value")).alias("options"))
        .filter(F.size("options") <= most)
    )


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Carry the last non-null value forward within a source (a sheet or an order).

    Rows are range-partitioned by group and order and staged, so a large source spreads over many
    tasks. Each range fills itself; what enters it comes from a table with one row per range and
    group.
    """
    keys = [*group, *order]
    ranged = stage(df.repartitionByRange(*[ref(k) for k in keys]).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    row = F.struct(*[ref(k) for k in order])
    ends = ranged.groupBy("_part", *group).agg(
        *[F.max_by(ref(c), F.when(ref(c).isNotNull(), row)).alias(f"_end_{c}") for c in columns]
    )
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        F.col("_part"),
        *[ref(g) for g in group],
        *[F.last(F.col(f"_end_{c}"), ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns],
    )
    met = F.col("r._part") == F.col("c._part")
    for g in group:
        met = met & F.col(f"r.`{g}`").eqNullSafe(F.col(f"c.`{g}`"))
    filled = ranged.select(
        "*", *[F.last(ref(c), ignorenulls=True).over(inside).alias(f"_own_{c}") for c in columns]
    )
    return filled.alias("r").join(carried.alias("c"), met).select(
        *[
            F.coalesce(f"r._own_{c}", f"c._in_{c}").alias(c) if c in columns else F.col(f"r.`{c}`")
            for c in df.columns
        ]
    )


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Rows and percentage per group; the total is one scalar, not a window over all groups."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(ref(key)).agg(F.count(F.lit(1)).alias("size")).withColumn(
        "share_pct", F.round(F.col("size") * 100.0 / total, 4)
    )


def hash_sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """n rows with the smallest key hash: repeatable under any partitioning."""
    return smallest_hashes(df, list(key), n, seed)


def hash_split(df: DataFrame, key: Sequence[str], train_pct: int = 80, seed: int = 42):
    """(train, test) by key hash: repeatable under any partitioning, without a shuffle."""
    bucket = F.pmod(F.xxhash64(*[ref(k) for k in key], F.lit(seed)), F.lit(100))
    return df.filter(bucket < train_pct), df.filter(bucket >= train_pct)


