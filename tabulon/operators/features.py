"""Feature engineering: date parts, encodings, skew repair, variance filter, scaling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.aggregate import distinct_counts
from tabulon.plans.longform import numeric_columns, ref, text_columns, time_columns
from tabulon.plans.stage import stage

ONE_HOT_LIMIT = 10


def date_features(df: DataFrame, columns=None, keep: bool = False) -> DataFrame:
    """Calendar parts, month on the circle and days since the column's minimum."""
    columns = list(columns or time_columns(df))
    if not columns:
        return df
    first = df.agg(*[F.min(ref(c)).alias(c) for c in columns]).first()
    parts = []
    for c in columns:
        angle = F.lit(2 * math.pi) * F.month(ref(c)) / 12
        parts += [
            F.year(ref(c)).alias(f"{c}_year"),
            F.month(ref(c)).alias(f"{c}_month"),
            F.quarter(ref(c)).alias(f"{c}_quarter"),
            F.weekday(ref(c)).alias(f"{c}_day_of_week"),
            F.dayofmonth(ref(c)).alias(f"{c}_day_of_month"),
            F.weekofyear(ref(c)).alias(f"{c}_week_of_year"),
            F.sin(angle).alias(f"{c}_month_sin"),
            F.cos(angle).alias(f"{c}_month_cos"),
            F.floor((F.unix_micros(ref(c).cast("timestamp")) - F.unix_micros(F.lit(first[c]).cast("timestamp"))) / 86_400_000_000)
            .cast("int")
            .alias(f"{c}_days_since_start"),
        ]
    rest = df.columns if keep else [c for c in df.columns if c not in columns]
    return df.select(*[ref(c) for c in rest], *parts)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): position of each distinct value in sorted order, without one big sort."""
    values = df.select(ref(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    ranged = stage(values.repartitionByRange("value").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("value"))
    return ranged.withColumn("k", inside).join(F.broadcast(offsets), "_part").select(
        "value", (F.col("before") + F.col("k") - 1).cast("int").alias("code")
    )


def encode_categorical(df: DataFrame, columns=None, limit: int = ONE_HOT_LIMIT) -> DataFrame:
    """Columns with few values become flags (first value dropped), others their sorted code."""
    columns = list(columns or text_columns(df))
    if not columns:
        return df
    sizes = {r["column"]: r["distinct"] for r in distinct_counts(df, columns).collect()}
    few = [c for c in columns if sizes[c] <= limit]
    values = {}
    if few:
        row = df.agg(*[F.array_sort(F.collect_set(ref(c).cast("string"))).alias(c) for c in few]).first()
        values = {c: row[c] for c in few}
    out = df.select(
        *[ref(c) for c in df.columns if c not in few],
        *[
            F.coalesce(ref(c).cast("string") == F.lit(v), F.lit(False)).alias(f"{c}_{v}")
            for c in few
            for v in values[c][1:]
        ],
    )
    for c in columns:
        if c in few:
            continue
        codes = label_codes(df, c).withColumnRenamed("value", "_value").withColumnRenamed("code", "_code")
        order = out.columns
        out = out.join(codes, ref(c).cast("string") == F.col("_value"), "left")
        out = out.select(*[F.col("_code").alias(c) if name == c else ref(name) for name in order])
    return out


def box_cox_lambda(df: DataFrame, value, rounds: int = 4) -> float:
    """Likelihood maximum of the Box-Cox power: each round is one scan over a finer grid."""
    centre, reach, points = 0.0, 4.0, 17
    shift = df.agg(F.avg(F.log(value))).first()[0]
    scaled = value / F.lit(math.exp(shift))  # the likelihood's maximum does not depend on scale
    for _ in range(rounds):
        grid = [centre - reach + 2 * reach * i / (points - 1) for i in range(points)]

        def power(lam, x=scaled):
            return F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)

        row = df.agg(*[F.var_pop(power(lam)).alias(f"v{i}") for i, lam in enumerate(grid)]).first()
        # With mean log 0 the Jacobian term vanishes and the smallest variance wins.
        scores = [row[i] if row[i] else float("inf") for i in range(points)]
        centre = grid[min(range(points), key=scores.__getitem__)]
        reach = 2 * reach / (points - 1)
    return centre


def box_cox(value, lam: float):
    return F.log(value) if abs(lam) < 1e-9 else (F.pow(value, F.lit(lam)) - 1) / F.lit(lam)


def repair_skew(df: DataFrame, columns=None, target: str | None = None, threshold: float = 1.0) -> DataFrame:
    """Columns with population skewness beyond the threshold: Box-Cox of x + 1 if all positive, else log(1 + |x|)."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    if not columns:
        return df
    row = df.agg(
        *[
            F.struct(F.skewness(ref(c)).alias("g1"), F.stddev(ref(c)).alias("s"), F.min(ref(c)).alias("lo")).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    exprs = {}
    for i, c in enumerate(columns):
        g1, s, low = row[i]["g1"], row[i]["s"], row[i]["lo"]
        if not s or g1 is None or abs(g1) <= threshold:
            continue
        x = ref(c).cast("double")
        exprs[c] = box_cox(x + 1, box_cox_lambda(df, x + 1)) if low > 0 else F.log1p(F.abs(x))
    return df.select(*[exprs[c].alias(c) if c in exprs else ref(c) for c in df.columns])


def low_variance_columns(df: DataFrame, columns=None, threshold: float = 0.01) -> list[str]:
    columns = list(columns or numeric_columns(df))
    if not columns:
        return []
    row = df.agg(*[F.var_pop(ref(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] is None or row[i] <= threshold]


def drop_low_variance(df: DataFrame, columns=None, threshold: float = 0.01) -> DataFrame:
    return df.drop(*low_variance_columns(df, columns, threshold))


def standard_scale(df: DataFrame, columns=None) -> DataFrame:
    """Zero mean and unit population spread; a constant column becomes 0."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return df
    row = df.agg(
        *[F.struct(F.avg(ref(c)).alias("m"), F.stddev_pop(ref(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(columns)]
    ).first()
    exprs = {c: (ref(c) - F.lit(row[i]["m"])) / F.lit(row[i]["s"] or 1.0) for i, c in enumerate(columns) if row[i]["m"] is not None}
    return df.select(*[exprs[c].alias(c) if c in exprs else ref(c) for c in df.columns])


def engineered_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """Encode, expand dates, repair skew, drop flat columns, scale; the target stays as it is."""
    out = stage(date_features(encode_categorical(df)))  # later steps scan it several times
    out = repair_skew(out, target=target)
    numbers = [c for c in numeric_columns(out) if c != target]
    out = drop_low_variance(out, numbers)
    return standard_scale(out, [c for c in numeric_columns(out) if c != target])
