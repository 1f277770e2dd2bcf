"""Descriptive aggregates over whole tables and groups."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import (
    distribution_label,
    kurtosis_corrected,
    normality_k2,
    normality_p,
    round4,
    skew_corrected,
)
from tabulon.plans.longform import identity, numeric_columns, per_column, ref, unpivot_text
from tabulon.plans.quantiles import Ranked, column_summaries, exact_quantiles, numeric
from tabulon.plans.slots import edge_counts, joint_counts

FUNCS = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def basic_statistics(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows, non-null count, distinct count, sum, mean, min and max per numeric column."""
    columns = list(columns)
    stats = per_column(
        df,
        columns,
        lambda c: {
            "total_rows": F.count(F.lit(1)),
            "non_null": F.count(ref(c)),
            "sum": F.sum(ref(c).cast("double")),
            "mean": F.avg(ref(c)),
            "min": F.min(ref(c)).cast("double"),
            "max": F.max(ref(c)).cast("double"),
        },
    )
    return stats.join(F.broadcast(distinct_counts(df, columns)), "column").select(
        "column",
        "total_rows",
        "non_null",
        "distinct",
        F.round("sum", 2).alias("sum"),
        round4(F.col("mean")).alias("mean"),
        "min",
        "max",
    )


def distinct_counts(df: DataFrame, columns: Iterable[str], approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column; the exact form shuffles each distinct value once."""
    columns = list(columns)
    if approximate:
        return per_column(df, columns, lambda c: {"distinct": F.approx_count_distinct(ref(c))})
    return (
        unpivot_text(df, columns)
        .groupBy("column", identity(F.col("value")).alias("value"))
        .agg(F.lit(1).alias("one"))
        .groupBy("column")
        .agg(F.count("value").alias("distinct"))
    )


def group_aggregate(
    df: DataFrame, key: str, value: str, funcs: Sequence[str] = ("SUM", "AVG", "COUNT", "MIN", "MAX")
) -> DataFrame:
    """One group key, the asked aggregates of one value column."""
    exprs = []
    for name in funcs:
        if name == "COUNT":
            exprs.append(F.count(F.lit(1)).alias("count"))
        else:
            exprs.append(FUNCS[name](ref(value)).alias(f"{name.lower()}_{value}"))
    return df.groupBy(ref(key)).agg(*exprs)


def group_sum(df: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    kept = df.select(ref(key), ref(value)).na.drop()
    return kept.groupBy(ref(key)).agg(F.sum(ref(value)).alias(name))


def top_groups(df: DataFrame, key: str, value: str, n: int = 8) -> DataFrame:
    """Groups with the largest sums, ties by key."""
    return (
        group_sum(df, key, value)
        .select(ref(key).cast("string").alias("label"), F.round("total", 2).alias("value"))
        .orderBy(F.desc("value"), "label")
        .limit(n)
    )


def top_group(df: DataFrame, key: str, value: str) -> DataFrame:
    return top_groups(df, key, value, 1)


def group_distinct(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per group: pairs are combined first, so a hot group is spread over tasks."""
    return (
        df.select(ref(key), ref(value))
        .na.drop()
        .distinct()
        .groupBy(ref(key))
        .agg(F.count(F.lit(1)).alias("distinct"))
    )


def value_counts(df: DataFrame, columns: Iterable[str], top: int | None = None) -> DataFrame:
    """(column, value, count) for all columns in one scan; top keeps the n most frequent per column."""
    counts = (
        unpivot_text(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if top is None:
        return counts
    order = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def describe(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, max, median and quartiles per numeric column."""
    columns = list(columns or numeric_columns(df))
    found = column_summaries(df, columns, (0.25, 0.5, 0.75), {"mean": F.avg, "std": F.stddev})
    rows = []
    for c in columns:
        r = found[c]
        low, high = (None, None) if r.n == 0 else (float(r.low), float(r.high))
        std = r.extra["std"] if r.n > 1 else 0.0
        rows.append((c, r.n, r.extra["mean"], std, low, high, r.quantile(0.5), r.quantile(0.25), r.quantile(0.75)))
    schema = (
        "column string, count long, mean double, std double, min double, max double, "
        "median double, q25 double, q75 double"
    )
    out = df.sparkSession.createDataFrame(rows, schema)
    return out.select(
        "column", "count", "min", "max", *[round4(F.col(c)).alias(c) for c in ("mean", "std", "median", "q25", "q75")]
    )


def quantiles(df: DataFrame, columns: Iterable[str], probs: Sequence[float]) -> DataFrame:
    """(column, prob, value) rows of exact linear-interpolated quantiles."""
    columns = list(columns)
    q = exact_quantiles(df, columns, probs)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, q[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def modes(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Most frequent value per numeric column, the smallest on ties, with its count."""
    pairs = [F.struct(F.lit(c).alias("column"), numeric(df, c).cast("double").alias("value")) for c in columns]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(F.max(F.struct("n", (-F.col("value")).alias("neg"))).alias("best"), F.count(F.lit(1)).alias("distinct"))
        .select("column", (-F.col("best.neg")).alias("mode"), F.col("best.n").alias("mode_count"), "distinct")
    )


def fences(df: DataFrame, columns: Iterable[str], k: float = 1.5) -> dict[str, tuple[float, float, float, float]]:
    """{column: (q1, q3, lower, upper)} of the interquartile fences."""
    columns = list(columns)
    out = {}
    for c, (q1, q3) in (exact_quantiles(df, columns, (0.25, 0.75)) if columns else {}).items():
        if q1 is not None:
            out[c] = (q1, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def numeric_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Full numeric statistics per column: moments, quartiles, mode, outliers, shape, normality."""
    columns = list(columns or numeric_columns(df))
    extras = {"mean": F.avg, "std": F.stddev_pop, "g1": F.skewness, "g2": F.kurtosis}
    found = column_summaries(df, columns, (0.25, 0.5, 0.75), extras)
    far = outlier_counts(df, {c: fence(r) for c, r in found.items()})
    rows = [
        (
            c, r.n, *((float(r.low), float(r.high)) if r.n else (None, None)),
            *[r.quantile(p) for p in (0.25, 0.5, 0.75)], *[r.extra[e] for e in extras], far[c],
        )
        for c, r in found.items()
    ]
    base = df.sparkSession.createDataFrame(
        rows,
        "column string, count long, min double, max double, q1 double, median double, q3 double, _mean double, "
        "_std double, _g1 double, _g2 double, outlier_count long",
    )
    mean, std, g1, g2 = F.col("_mean"), F.col("_std"), F.col("_g1"), F.col("_g2")
    n = F.col("count")
    skew = F.coalesce(skew_corrected(g1, n), F.lit(0.0))
    stats = base.select(
        "column", "count", "min", "max",
        *[round4(F.col(c)).alias(c) for c in ("q1", "median", "q3")],
        "outlier_count",
        round4(mean).alias("mean"),
        round4(std).alias("std_dev"),
        round4(std * std).alias("variance"),
        distribution_label(skew).alias("distribution"),
        round4(skew).alias("skewness"),
        round4(F.coalesce(kurtosis_corrected(g2, n), F.lit(0.0))).alias("kurtosis"),
        F.when(n >= 8, round4(normality_p(normality_k2(g1, g2, n)))).alias("normality_p_value"),
        F.when((n > 1) & (mean != 0), round4(std / mean)).otherwise(0.0).alias("coefficient_of_variation"),
    )
    return stats.join(F.broadcast(modes(df, columns)), "column", "left")


def fence(r: Ranked, k: float = 1.5) -> tuple[float, float] | None:
    """Interquartile fences of a summary; none for an empty column or one without spread."""
    q1, q3 = r.quantile(0.25), r.quantile(0.75)
    return None if q1 is None or q1 == q3 else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float] | None]) -> dict[str, int]:
    """Rows outside each column's bounds; a column without bounds has none."""
    slots = {}
    for c, pair in bounds.items():
        if pair:
            x = numeric(df, c)
            slots[c] = F.when((x < F.lit(pair[0])) | (x > F.lit(pair[1])), 1).otherwise(0)
    counts = joint_counts(df, slots) if slots else {}
    return {c: counts.get(c, {}).get(1, 0) for c in bounds}


def histogram(df: DataFrame, columns: Iterable[str], max_bins: int = 8, min_bins: int = 3) -> DataFrame:
    """Equal-width bins, last one closed, empty bins kept; a constant column is widened by 0.5."""
    columns = list(columns)
    head = df.agg(
        *[
            F.struct(
                F.min(numeric(df, c)).alias("lo"),
                F.max(numeric(df, c)).alias("hi"),
                F.approx_count_distinct(numeric(df, c)).alias("about"),
            ).alias(f"h{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    few = [c for i, c in enumerate(columns) if 0 < head[i]["about"] <= 4 * max_bins]
    exact = {r["column"]: r["distinct"] for r in distinct_counts(df, few).collect()} if few else {}
    edges = {}
    for i, c in enumerate(columns):
        if head[i]["lo"] is None:
            continue
        low, high = float(head[i]["lo"]), float(head[i]["hi"])
        if low == high:
            low, high = low - 0.5, high + 0.5
        bins = min(max_bins, max(min_bins, exact.get(c, max_bins)))
        edges[c] = [low + j * ((high - low) / bins) for j in range(bins)] + [high]

    values = df.select(*[numeric(df, c).cast("double").alias(c) for c in edges])
    counts = edge_counts(values, {c: edges[c][1:-1] for c in edges})
    rows = [
        (c, j, round(edges[c][j], 4), round(edges[c][j + 1], 4), counts[c].get(j, 0))
        for c in edges
        for j in range(len(edges[c]) - 1)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, bin int, low double, high double, n long")


def entropy(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Base-2 entropy of the value shares per column."""
    columns = list(columns)
    totals = df.agg(*[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    n = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (c, float(totals[i]))])
    share = F.col("count") / n[F.col("column")]
    counts = (
        unpivot_text(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", identity(F.col("value")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        counts.groupBy("column")
        .agg(
            round4(-F.sum(share * F.log2(share + 1e-10))).alias("entropy"),
            F.count(F.lit(1)).alias("distinct"),
        )
    )


def text_lengths(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return per_column(
        df,
        columns,
        lambda c: {
            "average_length": F.round(F.avg(F.length(ref(c))), 2),
            "min_length": F.min(F.length(ref(c))),
            "max_length": F.max(F.length(ref(c))),
        },
    )


def boolean_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """True and false counts and percentages of columns holding boolean words."""
    from tabulon.functions.text import FALSE_SHORT, TRUE_SHORT, parse_boolean

    def measures(c):
        flag = parse_boolean(ref(c).cast("string"), TRUE_SHORT, FALSE_SHORT)
        return {
            "true_count": F.count_if(flag),
            "false_count": F.count_if(~flag),
            "true_percentage": F.round(F.avg(flag.cast("double")) * 100, 2),
            "false_percentage": F.round((1 - F.avg(flag.cast("double"))) * 100, 2),
        }

    return per_column(df, columns, measures)


def time_profile(df: DataFrame, column: str) -> DataFrame:
    """Earliest, latest and whole days between them."""
    from tabulon.operators.rfm import whole_days

    t = ref(column).cast("timestamp")
    return df.agg(F.min(t).alias("min"), F.max(t).alias("max"), whole_days(F.max(t), F.min(t)).alias("range_days"))


def time_distribution(df: DataFrame, column: str) -> DataFrame:
    """Row counts by year, month and weekday (Monday is 0) in one scan."""
    t = ref(column)
    parts = [("year", F.year(t)), ("month", F.month(t)), ("weekday", F.weekday(t))]
    cells = [F.struct(F.lit(name).alias("part"), e.alias("value")) for name, e in parts]
    return (
        df.filter(t.isNotNull())
        .select(F.explode(F.array(*cells)).alias("p"))
        .groupBy("p.part", "p.value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def missing_counts(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing cells and percentage per column."""
    return per_column(
        df,
        columns or df.columns,
        lambda c: {
            "missing": F.count_if(ref(c).isNull()),
            "missing_pct": F.coalesce(F.round(F.avg(ref(c).isNull().cast("double")) * 100, 2), F.lit(0.0)),
        },
    )


def completeness(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """100 minus the mean missing percentage of a column set."""
    return missing_counts(df, columns).agg(F.round(100 - F.avg("missing_pct"), 2).alias("completeness"))


def row_digest(df: DataFrame) -> Column:
    """64-bit digest of a row that tells apart which cells are null."""
    nulls = F.concat(*[F.when(ref(c).isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(nulls, *[ref(c) for c in df.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Total rows and rows beyond the first of each set of equal rows (null equals null).

    Only 8-byte digests are shuffled for the whole table. Rows whose digest occurs once are
    distinct for certain; the others are compared in full, so the count is exact.
    """
    digests = df.select(row_digest(df).alias("_digest")).groupBy("_digest").agg(F.count(F.lit(1)).alias("n"))
    total = digests.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"))
    repeated = digests.filter(F.col("n") > 1).select("_digest")
    copies = (
        df.withColumn("_digest", row_digest(df))
        .join(repeated, "_digest", "left_semi")
        .groupBy(*[ref(c) for c in df.columns])
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))
    )
    return total.select("total_rows", copies.scalar().alias("duplicate_rows")).select(
        "total_rows",
        "duplicate_rows",
        F.when(F.col("total_rows") > 0, F.round(F.col("duplicate_rows") * 100 / F.col("total_rows"), 2))
        .otherwise(0.0)
        .alias("duplicate_pct"),
    )


def duplicate_values(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Values beyond the first of each equal set per column; nulls count as equal."""
    return (
        unpivot_text(df, columns)
        .groupBy("column", identity(F.col("value")).alias("value"))
        .agg((F.count(F.lit(1)) - 1).alias("extra"))
        .groupBy("column")
        .agg(F.sum("extra").alias("duplicate_count"))
    )


def multi_sum(df: DataFrame, key: Column, columns: Iterable[str], name: str = "label") -> DataFrame:
    """Sums of several columns by one key, rows with any missing part left out."""
    columns = list(columns)
    kept = df.select(key.alias(name), *[ref(c) for c in columns]).na.drop()
    return kept.groupBy(name).agg(*[F.round(F.sum(ref(c)), 2).alias(c) for c in columns])


def group_means(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    return df.groupBy(ref(key)).agg(
        *[round4(F.avg(ref(c))).alias(f"mean_{c}") for c in columns], F.count(F.lit(1)).alias("size")
    )


def breakdown(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Counts by value for several status-like columns."""
    return value_counts(df, columns)


def row_totals(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Row-wise sum and mean over numeric columns, nulls skipped."""
    columns = list(columns or numeric_columns(df))
    total = sum((F.coalesce(ref(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    filled = sum((ref(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return df.select("*", total.alias("_row_sum"), F.try_divide(total, filled).alias("_row_mean"))
