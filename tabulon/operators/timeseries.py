"""Analysis of many time series at once.

regularize turns raw rows into one row per (series, period) with a map-side combined sum. After
it a series is bounded by the calendar (87,600 hours in ten years), so the ordered windows below
work per series whatever the number of raw rows behind one series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.stats import frequency_label, round4
from tabulon.operators.kpi import volatility
from tabulon.plans.longform import ref
from tabulon.plans.quantiles import quantile_exprs
from tabulon.plans.stage import stage

GRAINS = ("year", "quarter", "month", "week", "day", "hour")


def regularize(df: DataFrame, ts: str, value: str, grain: str = "day", series: str | None = None) -> DataFrame:
    """(series, ts, value): the value summed per series and period."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    key = ref(series).cast("string") if series else F.lit("all")
    kept = df.select(
        key.alias("series"), F.date_trunc(grain, ref(ts)).alias("ts"), ref(value).cast("double").alias("value")
    ).na.drop()
    return kept.groupBy("series", "ts").agg(F.sum("value").alias("value"))


def _ordered() -> Window:
    return Window.partitionBy("series").orderBy("ts")


def _last(descending: bool = True) -> Window:
    return Window.partitionBy("series").orderBy(F.desc("ts") if descending else F.asc("ts"))


def ordinal(points: DataFrame) -> DataFrame:
    """x = 0, 1, ... in time order per series."""
    return points.withColumn("x", F.row_number().over(_ordered()) - 1)


def rolling_mean(points: DataFrame) -> DataFrame:
    """Mean of the last w = min(7, n // 3) points, null until w points exist."""
    size = F.count(F.lit(1)).over(Window.partitionBy("series"))
    recent = F.collect_list("value").over(_ordered().rowsBetween(-6, 0))
    w = F.greatest(F.lit(1), F.least(F.lit(7), F.floor(size / 3))).cast("int")
    numbered = points.select("*", w.alias("window"), recent.alias("recent"))
    tail = F.slice("recent", F.size("recent") - F.col("window") + 1, F.col("window"))
    mean = F.aggregate(tail, F.lit(0.0), lambda a, b: a + b) / F.col("window")
    full = F.size("recent") >= F.col("window")
    return numbered.select(
        "series", "ts", "value", "window", F.when(full, mean).alias("rolling_mean")
    )


def recent_means(points: DataFrame) -> DataFrame:
    """Mean of the last w and of the last 2w points per series."""
    size = F.count(F.lit(1)).over(Window.partitionBy("series"))
    back = F.row_number().over(_last())
    w = F.greatest(F.lit(1), F.least(F.lit(7), F.floor(size / 3)))
    return (
        points.select("series", "ts", "value", back.alias("back"), w.alias("window"), size.alias("n"))
        .groupBy("series")
        .agg(
            F.max("n").alias("points"),
            F.max("window").alias("window"),
            F.max_by("value", "ts").alias("last_value"),
            F.avg("value").alias("average"),
            F.avg(F.when(F.col("back") <= F.col("window"), F.col("value"))).alias("mean_w"),
            F.avg(F.when(F.col("back") <= 2 * F.col("window"), F.col("value"))).alias("mean_2w"),
        )
    )


def moving_average_forecast(points: DataFrame, periods: int = 5, min_points: int = 10) -> DataFrame:
    """Drift forecast: the last-w mean plus (mean_w - mean_2w) / w at each step."""
    base = recent_means(points).filter(F.col("points") >= min_points)
    step = (F.col("mean_w") - F.col("mean_2w")) / F.col("window")
    return base.select(
        "series", "window", "last_value", step.alias("trend"), "mean_w",
        F.when(F.col("points") < 50, "low").otherwise("medium").alias("confidence"),
        F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"),
    ).select(
        "series", "step", "window", "confidence",
        round4(F.col("trend")).alias("trend"),
        round4(F.col("mean_w") + F.col("trend") * F.col("step")).alias("forecast"),
    )


def distinct_gaps(df: DataFrame, ts: str, series: str | None = None) -> DataFrame:
    """(series, ts, gap_days) between neighbouring distinct timestamps of the raw rows.

    The ordered window works inside one hour of one series; the first row of an hour takes its
    predecessor from the table of hours, so that no task holds a whole raw series.
    """
    key = ref(series).cast("string") if series else F.lit("all")
    stamps = df.select(key.alias("series"), ref(ts).cast("timestamp").alias("ts")).na.drop().distinct()
    stamps = stamps.withColumn("hour", F.date_trunc("hour", "ts"))
    hours = stamps.groupBy("series", "hour").agg(F.max("ts").alias("last"))
    before = F.lag("last").over(Window.partitionBy("series").orderBy("hour"))
    carried = hours.select("series", "hour", before.alias("carried"))
    inside = F.lag("ts").over(Window.partitionBy("series", "hour").orderBy("ts"))
    joined = stamps.withColumn("previous", inside).join(carried, ["series", "hour"])
    previous = F.coalesce("previous", "carried")
    gap = (F.unix_micros("ts") - F.unix_micros(previous)) / 86_400_000_000
    return joined.select("series", "ts", gap.alias("gap_days"))


def median_gap(df: DataFrame, ts: str) -> DataFrame:
    """Exact median gap of the whole table in days and its frequency label."""
    gaps = stage(distinct_gaps(df, ts).select("gap_days"))  # every quantile pass reads it
    value = quantile_exprs(gaps, {"gap": F.col("gap_days")}, (0.5,))["gap"][0]
    n = gaps.agg(F.count(F.lit(1)).alias("timestamps"))
    median = F.lit(value).cast("double")
    return n.select(
        "timestamps", round4(median).alias("median_gap_days"),
        F.when(F.col("timestamps") >= 3, frequency_label(median)).alias("frequency"),
    )


def series_frequency(df: DataFrame, ts: str, series: str) -> DataFrame:
    """Median gap and frequency label per series.

    Gaps of a series add up to its span, so it has at most sqrt(2 span) distinct ones; they are
    counted first and the percentile buffer holds those counts only.
    """
    counted = (
        distinct_gaps(df, ts, series)
        .groupBy("series", "gap_days")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("series")
        .agg((F.sum("n")).alias("timestamps"), F.expr("percentile(gap_days, 0.5, n)").alias("median"))
    )
    return counted.select(
        "series", "timestamps", round4(F.col("median")).alias("median_gap_days"),
        F.when(F.col("timestamps") >= 3, frequency_label(F.col("median"))).alias("frequency"),
    )


def gap_check(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Points, duplicate timestamps and gaps beyond one day, after sorting."""
    rows = df.agg(
        F.count(ref(value)).alias("data_points"),
        F.count(ref(ts)).alias("stamps"),
        F.min(ref(ts)).alias("first"),
        F.max(ref(ts)).alias("last"),
    )
    gaps = distinct_gaps(df, ts).agg(
        F.struct(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("gap_days") > 1).alias("gaps")).alias("g")
    ).scalar()
    return rows.select(
        "data_points", "first", "last", (F.col("stamps") - gaps["distinct"]).alias("duplicates"), gaps["gaps"].alias("gaps")
    )


def first_last(points: DataFrame) -> DataFrame:
    return points.groupBy("series").agg(
        F.min_by("value", "ts").alias("first_value"), F.max_by("value", "ts").alias("last_value")
    )


def growth(points: DataFrame) -> DataFrame:
    """Percent change from the first to the last period, per series of monthly sums."""
    ends = points.groupBy("series").agg(
        F.count(F.lit(1)).alias("periods"), F.min_by("value", "ts").alias("a"), F.max_by("value", "ts").alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return ends.select(
        "series", "periods",
        F.when((F.col("periods") >= 2) & (a != 0), round4((b - a) / F.abs(a) * 100)).alias("growth_pct"),
    )


def seasonality(df: DataFrame, ts: str, value: str, series: str | None = None, min_rows: int = 6) -> DataFrame:
    """Population std of the month-of-year means over their mean, from raw rows."""
    key = ref(series).cast("string") if series else F.lit("all")
    kept = df.select(key.alias("series"), F.month(ref(ts)).alias("month"), ref(value).alias("v")).na.drop()
    months = kept.groupBy("series", "month").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    mean = F.avg("mean")
    return months.groupBy("series").agg(
        F.sum("n").alias("rows"),
        F.when((F.sum("n") >= min_rows) & (mean != 0), round4(F.stddev_pop("mean") / mean)).alias("seasonality_index"),
    )


def volatility_index(df: DataFrame, value: str, series: str | None = None) -> DataFrame:
    key = ref(series).cast("string") if series else F.lit("all")
    return df.groupBy(key.alias("series")).agg(round4(volatility(ref(value))).alias("volatility_index"))


def trend_strength(points: DataFrame) -> DataFrame:
    """Correlation of the ordinal with the value, per series."""
    return ordinal(points).groupBy("series").agg(
        F.coalesce(round4(F.corr("x", "value")), F.lit(0.0)).alias("trend_strength")
    )


def autocorrelation(points: DataFrame, min_points: int = 6) -> DataFrame:
    """Lag-1 autocorrelation per series."""
    mean = F.avg("value").over(Window.partitionBy("series"))
    previous = F.lag("value").over(_ordered())
    d = points.select("series", (F.col("value") - mean).alias("d"), (previous - mean).alias("p"))
    return d.groupBy("series").agg(
        F.when(
            F.count(F.lit(1)) >= min_points, round4(F.try_divide(F.sum(F.col("d") * F.col("p")), F.sum(F.col("d") * F.col("d"))))
        ).alias("lag_1_autocorrelation")
    )


def linear_fit(points: DataFrame) -> DataFrame:
    """Slope, intercept, R squared and spreads on the ordinal axis, per series."""
    y, x = F.col("value"), F.col("x")
    r2 = F.regr_r2(y, x)
    n = F.count(F.lit(1))
    return ordinal(points).groupBy("series").agg(
        n.alias("points"),
        F.max("ts").alias("last_ts"),
        F.min("ts").alias("first_ts"),
        F.max_by("value", "ts").alias("last_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.avg("value").alias("avg_value"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        r2.alias("r2"),
        F.stddev_pop("value").alias("spread"),
        F.sqrt(F.greatest(F.lit(0.0), F.regr_syy(y, x) * (1 - r2) / n)).alias("residual_spread"),
    )


def linear_trend(points: DataFrame) -> DataFrame:
    return (
        linear_fit(points)
        .filter(F.col("points") >= 2)
        .select(
            "series",
            F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("trend"),
            round4(F.col("slope")).alias("slope"),
            F.col("points").alias("data_points"),
            round4(F.col("min_value")).alias("min_value"),
            round4(F.col("max_value")).alias("max_value"),
            round4(F.col("avg_value")).alias("avg_value"),
        )
    )


def future(last, frequency, step):
    """The step-th date after `last` for a frequency label; unknown labels step by days."""
    months = F.when(frequency == "monthly", 1).when(frequency == "quarterly", 3).when(frequency == "yearly", 12)
    days = F.when(frequency == "weekly", 7).otherwise(1)
    return F.when(months.isNotNull(), F.add_months(F.to_date(last), (months * step).cast("int"))).otherwise(
        F.date_add(F.to_date(last), (days * step).cast("int"))
    )


def period_label(points: DataFrame) -> DataFrame:
    """Frequency label per regularised series, from the median distance of its periods."""
    gap = F.datediff("ts", F.lag("ts").over(_ordered()))
    return points.select("series", gap.alias("gap")).groupBy("series").agg(
        frequency_label(F.percentile("gap", 0.5)).alias("frequency")
    )


def linear_forecast(points: DataFrame, periods: int = 5, bounds: str = "mean") -> DataFrame:
    """Extrapolated line with dates; bounds are 1.96 spreads of the values or of the residuals."""
    fit = linear_fit(points).filter(F.col("points") >= 3).join(period_label(points), "series")
    width = 1.96 * F.col("spread" if bounds == "mean" else "residual_spread")
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    predicted = F.col("intercept") + F.col("slope") * (F.col("points") - 1 + F.col("step"))
    return steps.select(
        "series",
        "step",
        future(F.col("last_ts"), F.col("frequency"), F.col("step")).alias("date"),
        round4(F.col("slope")).alias("slope"),
        round4(F.col("intercept")).alias("intercept"),
        round4(F.col("r2")).alias("r_squared"),
        round4(predicted).alias("predicted"),
        round4(predicted - width).alias("lower"),
        round4(predicted + width).alias("upper"),
    )


def forecast_trend(forecast: DataFrame, value: str = "predicted") -> DataFrame:
    """Label per series from the first to the last forecast: beyond 5 percent up or down, else flat."""
    ends = forecast.groupBy("series").agg(
        F.min_by(value, "step").alias("a"), F.max_by(value, "step").alias("b"), F.count(F.lit(1)).alias("n")
    )
    pct = F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.abs("a") * 100).otherwise(0.0)
    return ends.select(
        "series",
        F.when((F.col("n") >= 2) & (pct > 5), "increasing").when((F.col("n") >= 2) & (pct < -5), "decreasing").otherwise("flat").alias("trend"),
    )


def step_trend(points: DataFrame, forecast: DataFrame, value: str = "predicted") -> DataFrame:
    """Direction and percent from the last actual value to the first forecast."""
    first = forecast.filter(F.col("step") == 1).select("series", F.col(value).alias("first_forecast"))
    last = first_last(points).select("series", "last_value")
    a, b = F.col("last_value"), F.col("first_forecast")
    return last.join(first, "series").select(
        "series",
        F.when(b > a, "increasing").when(b < a, "decreasing").otherwise("flat").alias("trend"),
        F.when(a != 0, round4((b - a) / a * 100)).alias("predicted_change_pct"),
    )


def seasonal_period(points: DataFrame) -> DataFrame:
    """Season length by frequency label and whether a year of points is present."""
    n = points.groupBy("series").agg(F.count(F.lit(1)).alias("points"))
    f = F.col("frequency")
    return period_label(points).join(n, "series").select(
        "series", "frequency", "points",
        F.when(f == "daily", 7).when(f == "monthly", 12).otherwise(1).alias("seasonal_period"),
        F.when(f == "daily", 7).when(f == "weekly", 4).when(f == "monthly", 12).when(f == "quarterly", 4)
        .when(f == "yearly", 2).otherwise(7).alias("smoothing_period"),
        (F.col("points") >= 365).alias("yearly"),
    )


def backtest_linear(points: DataFrame, share: float = 0.8) -> DataFrame:
    """Error on the last points of a line fitted to the first ones, per series."""
    size = F.count(F.lit(1)).over(Window.partitionBy("series"))
    split = ordinal(points).withColumn("train", F.floor(size * share))
    y, x = F.col("value"), F.col("x")
    early = F.col("x") < F.col("train")
    fit = split.groupBy("series").agg(
        F.regr_slope(F.when(early, y), F.when(early, x)).alias("slope"),
        F.regr_intercept(F.when(early, y), F.when(early, x)).alias("intercept"),
    )
    error = y - (F.col("intercept") + F.col("slope") * x)
    return (
        split.filter(~early)
        .join(fit, "series")
        .groupBy("series")
        .agg(
            F.count(F.lit(1)).alias("test_points"),
            round4(F.sqrt(F.avg(error * error))).alias("rmse"),
            round4(F.avg(F.abs(error))).alias("mae"),
        )
    )
