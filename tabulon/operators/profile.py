"""Type inference by value shares and the full table profile, one row per column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tabulon.functions import text as T
from tabulon.functions.stats import cardinality_label, cardinality_ratio_label
from tabulon.operators.aggregate import (
    boolean_counts,
    distinct_counts,
    entropy,
    numeric_profile,
    text_lengths,
)
from tabulon.operators.rfm import whole_days
from tabulon.plans.longform import numeric_columns, per_column, ref, text_columns, time_columns
from tabulon.plans.spread import spread
from tabulon.plans.stage import discard, stage

# Words in column names that decide a type or subtype.
DATE_WORDS = ("date", "time", "timestamp", "month", "year", "quarter", "week", "day")
CLOCK_WORDS = ("time", "timestamp")
PERCENT_WORDS = ("percent", "percentage", "rate", "ratio", "margin")
MONEY_WORDS = ("revenue", "sales", "amount", "price", "cost", "salary", "income", "expense")
PLACE_WORDS = ("country", "state", "city", "region", "lat", "lon", "latitude", "longitude")
CODE_WORDS = ("id", "code", "sku")
AUDIT_WORDS = ("date", "time", "timestamp", "created", "updated")
SHORT_TEXT = 40


@dataclass
class Shares:
    """What share of a column's values reads as each type."""

    name: str
    kind: str  # text, number, time or flag, from the schema
    rows: int
    filled: int
    words: int
    numbers: int
    whole: int
    times: int
    length: float | None

    def of_filled(self, n: int) -> float:
        return n / self.filled if self.filled else 0.0

    def of_rows(self, n: int) -> float:
        return n / self.rows if self.rows else 0.0

    def named(self, words) -> bool:
        return any(w in self.name.lower() for w in words)


def _cells(df: DataFrame) -> DataFrame:
    """Each cell next to what it reads as, parsed once, under names by position: c the cell, n its number and t its
    time. Number columns have no n, columns that aren't text no t."""
    numbers, texts = set(numeric_columns(df)), set(text_columns(df))
    out = []
    for i, name in enumerate(df.columns):
        out.append(ref(name).alias(f"c{i}"))
        if name not in numbers:
            out.append(T.parse_number(ref(name).cast("string")).alias(f"n{i}"))
        if name in texts:
            out.append(T.parse_timestamp(ref(name)).alias(f"t{i}"))
    return df.select(*out)


def _staged_cells(df: DataFrame) -> DataFrame:
    """The cells as a table, made by all cores even if the input is one file; what parquet may not hold is text."""
    plain = {*numeric_columns(df), *time_columns(df), *text_columns(df)}
    other = [f"c{i}" for i, name in enumerate(df.columns) if name not in plain]
    cells = _cells(spread(df))
    return stage(cells.withColumns({c: F.col(c).cast("string") for c in other}) if other else cells)


def _shares(df: DataFrame, cells: DataFrame) -> list[Shares]:
    """All shares of all columns in one scan of the table's cells."""
    numbers, times, texts = set(numeric_columns(df)), set(time_columns(df)), set(text_columns(df))
    out = []
    for i, name in enumerate(df.columns):
        c = F.col(f"c{i}")
        text = F.trim(c.cast("string"))
        value = c.cast("double") if name in numbers else F.col(f"n{i}")
        out.append(
            F.struct(
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("filled"),
                F.count_if(F.lower(text).isin(*T.TRUE_SHORT, *T.FALSE_SHORT)).alias("words"),
                F.count(value).alias("numbers"),
                F.count_if(F.abs(value - F.rint(value)) <= 1e-8).alias("whole"),
                F.count(F.col(f"t{i}") if name in texts else c if name in times else F.lit(None)).alias("times"),
                F.avg(F.length(text)).alias("length"),
            ).alias(f"c{i}")
        )
    row = cells.agg(*out).first()
    shares = []
    for i, f in enumerate(df.schema):
        kind = (
            "number" if f.name in numbers else "time" if f.name in times
            else "flag" if isinstance(f.dataType, BooleanType) else "text"
        )
        shares.append(Shares(f.name, kind, *row[i]))
    return shares


def _number_subtype(s: Shares) -> str:
    if s.named(PERCENT_WORDS):
        return "percentage"
    if s.named(MONEY_WORDS):
        return "currency"
    return "integer" if s.whole == s.numbers else "float"


def upload_rule(s: Shares) -> tuple[str, str]:
    """Boolean, then number, then date, then place by name, else category."""
    if not s.filled:
        return "categorical", "unknown"
    if s.kind == "time":
        return "temporal", "datetime" if s.named(CLOCK_WORDS) else "date"
    if s.words == s.filled:
        return "boolean", "binary"
    if s.of_filled(s.numbers) >= 0.9:
        return "numerical", _number_subtype(s)
    if s.of_filled(s.times) >= 0.8 or s.named(DATE_WORDS):
        return "temporal", "datetime" if s.named(CLOCK_WORDS) else "date"
    if s.named(PLACE_WORDS):
        return "geolocation", "region"
    if s.named(CODE_WORDS):
        return "categorical", "code"
    return "categorical", "category" if (s.length or 0) < SHORT_TEXT else "text"


def profiler_rule(s: Shares) -> tuple[str, str]:
    """Native date, then number over all rows, then boolean words, then date by name and share."""
    if s.kind == "time":
        return "temporal", "datetime"
    if s.of_rows(s.numbers) > 0.8:
        return "numerical", "integer" if s.whole == s.numbers else "float"
    if s.kind in ("text", "flag") and s.of_rows(s.words) > 0.9:
        return "boolean", "binary"
    if s.named(AUDIT_WORDS) and s.of_rows(s.times) > 0.5:
        return "temporal", "datetime"
    return "categorical", "category"


RULES = {"upload": upload_rule, "profiler": profiler_rule}


def _decide(df: DataFrame, cells: DataFrame, rules: str):
    shares = _shares(df, cells)
    return shares, {s.name: RULES[rules](s) for s in shares}


def infer_types(df: DataFrame, rules: str = "upload") -> DataFrame:
    """(column, inferred_type, subtype) under a rule set."""
    shares, kinds = _decide(df, _cells(df), rules)
    rows = [(s.name, *kinds[s.name]) for s in shares]
    return df.sparkSession.createDataFrame(rows, "column string, inferred_type string, subtype string")


def _typed(df: DataFrame, cells: DataFrame, kinds) -> DataFrame:
    texts, numbers = set(text_columns(df)), set(numeric_columns(df))
    out = []
    for i, c in enumerate(df.columns):
        kind = kinds[c][0]
        if kind == "numerical" and c not in numbers:
            cell = F.col(f"n{i}")
        elif kind == "temporal" and c in texts:
            cell = F.col(f"t{i}")
        elif kind in ("categorical", "geolocation", "boolean"):
            cell = F.col(f"c{i}").cast("string")
        else:
            cell = F.col(f"c{i}")
        out.append(cell.alias(c))
    return cells.select(*out)


def typed(df: DataFrame, rules: str = "upload") -> DataFrame:
    """The table with its columns cast to their inferred types."""
    cells = _cells(df)
    return _typed(df, cells, _decide(df, cells, rules)[1])


NUMBER_STATS = (
    "min double, max double, q1 double, median double, q3 double, outlier_count long, mean double, std_dev double, "
    "variance double, distribution string, skewness double, kurtosis double, normality_p_value double, "
    "coefficient_of_variation double, mode double"
)
TEXT_STATS = "average_length double, min_length int, max_length int, entropy double"
FLAG_STATS = "true_count long, false_count long, true_percentage double, false_percentage double"
TIME_STATS = "first_time timestamp, last_time timestamp, range_days long"


def _numbers(frame: DataFrame, columns: list[str]) -> DataFrame:
    return numeric_profile(frame, columns).drop("count", "distinct", "mode_count")


def _texts(frame: DataFrame, columns: list[str]) -> DataFrame:
    return text_lengths(frame, columns).join(F.broadcast(entropy(frame, columns).drop("distinct")), "column", "left")


def _times(frame: DataFrame, columns: list[str]) -> DataFrame:
    def measures(c):
        t = ref(c).cast("timestamp")
        return {"first_time": F.min(t), "last_time": F.max(t), "range_days": whole_days(F.max(t), F.min(t))}

    return per_column(frame, columns, measures)


def profile_columns(df: DataFrame, rules: str = "upload") -> DataFrame:
    """Type, missing share, distinct count, cardinality and the statistics of the type, per column.

    Every pass reads a staged table of parsed cells, which goes once the few result rows are there.
    """
    cells = _staged_cells(df)
    shares, kinds = _decide(df, cells, rules)
    frame = _typed(df, cells, kinds)
    raw = cells.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])

    def of(*names):
        return [c for c in df.columns if kinds[c][0] in names]

    rows = []
    for i, s in enumerate(shares):
        empty = s.rows - s.filled
        rows.append((i, s.name, *kinds[s.name], s.rows, empty, round(100 * s.of_rows(empty), 2)))
    base = df.sparkSession.createDataFrame(
        rows,
        "position int, column string, inferred_type string, subtype string, total_count long, null_count long, "
        "missing_pct double",
    )
    out = base.join(F.broadcast(distinct_counts(raw, df.columns).withColumnRenamed("distinct", "unique_count")), "column", "left")
    label = cardinality_label if rules == "upload" else cardinality_ratio_label
    out = out.withColumn("cardinality", label(F.col("unique_count"), F.col("total_count")))
    parts = [
        (of("numerical"), _numbers, NUMBER_STATS),
        (of("categorical", "geolocation"), _texts, TEXT_STATS),
        (of("boolean"), boolean_counts, FLAG_STATS),
        (of("temporal"), _times, TIME_STATS),
    ]
    for columns, make, schema in parts:
        if columns:
            out = out.join(F.broadcast(make(frame, columns)), "column", "left")
        else:
            for name, kind in (p.split() for p in schema.split(", ")):
                out = out.withColumn(name, F.lit(None).cast(kind))
    found = stage(out.coalesce(1))
    discard(cells)
    return found
