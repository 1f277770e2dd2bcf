"""Cleaning of messy tables: names, null tokens, types, duplicates, missing values."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tabulon.errors import AnalysisError
from tabulon.functions import text as T
from tabulon.operators.aggregate import value_counts
from tabulon.plans.longform import identity, numeric_columns, per_column, ref, text_columns, time_columns, unpivot_text
from tabulon.plans.quantiles import exact_quantiles


SQL_NAME_LENGTH = 64


def sql_name(name: str, position: int) -> str:
    """ASCII letters, digits and underscores, not led by a digit, at most SQL_NAME_LENGTH long."""
    word = re.sub(r"\W", "_", name.strip(), flags=re.ASCII)
    if not word:
        return f"column_{position}"
    return (f"col_{word}" if word[0].isdigit() else word)[:SQL_NAME_LENGTH]


def snake_name(name: str, position: int) -> str:
    kept = re.sub(r"[^\w\s\-]", "", name.strip())
    joined = re.sub(r"[^a-zA-Z0-9_]", "", re.sub(r"[\s\-]+", "_", kept))
    clean = (f"_{joined}" if joined[:1].isdigit() else joined).lower()
    return clean if clean not in ("", "_") else f"column_{position}"


def stripped_name(name: str, position: int) -> str:
    return name.strip()


NAME_RULES = {"sql": sql_name, "snake": snake_name, "strip": stripped_name}


def sanitize_names(df: DataFrame, rule: str = "snake") -> DataFrame:
    """Rename columns by a rule; later columns that collide get a number."""
    taken: set[str] = set()
    names = []
    for i, old in enumerate(df.columns):
        base = NAME_RULES[rule](old, i)
        name, k = base, 1
        while name.lower() in taken:
            k += 1
            number = f"_{k}"
            name = (base[: SQL_NAME_LENGTH - len(number)] if rule == "sql" else base) + number
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Project the asked columns, ignoring absent ones."""
    return df.select(*[ref(c) for c in columns if c in df.columns])


def columns_by_type(df: DataFrame) -> dict[str, list[str]]:
    numeric, times = numeric_columns(df), time_columns(df)
    return {
        "numeric": numeric,
        "datetime": times,
        "categorical": [c for c in df.columns if c not in numeric and c not in times],
    }


def _replace(df: DataFrame, exprs: Mapping[str, object]) -> DataFrame:
    return df.select(*[exprs[c].alias(c) if c in exprs else ref(c) for c in df.columns])


def normalize_nulls(df: DataFrame, tokens: Sequence[str] = T.NULL_TOKENS, columns=None) -> DataFrame:
    """Null tokens in text columns and NaN or infinity in floating columns become null."""
    exprs = {c: T.null_if_token(ref(c), tokens) for c in columns or text_columns(df)}
    for f in df.schema:
        if isinstance(f.dataType, (DoubleType, FloatType)) and (columns is None or f.name in columns):
            exprs[f.name] = T.finite(ref(f.name))
    return _replace(df, exprs)


def trim_strings(df: DataFrame, columns=None) -> DataFrame:
    return _replace(df, {c: F.trim(ref(c)) for c in columns or text_columns(df)})


def _share(df: DataFrame, columns, parse, of_all: bool) -> dict[str, float]:
    """Share of parseable values per column, over all rows or over the non-null ones; one scan."""
    if not columns:
        return {}
    cells = []
    for i, c in enumerate(columns):
        base = F.count(F.lit(1)) if of_all else F.count(ref(c))
        cells.append(F.try_divide(F.count(parse(ref(c))), base).alias(f"s{i}"))
    row = df.agg(*cells).first()
    return {c: row[i] or 0.0 for i, c in enumerate(columns)}


def coerce_numeric(df: DataFrame, ratio: float = 0.9, columns=None, money: bool = True) -> DataFrame:
    """Text columns whose share of numbers reaches the ratio become double; others stay as they are."""
    columns = columns or text_columns(df)
    parse = T.parse_money if money else T.parse_number
    shares = _share(df, columns, parse, of_all=True)
    return _replace(df, {c: parse(ref(c)) for c in columns if shares[c] >= ratio})


def coerce_boolean(df: DataFrame, ratio: float = 1.0, columns=None) -> DataFrame:
    columns = columns or text_columns(df)
    shares = _share(df, columns, T.parse_boolean, of_all=True)
    return _replace(df, {c: T.parse_boolean(ref(c)) for c in columns if shares[c] >= ratio})


def coerce_datetime(df: DataFrame, ratio: float = 0.8, columns=None) -> DataFrame:
    columns = columns or text_columns(df)
    shares = _share(df, columns, T.parse_timestamp, of_all=True)
    return _replace(df, {c: T.parse_timestamp(ref(c)) for c in columns if shares[c] >= ratio})


def normalize_types(df: DataFrame) -> DataFrame:
    """Date, then boolean, then number: each text column takes the first type it qualifies for."""
    columns = text_columns(df)
    if not columns:
        return df
    kinds = {"date": (T.parse_timestamp, 0.8), "bool": (T.parse_boolean, 1.0), "number": (T.parse_money, 0.9)}
    cells = [
        F.try_divide(F.count(parse(ref(c))), F.count(F.lit(1))).alias(f"{kind}{i}")
        for i, c in enumerate(columns)
        for kind, (parse, _) in kinds.items()
    ]
    row = df.agg(*cells).first()
    exprs = {}
    for i, c in enumerate(columns):
        exprs[c] = F.trim(ref(c))
        for kind, (parse, ratio) in kinds.items():
            if (row[f"{kind}{i}"] or 0.0) >= ratio:
                exprs[c] = parse(ref(c))
                break
    return _replace(df, exprs)


def normalize(df: DataFrame) -> DataFrame:
    """Names, null tokens, types and trimming in one chain."""
    return normalize_types(normalize_nulls(sanitize_names(df), T.NULL_TOKENS_WIDE))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def complete_cases(df: DataFrame) -> DataFrame:
    """Rows without missing cells, or the input itself when no row is complete."""
    return complete_cases_or_all(df)[0]


def complete_cases_or_all(df: DataFrame) -> tuple[DataFrame, bool]:
    """`complete_cases` and whether it fell back to the input because no row is complete."""
    kept = df.na.drop()
    return (df, True) if kept.isEmpty() else (kept, False)


def impute(df: DataFrame, strategy: str = "mean", columns=None) -> DataFrame:
    """Fill missing cells with the column's mean, median or most frequent value."""
    fills: dict[str, object] = {}
    if strategy == "mean":
        columns = columns or numeric_columns(df)
        row = df.agg(*[F.avg(ref(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        fills = {c: row[i] for i, c in enumerate(columns)}
    elif strategy == "median":
        columns = columns or numeric_columns(df)
        fills = {c: q[0] for c, q in exact_quantiles(df, columns, (0.5,)).items()}
    elif strategy == "most_frequent":
        columns = columns or text_columns(df)
        fills = {r["column"]: r["value"] for r in value_counts(df, columns, top=1).collect()}
    else:
        raise AnalysisError(f"unknown strategy {strategy}")
    exprs = {}
    for c, v in fills.items():
        if v is not None:
            kind = "double" if strategy != "most_frequent" else df.schema[c].dataType
            exprs[c] = F.coalesce(ref(c).cast(kind), F.lit(v).cast(kind))
    return _replace(df, exprs)


def whitespace_counts(df: DataFrame, columns=None) -> DataFrame:
    """Cells with leading or trailing blanks per text column."""
    return per_column(
        df, columns or text_columns(df), lambda c: {"issue_count": F.count_if(F.trim(ref(c)) != ref(c))}
    )


def numeric_mix(df: DataFrame, columns=None) -> DataFrame:
    """Share of distinct values that read as numbers, and whether that share signals mixed content."""
    columns = columns or text_columns(df)
    value = F.col("value")
    reads = T.parse_number(value).isNotNull().cast("double").alias("reads")
    distinct = (
        unpivot_text(df, columns).filter(value.isNotNull()).select("column", identity(value).alias("value"), reads).distinct()
    )
    share = F.avg("reads")
    return distinct.groupBy("column").agg(F.round(share, 4).alias("numeric_ratio")).withColumn(
        "mixed", (F.col("numeric_ratio") > 0.2) & (F.col("numeric_ratio") < 0.8)
    )


# -- the chained stages ------------------------------------------------------------------------


def clean_stage(df: DataFrame) -> DataFrame:
    """Null tokens to null, then full duplicates out."""
    return drop_duplicate_rows(normalize_nulls(df, (*T.NULL_TOKENS, " ")))


def transform_stage(df: DataFrame) -> DataFrame:
    """Trimmed text; text columns with more than 0.8 numbers become double."""
    trimmed = trim_strings(df)
    columns = text_columns(trimmed)
    shares = _share(trimmed, columns, T.parse_number, of_all=True)
    return _replace(trimmed, {c: T.parse_number(ref(c)) for c in columns if shares[c] > 0.8})


def feature_stage(df: DataFrame) -> DataFrame:
    """Date parts of every time column, then row sum and mean over the numeric columns."""
    from tabulon.operators.aggregate import row_totals

    parts = []
    for c in time_columns(df):
        parts += [
            F.year(ref(c)).alias(f"{c}_year"),
            F.month(ref(c)).alias(f"{c}_month"),
            F.dayofmonth(ref(c)).alias(f"{c}_day"),
            F.weekday(ref(c)).alias(f"{c}_dayofweek"),
        ]
    out = df.select("*", *parts)
    return row_totals(out) if len(numeric_columns(out)) >= 2 else out


def clean_transform_features(df: DataFrame) -> DataFrame:
    return df.transform(clean_stage).transform(transform_stage).transform(feature_stage)


def stage_report(df: DataFrame) -> DataFrame:
    """One row per stage with true row, missing-cell and column counts before and after it."""
    cleaned = clean_stage(df)
    steps = [("input", df), ("cleaning", cleaned)]
    transformed = transform_stage(cleaned)
    steps += [("transformation", transformed), ("features", feature_stage(transformed))]
    out = None
    for i, (name, frame) in enumerate(steps):
        missing = sum((F.count_if(ref(c).isNull()) for c in frame.columns), F.lit(0))
        row = frame.agg(
            F.lit(i).alias("position"),
            F.lit(name).alias("stage"),
            F.count(F.lit(1)).alias("row_count"),
            F.lit(len(frame.columns)).alias("columns"),
            missing.alias("missing_cells"),
        )
        out = row if out is None else out.unionByName(row)
    return out
