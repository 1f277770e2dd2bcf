"""A parsed question as a DataFrame: filters, one group key, aggregates, order and limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.operators.aggregate import FUNCS
from tabulon.operators.relational import in_year
from tabulon.plans.longform import ref

OPERATORS = {
    "=": lambda c, v: c == F.lit(v),
    "is": lambda c, v: c == F.lit(v),
    "!=": lambda c, v: c != F.lit(v),
    ">": lambda c, v: c > F.lit(v),
    ">=": lambda c, v: c >= F.lit(v),
    "<": lambda c, v: c < F.lit(v),
    "<=": lambda c, v: c <= F.lit(v),
    "greater than": lambda c, v: c > F.lit(v),
    "above": lambda c, v: c > F.lit(v),
    "over": lambda c, v: c > F.lit(v),
    "less than": lambda c, v: c < F.lit(v),
    "below": lambda c, v: c < F.lit(v),
    "under": lambda c, v: c < F.lit(v),
    "in": lambda c, v: c.isin(*v),
    "year": lambda c, v: in_year(c, v),
    "not null": lambda c, v: c.isNotNull(),
}


@dataclass
class Spec:
    select: Sequence[str] = ()
    aggregations: Sequence[tuple[str, str | None]] = ()  # (SUM, column) ... (COUNT, None)
    group_by: str | None = None
    order_by: str | None = None  # a column, an aggregate alias, or "aggregate" for the last one
    order_dir: str = "DESC"
    limit: int | None = 10
    filters: Sequence[tuple[str, str, object]] = ()
    tie: Sequence[str] = field(default_factory=tuple)


def _alias(func: str, column: str | None) -> str:
    return "count" if func == "COUNT" else f"{func.lower()}_{column}"


def _aggregate(func: str, column: str | None) -> Column:
    if func == "COUNT":
        return F.count(F.lit(1)).alias("count")
    if func not in FUNCS:
        raise AnalysisError(f"unknown aggregate {func}")
    return FUNCS[func](ref(column)).alias(_alias(func, column))


def run_spec(df: DataFrame, spec: Spec | Mapping) -> DataFrame:
    spec = spec if isinstance(spec, Spec) else Spec(**spec)
    for column, operator, value in spec.filters:
        df = df.filter(OPERATORS[operator](ref(column), value))
    if spec.aggregations:
        aggs = [_aggregate(f, c) for f, c in spec.aggregations]
        out = df.groupBy(ref(spec.group_by)).agg(*aggs) if spec.group_by else df.agg(*aggs)
    else:
        out = df.select(*[ref(c) for c in spec.select]) if spec.select else df
    order = _alias(*spec.aggregations[-1]) if spec.order_by == "aggregate" and spec.aggregations else spec.order_by
    if order is None and spec.group_by:
        order = spec.group_by
    if order:
        first = F.desc(f"`{order}`") if spec.order_dir.upper() == "DESC" else F.asc(f"`{order}`")
        ties = spec.tie or ([spec.group_by] if spec.group_by and order != spec.group_by else [])
        out = out.orderBy(first, *[ref(t) for t in ties])
    return out.limit(spec.limit) if spec.limit is not None else out


def top_rows_spec(column: str, tie: Sequence[str]) -> Spec:
    return Spec(order_by=column, limit=10, tie=tie)


def count_spec() -> Spec:
    return Spec(aggregations=[("COUNT", None)], limit=None)


def sum_by_spec(key: str, value: str, limit: int | None = None) -> Spec:
    return Spec(aggregations=[("SUM", value)], group_by=key, order_by="aggregate", limit=limit)


def year_spec(date: str, year: int) -> Spec:
    return Spec(filters=[(date, "year", year)], limit=None)


def category_totals_spec(key: str, value: str) -> Spec:
    return sum_by_spec(key, value, 20)
