"""Business KPIs and chart series. Every operator takes its columns explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import FALSE_SHORT, TRUE_SHORT, parse_number
from tabulon.operators.aggregate import group_sum, multi_sum, top_group, top_groups
from tabulon.plans.longform import numeric_columns, ref


def kpi_rows(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(kpi, value) rows from one aggregate."""
    cells = [F.struct(F.lit(k).alias("kpi"), v.cast("double").alias("value")) for k, v in measures.items()]
    return df.agg(F.array(*cells).alias("rows")).select(F.inline("rows")).withColumn("value", F.round("value", 4))


def rate(c: Column) -> Column:
    """A rate in percent from numbers (shares up to 1 are scaled) or from boolean words."""
    text = c.cast("string")
    word = F.lower(F.trim(text))
    number = parse_number(text)
    numeric = F.try_divide(F.count(number), F.count(c)) >= 0.9
    mean = F.avg(number)
    words = F.count_if(word.isin(*TRUE_SHORT, *FALSE_SHORT)) > 0
    return F.when(numeric, F.when(mean <= 1, mean * 100).otherwise(mean)).when(
        words, F.avg(F.when(c.isNotNull(), word.isin(*TRUE_SHORT).cast("double"))) * 100
    )


def month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly_sum(df: DataFrame, date: str, value: str) -> DataFrame:
    kept = df.select(month(ref(date)).alias("label"), ref(value).alias("v")).na.drop()
    return kept.groupBy("label").agg(F.round(F.sum("v"), 2).alias("value"))


def growth(df: DataFrame, date: str, value: str) -> DataFrame:
    """Percent change from the first month's sum to the last month's; null when undefined."""
    months = monthly_sum(df, date, value)
    ends = months.agg(
        F.count(F.lit(1)).alias("months"),
        F.min_by("value", "label").alias("first_value"),
        F.max_by("value", "label").alias("last_value"),
    )
    a, b = F.col("first_value"), F.col("last_value")
    return ends.withColumn(
        "growth_pct", F.when((F.col("months") >= 2) & (a != 0), F.round((b - a) / F.abs(a) * 100, 4))
    )


def sales_kpis(df: DataFrame, revenue: str, date: str, product: str, orders: str | None = None) -> DataFrame:
    """One row: revenue, order count, average order value, top product and growth."""
    count = F.sum(ref(orders)) if orders else F.count(F.lit(1))
    base = df.agg(
        F.round(F.sum(ref(revenue)), 2).alias("total_revenue"),
        count.cast("long").alias("order_count"),
        F.round(F.try_divide(F.sum(ref(revenue)), count), 4).alias("average_order_value"),
    )
    best = top_group(df, product, revenue).select(F.struct("label", "value").alias("t")).scalar()
    change = growth(df, date, revenue).select("growth_pct").scalar()
    return base.select(
        "*",
        best["label"].alias("top_product"),
        best["value"].alias("top_product_revenue"),
        change.alias("growth_pct"),
    )


def hr_kpis(df: DataFrame, salary: str, employee: str, attrition: str) -> DataFrame:
    return kpi_rows(
        df,
        {
            "total_payroll": F.sum(ref(salary)),
            "average_salary": F.avg(ref(salary)),
            "headcount": F.count_distinct(ref(employee)),
            "attrition_rate": rate(ref(attrition)),
        },
    )


def finance_kpis(df: DataFrame, income: str, expense: str) -> DataFrame:
    total_in, total_out = F.coalesce(F.sum(ref(income)), F.lit(0.0)), F.coalesce(F.sum(ref(expense)), F.lit(0.0))
    return kpi_rows(
        df, {"total_income": total_in, "total_expenses": total_out, "net_profit": total_in - total_out}
    )


def budget_vs_actual(df: DataFrame, date: str, budget: str, actual: str) -> DataFrame:
    return multi_sum(df, month(ref(date)), [budget, actual])


def operations_kpis(df: DataFrame, efficiency: str, throughput: str, response: str, compliance: str) -> DataFrame:
    return kpi_rows(
        df,
        {
            "efficiency": F.avg(ref(efficiency)),
            "throughput": F.sum(ref(throughput)),
            "response_time": F.avg(ref(response)),
            "compliance_rate": rate(ref(compliance)),
        },
    )


def customer_kpis(df: DataFrame, customer: str, churn: str, lifetime_value: str) -> DataFrame:
    return kpi_rows(
        df,
        {
            "total_customers": F.count_distinct(ref(customer)),
            "churn_rate": rate(ref(churn)),
            "lifetime_value": F.avg(ref(lifetime_value)),
        },
    )


def volatility(c: Column) -> Column:
    mean = F.avg(c)
    return F.when((F.count(c) >= 2) & (mean != 0), F.stddev_pop(c) / F.abs(mean) * 100)


def inventory_kpis(df: DataFrame, stock: str) -> DataFrame:
    return kpi_rows(df, {"total_inventory": F.sum(ref(stock)), "inventory_volatility": volatility(ref(stock))})


def generic_kpis(df: DataFrame, columns: int | None = None, rows: int | None = None) -> DataFrame:
    """Row count, then sum and mean of the numeric columns; columns and rows cut the lists if given."""
    cells = [("total_records", F.count(F.lit(1)).cast("double"))]
    for c in numeric_columns(df)[:columns]:
        cells += [(f"sum_{c}", F.sum(ref(c)).cast("double")), (f"avg_{c}", F.avg(ref(c)))]
    packed = [
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("kpi"), F.round(v, 2).alias("value"))
        for i, (k, v) in enumerate(cells[:rows])
    ]
    return df.agg(F.array(*packed).alias("rows")).select(F.inline("rows"))


def first_number_kpis(df: DataFrame) -> DataFrame:
    """Sum, mean and maximum of the first numeric column, and the row count."""
    measures = {}
    numbers = numeric_columns(df)
    if numbers:
        x = ref(numbers[0])
        measures = {numbers[0]: F.sum(x), f"{numbers[0]}_avg": F.avg(x), f"{numbers[0]}_max": F.max(x)}
    return kpi_rows(df, {**measures, "row_count": F.count(F.lit(1))})


# -- chart series ------------------------------------------------------------------------------


def category_share(df: DataFrame, key: str, n: int = 8, distinct_of: str | None = None) -> DataFrame:
    """Most frequent values, by rows or by distinct values of another column; ties by label."""
    label = ref(key).cast("string").alias("label")
    if distinct_of:
        pairs = df.select(label, ref(distinct_of).cast("string").alias("d")).na.drop().distinct()
        counts = pairs.groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    else:
        counts = df.select(label).na.drop().groupBy("label").agg(F.count(F.lit(1)).alias("value"))
    return counts.orderBy(F.desc("value"), "label").limit(n)


def scatter(df: DataFrame, x: str, y: str, order: list[str], n: int = 50) -> DataFrame:
    kept = df.filter(ref(x).isNotNull() & ref(y).isNotNull()).orderBy(*order).limit(n)
    return kept.select(*order, F.round(ref(x), 2).alias("label"), F.round(ref(y), 2).alias("value"))


def stacked_months(df: DataFrame, date: str, columns: list[str]) -> DataFrame:
    return multi_sum(df, month(ref(date)), columns)


def segment_leaders(df: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    return top_groups(df, key, value, n)


def bar_rows(df: DataFrame, category: str, value: str, order: list[str], n: int | None = None) -> DataFrame:
    """Rows, or the first n of them, as (name, value) with nulls as 0."""
    return _first(df, order, n).select(
        *order,
        ref(category).cast("string").alias("name"),
        F.coalesce(ref(value).cast("double"), F.lit(0.0)).alias("value"),
    )


def _first(df: DataFrame, order: list[str], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def line_rows(df: DataFrame, order: list[str], columns: list[str], n: int | None = None) -> DataFrame:
    """Rows, or the first n of them, with the columns as numbers."""
    return _first(df, order, n).select(*order, *[ref(c).cast("double").alias(c) for c in columns])


def pie_slices(df: DataFrame, category: str, value: str) -> DataFrame:
    """Sums of all categories, which make up the whole."""
    return group_sum(df, category, value).select(
        ref(category).cast("string").alias("name"), F.round("total", 2).alias("value")
    )
