"""Descriptive statistics on line items, parts, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from tabulon.functions import stats as S
from tabulon.operators import aggregate as A

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(columns: list[str], body: str) -> str:
    """UNION ALL of one SELECT per column; {c} is the column name."""
    return " UNION ALL ".join(body.replace("{c}", c) for c in columns)


@query("basic_statistics", each(LINE, """
SELECT '{c}' AS "column", count(*) AS total_rows, count({c}) AS non_null, count(DISTINCT {c}) AS "distinct",
       round(sum({c}), 2) AS sum, round(avg({c}), 4) AS mean, min({c}) AS min, max({c}) AS max FROM lineitem"""))
def _(t):
    return A.basic_statistics(t.lineitem, LINE)


@query("distinct_counts", each(["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"], """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct" FROM lineitem"""))
def _(t):
    return A.distinct_counts(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"])


@query("group_aggregate", """
SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_quantity), 4) AS avg_l_quantity,
       count(*) AS count, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    out = A.group_aggregate(t.lineitem, "l_returnflag", "l_quantity")
    return out.withColumn("sum_l_quantity", F.round("sum_l_quantity", 2)).withColumn(
        "avg_l_quantity", F.round("avg_l_quantity", 4)
    )


@query("top_group", """
SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders
GROUP BY 1 ORDER BY value DESC, label LIMIT 1""")
def _(t):
    return A.top_group(t.orders, "o_orderpriority", "o_totalprice")


@query("top_groups", """
SELECT p_brand AS label, round(sum(p_retailprice), 2) AS value FROM part GROUP BY 1 ORDER BY value DESC, label LIMIT 8""")
def _(t):
    return A.top_groups(t.part, "p_brand", "p_retailprice")


@query("group_distinct", """
SELECT l_returnflag, count(DISTINCT l_partkey) AS "distinct" FROM lineitem GROUP BY 1""")
def _(t):
    return A.group_distinct(t.lineitem, "l_returnflag", "l_partkey")


@query("value_counts", each(["p_brand", "p_type", "p_size"], """
SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count FROM part GROUP BY 2"""))
def _(t):
    return A.value_counts(t.part, ["p_brand", "p_type", "p_size"])


@query("value_counts_top", "SELECT * FROM (" + each(["p_brand", "p_name"], """
SELECT '{c}' AS "column", {c}::VARCHAR AS value, count(*) AS count,
       row_number() OVER (ORDER BY count(*) DESC, {c})::INTEGER AS rank FROM part GROUP BY 2, {c}""") + ") WHERE rank <= 5")
def _(t):
    return A.value_counts(t.part, ["p_brand", "p_name"], top=5)


@query("describe", each(LINE, """
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.5), 4) AS median,
       round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"""))
def _(t):
    return A.describe(t.lineitem, LINE)


@query("quantiles", each(["o_totalprice"], " UNION ALL ".join(
    f"SELECT '{{c}}' AS \"column\", {p}::DOUBLE AS prob, round(quantile_cont({{c}}, {p}), 6) AS value FROM orders"
    for p in (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99))))
def _(t):
    out = A.quantiles(t.orders, ["o_totalprice"], [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99])
    return out.withColumn("value", F.round("value", 6))


@query("modes", each(["l_quantity", "l_discount"], """
SELECT '{c}' AS "column", v AS mode, n AS mode_count, d AS "distinct" FROM (
  SELECT {c} AS v, count(*) AS n, count(*) OVER () AS d FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"""))
def _(t):
    return A.modes(t.lineitem, ["l_quantity", "l_discount"])


NUMERIC_PROFILE = """
SELECT '{c}' AS "column", count({c}) AS count, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean,
       round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.25), 4) AS q1,
       round(quantile_cont({c}, 0.75), 4) AS q3, round(stddev_pop({c}), 4) AS std_dev, round(var_pop({c}), 4) AS variance,
       (SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem)
        WHERE a <> b AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a))) AS outlier_count,
       CASE WHEN abs(skewness({c})) <= 0.5 THEN 'normal' WHEN skewness({c}) > 0 THEN 'right_skewed'
            ELSE 'left_skewed' END AS distribution,
       round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis,
       (SELECT round(exp(-k2 / 2), 4) FROM ({k2})) AS normality_p_value,
       round(stddev_pop({c}) / avg({c}), 4) AS coefficient_of_variation,
       (SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
       (SELECT count(*) AS n FROM lineitem GROUP BY {c} ORDER BY n DESC LIMIT 1) AS mode_count,
       count(DISTINCT {c}) AS "distinct"
FROM lineitem"""

# K^2 from raw moments, written out step by step.
K2_SQL = """
SELECT zs * zs + zk * zk AS k2 FROM (
  SELECT ln(y / al + sqrt(y * y / al / al + 1)) / sqrt(0.5 * ln(w2)) AS zs,
         (1 - 2 / (9 * a) - sign(de) * pow((1 - 2 / a) / abs(de), 1.0 / 3)) / sqrt(2 / (9 * a)) AS zk FROM (
    SELECT *, sqrt(2 / (w2 - 1)) AS al, 1 + x * sqrt(2 / (a - 4)) AS de FROM (
      SELECT *, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM (
        SELECT n, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
          sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
          (g2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
          6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb
        FROM (
          SELECT n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS g2 FROM (
            SELECT count(*)::DOUBLE AS n, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4
            FROM (SELECT {v}::DOUBLE AS v, (SELECT avg({v}) FROM {t}) AS m FROM {t} WHERE {v} IS NOT NULL))))))
)"""


def k2_sql(value: str, table: str) -> str:
    return K2_SQL.replace("{v}", value).replace("{t}", table)


@query("numeric_profile", each(LINE, NUMERIC_PROFILE.replace("{k2}", k2_sql("{c}", "lineitem"))))
def _(t):
    return A.numeric_profile(t.lineitem, LINE)


EDGE = "(lo + {j} * ((hi - lo) / 8))"
HISTOGRAM = """
SELECT '{c}' AS "column", bin, round(lo + bin * w, 4) AS low, round(CASE WHEN bin = 7 THEN hi ELSE lo + (bin + 1) * w END, 4) AS high,
       (SELECT count(*) FROM lineitem WHERE {c} >= lo + bin * w AND CASE WHEN bin = 7 THEN {c} <= hi ELSE {c} < lo + (bin + 1) * w END) AS n
FROM (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 8 AS w FROM lineitem), (SELECT unnest(range(8))::INTEGER AS bin)"""


@query("histogram", each(LINE, HISTOGRAM))
def _(t):
    return A.histogram(t.lineitem, LINE)


@query("entropy", each(["p_brand", "p_type"], """
SELECT '{c}' AS "column", round(-sum(p * log2(p + 1e-10)), 4) AS entropy, count(*) AS "distinct" FROM (
  SELECT count(*) / (SELECT count({c}) FROM part) AS p FROM part WHERE {c} IS NOT NULL GROUP BY {c})"""))
def _(t):
    return A.entropy(t.part, ["p_brand", "p_type"])


@query("text_lengths", each(["text", "lang", "source"], """
SELECT '{c}' AS "column", round(avg(length({c})), 2) AS average_length, min(length({c}))::INTEGER AS min_length,
       max(length({c}))::INTEGER AS max_length FROM documents"""))
def _(t):
    return A.text_lengths(t.documents, ["text", "lang", "source"])


@query("boolean_counts", each(["quality", "toxic"], """
SELECT '{c}' AS "column", count(*) FILTER ({c} = 1) AS true_count, count(*) FILTER ({c} = 0) AS false_count,
       round(avg({c}) * 100, 2) AS true_percentage, round((1 - avg({c})) * 100, 2) AS false_percentage FROM labels"""))
def _(t):
    return A.boolean_counts(t.labels, ["quality", "toxic"])


@query("time_profile", """
SELECT min(ts) AS min, max(ts) AS max, floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000)::BIGINT AS range_days
FROM events""")
def _(t):
    return A.time_profile(t.events, "ts")


@query("time_distribution", """
SELECT part, value::INTEGER AS value, count(*) AS count FROM (
  SELECT 'year' AS part, year(o_orderdate) AS value FROM orders UNION ALL
  SELECT 'month', month(o_orderdate) FROM orders UNION ALL
  SELECT 'weekday', isodow(o_orderdate) - 1 FROM orders) GROUP BY 1, 2""")
def _(t):
    return A.time_distribution(t.orders, "o_orderdate")


HOLES = """SELECT l_orderkey, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS quantity,
 CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag, l_discount AS discount FROM lineitem"""


def holes(t):
    return t.lineitem.selectExpr(
        "l_orderkey",
        "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS quantity",
        "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag",
        "l_discount AS discount",
    )


@query("missing_counts", each(["l_orderkey", "quantity", "flag", "discount"], f"""
SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS missing,
       round(100.0 * (count(*) - count({{c}})) / count(*), 2) AS missing_pct FROM ({HOLES})"""))
def _(t):
    return A.missing_counts(holes(t))


@query("completeness", f"""
SELECT round(100 - avg(p), 2) AS completeness FROM (
  SELECT round(100.0 * (count(*) - count(quantity)) / count(*), 2) AS p FROM ({HOLES}) UNION ALL
  SELECT round(100.0 * (count(*) - count(flag)) / count(*), 2) FROM ({HOLES}))""")
def _(t):
    return A.completeness(holes(t), ["quantity", "flag"])


@query("duplicate_rows", f"""
SELECT count(*) AS total_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT quantity, flag, discount FROM ({HOLES}))) AS duplicate_rows,
  round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT quantity, flag, discount FROM ({HOLES})))) * 100 / count(*), 2) AS duplicate_pct
FROM ({HOLES})""")
def _(t):
    return A.duplicate_rows(holes(t).select("quantity", "flag", "discount"))


@query("duplicate_values", each(["flag", "discount"], f"""
SELECT '{{c}}' AS "column", sum(n - 1)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM ({HOLES}) GROUP BY {{c}})"""))
def _(t):
    return A.duplicate_values(holes(t), ["flag", "discount"])


@query("cardinality_labels", each(["p_partkey", "p_name", "p_brand", "p_size"], """
SELECT '{c}' AS "column", count(DISTINCT {c}) AS "distinct",
  CASE WHEN count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) / count(*) <= 0.1 THEN 'low'
       WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count(*) <= 0.5 THEN 'medium' ELSE 'high' END AS cardinality,
  CASE WHEN count(DISTINCT {c}) / count(*) < 0.1 THEN 'low' WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'medium' ELSE 'high' END AS by_ratio
FROM part"""))
def _(t):
    rows = t.part.count()
    d = F.col("distinct")
    return A.distinct_counts(t.part, ["p_partkey", "p_name", "p_brand", "p_size"]).select(
        "column", "distinct", S.cardinality_label(d, F.lit(rows)).alias("cardinality"),
        S.cardinality_ratio_label(d, F.lit(rows)).alias("by_ratio"),
    )


@query("multi_sum_by_month", """
SELECT strftime(l_shipdate, '%Y-%m') AS label, round(sum(l_quantity), 2) AS l_quantity,
       round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1""")
def _(t):
    return A.multi_sum(t.lineitem, F.date_format("l_shipdate", "yyyy-MM"), ["l_quantity", "l_extendedprice"])


@query("group_means", """
SELECT l_linestatus, round(avg(l_quantity), 4) AS mean_l_quantity, round(avg(l_tax), 4) AS mean_l_tax, count(*) AS size
FROM lineitem GROUP BY 1""")
def _(t):
    return A.group_means(t.lineitem, "l_linestatus", ["l_quantity", "l_tax"])


@query("status_breakdown", each(["o_orderstatus", "o_orderpriority"], """
SELECT '{c}' AS "column", {c} AS value, count(*) AS count FROM orders GROUP BY 2"""))
def _(t):
    return A.breakdown(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("row_totals", f"""
SELECT *, round(coalesce(l_orderkey, 0) + coalesce(quantity, 0) + coalesce(discount, 0), 4) AS _row_sum,
  round((coalesce(l_orderkey, 0) + coalesce(quantity, 0) + coalesce(discount, 0)) /
   (CASE WHEN quantity IS NULL THEN 2 ELSE 3 END), 4) AS _row_mean FROM ({HOLES})""")
def _(t):
    return A.row_totals(holes(t)).withColumn("_row_sum", F.round("_row_sum", 4)).withColumn(
        "_row_mean", F.round("_row_mean", 4)
    )
