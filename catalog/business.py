"""RFM, cohorts, KPIs and chart series on the order tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.base import query
from tabulon.operators import cohort, correlation, insights, kpi, rfm, spec

RFM_RANK_SQL = """
WITH snap AS (SELECT max(o_orderdate) + INTERVAL 1 DAY AS s FROM orders),
m AS (SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT s FROM snap)) AS recency,
             count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary
      FROM orders GROUP BY o_custkey),
r AS (SELECT *, count(*) OVER () AS n,
             row_number() OVER (ORDER BY recency, o_custkey) AS rr,
             row_number() OVER (ORDER BY frequency, o_custkey) AS rf,
             row_number() OVER (ORDER BY monetary, o_custkey) AS rm FROM m),
q AS (SELECT *,
        5 - (1 + (rr > 1+(n-1)*.25)::INT + (rr > 1+(n-1)*.5)::INT + (rr > 1+(n-1)*.75)::INT) AS r_score,
        1 + (rf > 1+(n-1)*.25)::INT + (rf > 1+(n-1)*.5)::INT + (rf > 1+(n-1)*.75)::INT AS f_score,
        1 + (rm > 1+(n-1)*.25)::INT + (rm > 1+(n-1)*.5)::INT + (rm > 1+(n-1)*.75)::INT AS m_score FROM r)
SELECT o_custkey, recency, frequency, monetary, r_score, f_score, m_score,
       CASE WHEN r_score>=4 AND f_score>=4 AND m_score>=4 THEN 'champions' WHEN r_score>=3 AND f_score>=3 THEN 'loyal'
            WHEN r_score=4 AND f_score<=2 THEN 'new_customers' WHEN r_score<=2 AND f_score>=3 THEN 'at_risk'
            ELSE 'potential_loyalists' END AS segment FROM q
"""

RFM_EDGES_SQL = """
WITH m AS (SELECT o_custkey, date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS recency,
             count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary
      FROM orders GROUP BY o_custkey),
e AS (SELECT quantile_cont(recency, [.25,.5,.75]) AS er, quantile_cont(frequency, [.25,.5,.75]) AS ef,
             quantile_cont(monetary, [.25,.5,.75]) AS em, min(recency) AS r0, max(recency) AS r9,
             min(frequency) AS f0, max(frequency) AS f9, min(monetary) AS m0, max(monetary) AS m9 FROM m),
d AS (SELECT [x FOR x IN list_distinct(er) IF x > r0 AND x < r9] AS er,
             [x FOR x IN list_distinct(ef) IF x > f0 AND x < f9] AS ef,
             [x FOR x IN list_distinct(em) IF x > m0 AND x < m9] AS em FROM e),
q AS (SELECT m.*, (4 - len([x FOR x IN er IF x < recency]))::INT AS r_score,
             (1 + len([x FOR x IN ef IF x < frequency]))::INT AS f_score,
             (1 + len([x FOR x IN em IF x < monetary]))::INT AS m_score FROM m, d)
SELECT *, r_score::VARCHAR || f_score::VARCHAR || m_score::VARCHAR AS rfm_score,
       CASE WHEN r_score>=3 AND f_score>=3 AND m_score>=3 THEN 'Champions' WHEN f_score>=3 AND m_score>=2 THEN 'Loyal'
            WHEN r_score<2 AND f_score>=2 AND m_score>=2 THEN 'At Risk'
            WHEN r_score>=2 AND f_score<=2 AND m_score<=2 THEN 'Need Attention' ELSE 'Lost' END AS segment
FROM q
"""

SEGMENTS = """
SELECT segment, count(*) AS customers, round(avg(monetary), 2) AS avg_monetary,
       round(avg(frequency), 4) AS avg_frequency, round(sum(monetary), 2) AS total_revenue,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS customer_pct,
       round(sum(monetary) * 100.0 / sum(sum(monetary)) OVER (), 4) AS revenue_pct
FROM ({inner}) GROUP BY segment
"""

ORDER_COLUMNS = ("o_custkey", "o_orderdate", "o_totalprice")


@query("rfm_rank", RFM_RANK_SQL)
def _(t):
    return rfm.rfm_rank(t.orders, *ORDER_COLUMNS)


@query("rfm_edges", RFM_EDGES_SQL)
def _(t):
    return rfm.rfm_edges(t.orders, *ORDER_COLUMNS)


@query("rfm_segments", SEGMENTS.format(inner=RFM_RANK_SQL))
def _(t):
    return rfm.segment_summary(rfm.rfm_rank(t.orders, *ORDER_COLUMNS))


@query("rfm_edge_segments", SEGMENTS.format(inner=RFM_EDGES_SQL))
def _(t):
    return rfm.segment_summary(rfm.rfm_edges(t.orders, *ORDER_COLUMNS))


# -- cohorts -----------------------------------------------------------------------------------

COHORT = """
WITH a AS (SELECT DISTINCT o_custkey AS m, date_trunc('month', o_orderdate)::DATE AS period FROM orders),
f AS (SELECT m, min(period) AS cohort FROM a GROUP BY 1),
v AS (SELECT o_custkey AS m, date_trunc('month', o_orderdate)::DATE AS period, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
c AS (SELECT cohort, ((year(period) - year(cohort)) * 12 + month(period) - month(cohort))::INTEGER AS cohort_index,
        count(DISTINCT m) AS members, round(sum(v), 2) AS value FROM v JOIN f USING (m) GROUP BY 1, 2),
z AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1),
cells AS (SELECT cohort, cohort_index, members, cohort_size, round(members / cohort_size, 4) AS retention, value
          FROM c JOIN z USING (cohort))
"""


def order_cells(t):
    return cohort.cohort_cells(t.orders, "o_custkey", "o_orderdate", "o_totalprice")


@query("cohort_retention", COHORT + "SELECT * FROM cells")
def _(t):
    return order_cells(t)


@query("cohort_average", COHORT + """
SELECT count(DISTINCT cohort) AS cohort_count, count(DISTINCT cohort_index) AS period_count,
  round(sum(CASE WHEN cohort_index > 0 THEN retention ELSE 0 END) /
        (count(DISTINCT cohort) * (count(DISTINCT cohort_index) - 1)), 4) AS average_retention FROM cells""")
def _(t):
    return cohort.average_retention(order_cells(t))


@query("cohort_matrix", COHORT + """, grid AS (
  SELECT * FROM (SELECT DISTINCT cohort FROM cells) CROSS JOIN (SELECT DISTINCT cohort_index FROM cells))
SELECT cohort, cohort_index, coalesce(max(retention), 0) AS retention FROM grid LEFT JOIN cells USING (cohort, cohort_index)
GROUP BY 1, 2""")
def _(t):
    wide = cohort.pivot_cells(order_cells(t), "retention")
    columns = [c for c in wide.columns if c != "cohort"]
    pairs = F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("i"), F.col(c).alias("v")) for c in columns])).alias("cell")
    return wide.select("cohort", pairs).select("cohort", F.col("cell.i").alias("cohort_index"), F.col("cell.v").alias("retention"))


@query("cohort_weekly", """
WITH v AS (SELECT user_id AS m, date_trunc('week', ts)::DATE AS period, sum(value) AS v FROM events GROUP BY 1, 2),
f AS (SELECT m, min(period) AS cohort FROM v GROUP BY 1),
z AS (SELECT cohort, count(*) AS cohort_size FROM f GROUP BY 1)
SELECT cohort, floor(date_diff('day', cohort, period) / 7)::INTEGER AS cohort_index, count(*) AS members,
  any_value(cohort_size) AS cohort_size, round(count(*) / any_value(cohort_size), 4) AS retention, round(sum(v), 2) AS value
FROM v JOIN f USING (m) JOIN z USING (cohort) GROUP BY 1, 2""")
def _(t):
    return cohort.cohort_cells(t.events, "user_id", "ts", "value", "week")


COHORT_DIM = """
SELECT o_orderpriority AS cohort_name, sum(count(*)) OVER (PARTITION BY o_orderpriority)::BIGINT AS cohort_size,
  strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value, count(*) AS count
FROM orders GROUP BY o_orderpriority, 3"""


def dimension(t):
    return cohort.dimension_cells(t.orders, "o_orderpriority", kpi.month(F.col("o_orderdate")), "o_totalprice")


@query("cohort_by_dimension", COHORT_DIM)
def _(t):
    return dimension(t)


@query("cohort_counts_by_dimension", COHORT_DIM.replace("round(sum(o_totalprice), 2)", "count(*)::DOUBLE"))
def _(t):
    return cohort.dimension_cells(t.orders, "o_orderpriority", kpi.month(F.col("o_orderdate")), "o_orderstatus")


@query("cohort_extremes", f"""
WITH s AS (SELECT cohort_name, round(sum(value), 2) AS total FROM ({COHORT_DIM}) GROUP BY 1)
SELECT count(*) AS total_cohorts, first(cohort_name ORDER BY total DESC, cohort_name) AS best_cohort, max(total) AS best_total,
  first(cohort_name ORDER BY total, cohort_name) AS worst_cohort, min(total) AS worst_total FROM s""")
def _(t):
    return cohort.dimension_extremes(dimension(t))


# -- KPIs --------------------------------------------------------------------------------------

MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1"


@query("sales_kpis", f"""
WITH m AS ({MONTHLY}), p AS (
  SELECT p_brand AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1 ORDER BY value DESC, label LIMIT 1),
m2 AS (SELECT strftime(l_shipdate, '%Y-%m') AS label, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1)
SELECT round(sum(l_extendedprice), 2) AS total_revenue, sum(l_quantity)::BIGINT AS order_count,
  round(sum(l_extendedprice) / sum(l_quantity), 4) AS average_order_value,
  (SELECT label FROM p) AS top_product, (SELECT value FROM p) AS top_product_revenue,
  (SELECT round((max_by(value, label) - min_by(value, label)) / abs(min_by(value, label)) * 100, 4) FROM m2) AS growth_pct
FROM lineitem""")
def _(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return kpi.sales_kpis(rows, "l_extendedprice", "l_shipdate", "p_brand", "l_quantity")


def kpi_sql(measures: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS kpi, round(({v})::DOUBLE, 4) AS value FROM {table}" for k, v in measures.items()
    )


@query("hr_kpis", kpi_sql({
    "total_payroll": "sum(c_acctbal)", "average_salary": "avg(c_acctbal)", "headcount": "count(DISTINCT c_custkey)",
    "attrition_rate": "avg((c_nationkey < 5)::INT) * 100"}, "customer"))
def _(t):
    rows = t.customer.withColumn("left", F.when(F.col("c_nationkey") < 5, "Yes").otherwise("no"))
    return kpi.hr_kpis(rows, "c_acctbal", "c_custkey", "left")


@query("finance_kpis", kpi_sql({
    "total_income": "sum(l_extendedprice)", "total_expenses": "sum(l_extendedprice * l_discount)",
    "net_profit": "sum(l_extendedprice) - sum(l_extendedprice * l_discount)"}, "lineitem"))
def _(t):
    rows = t.lineitem.withColumn("expense", F.col("l_extendedprice") * F.col("l_discount"))
    return kpi.finance_kpis(rows, "l_extendedprice", "expense")


@query("budget_vs_actual", """
SELECT strftime(l_shipdate, '%Y-%m') AS label, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(net), 2) AS net
FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) GROUP BY 1""")
def _(t):
    rows = t.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return kpi.budget_vs_actual(rows, "l_shipdate", "l_extendedprice", "net")


@query("operations_kpis", kpi_sql({
    "efficiency": "avg(l_discount)", "throughput": "sum(l_quantity)", "response_time": "avg(l_linenumber)",
    "compliance_rate": "avg(l_tax) * 100"}, "lineitem"))
def _(t):
    return kpi.operations_kpis(t.lineitem, "l_discount", "l_quantity", "l_linenumber", "l_tax")


@query("customer_kpis", kpi_sql({
    "total_customers": "count(DISTINCT o_custkey)", "churn_rate": "avg((o_orderstatus = 'F')::INT) * 100",
    "lifetime_value": "avg(o_totalprice)"}, "orders"))
def _(t):
    rows = t.orders.withColumn("churned", (F.col("o_orderstatus") == "F").cast("int"))
    return kpi.customer_kpis(rows, "o_custkey", "churned", "o_totalprice")


@query("inventory_kpis", kpi_sql({
    "total_inventory": "sum(p_size)", "inventory_volatility": "stddev_pop(p_size) / abs(avg(p_size)) * 100"}, "part"))
def _(t):
    return kpi.inventory_kpis(t.part, "p_size")


@query("generic_kpis", " UNION ALL ".join(
    f"SELECT {i} AS position, '{k}' AS kpi, round({v}, 2)::DOUBLE AS value FROM lineitem" for i, (k, v) in enumerate(
        [("total_records", "count(*)")] + [(f"{f}_{c}", f"{f}({c})") for c in
         ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for f in ("sum", "avg")])))
def _(t):
    return kpi.generic_kpis(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"))


@query("first_number_kpis", kpi_sql({
    "p_retailprice": "sum(p_retailprice)", "p_retailprice_avg": "avg(p_retailprice)",
    "p_retailprice_max": "max(p_retailprice)", "row_count": "count(*)"}, "part"))
def _(t):
    return kpi.first_number_kpis(t.part.select("p_name", "p_retailprice"))


# -- charts ------------------------------------------------------------------------------------


@query("monthly_sum", MONTHLY)
def _(t):
    return kpi.monthly_sum(t.orders, "o_orderdate", "o_totalprice")


@query("growth", f"""
SELECT count(*) AS months, min_by(value, label) AS first_value, max_by(value, label) AS last_value,
  round((max_by(value, label) - min_by(value, label)) / abs(min_by(value, label)) * 100, 4) AS growth_pct FROM ({MONTHLY})""")
def _(t):
    return kpi.growth(t.orders, "o_orderdate", "o_totalprice")


@query("category_share", "SELECT p_type AS label, count(*) AS value FROM part GROUP BY 1 ORDER BY value DESC, label LIMIT 8")
def _(t):
    return kpi.category_share(t.part, "p_type")


@query("category_distinct_share", """
SELECT o_orderpriority AS label, count(DISTINCT o_custkey) AS value FROM orders GROUP BY 1 ORDER BY value DESC, label LIMIT 8""")
def _(t):
    return kpi.category_share(t.orders, "o_orderpriority", distinct_of="o_custkey")


@query("scatter", """
SELECT o_orderkey, o_custkey AS label, round(o_totalprice, 2) AS value FROM orders ORDER BY o_orderkey LIMIT 50""")
def _(t):
    return kpi.scatter(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"])


@query("stacked_months", """
SELECT strftime(l_shipdate, '%Y-%m') AS label, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_tax), 2) AS l_tax
FROM lineitem GROUP BY 1""")
def _(t):
    return kpi.stacked_months(t.lineitem, "l_shipdate", ["l_quantity", "l_tax"])


@query("segment_leaders", """
SELECT n_name AS label, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY value DESC, label LIMIT 5""")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    return kpi.segment_leaders(rows, "n_name", "o_totalprice")


@query("bar_rows", """
SELECT p_partkey, p_name AS name, p_retailprice AS value FROM part""")
def _(t):
    return kpi.bar_rows(t.part, "p_name", "p_retailprice", ["p_partkey"])


@query("line_rows", """
SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part""")
def _(t):
    return kpi.line_rows(t.part, ["p_partkey"], ["p_size", "p_retailprice"])


@query("pie_slices", """
SELECT p_brand AS name, round(sum(p_retailprice), 2) AS value FROM part GROUP BY p_brand""")
def _(t):
    return kpi.pie_slices(t.part, "p_brand", "p_retailprice")


# -- correlation -------------------------------------------------------------------------------

LINE = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, corr({a}, {b}) AS correlation FROM lineitem"
    for a, b in combinations(LINE, 2)
)


def banded(threshold: float) -> str:
    return f"""SELECT "left", "right", round(correlation, 4) AS correlation, CASE WHEN abs(correlation) > .7 THEN 'strong'
  WHEN abs(correlation) > .3 THEN 'moderate' ELSE 'weak' END AS strength FROM ({PAIRS}) WHERE abs(correlation) >= {threshold}"""


@query("pair_correlations", f'SELECT "left", "right", n, round(correlation, 6) AS correlation FROM ({PAIRS})')
def _(t):
    return correlation.pair_correlations(t.lineitem, LINE).withColumn("correlation", F.round("correlation", 6))


@query("correlation_matrix", f"""
SELECT "left" AS row, "right" AS "column", round(correlation, 4) AS value FROM ({PAIRS}) UNION ALL
SELECT "right", "left", round(correlation, 4) FROM ({PAIRS}) UNION ALL
SELECT c, c, 1.0::DOUBLE FROM (SELECT unnest({LINE}) AS c)""")
def _(t):
    return correlation.correlation_matrix(t.lineitem, LINE)


@query("strong_pairs", """
WITH n AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem),
p AS (SELECT 'l_extendedprice' AS "left", 'net' AS "right", corr(l_extendedprice, net) AS r FROM n UNION ALL
  SELECT 'l_quantity', 'net', corr(l_quantity, net) FROM n UNION ALL
  SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) FROM n)
SELECT "left", "right", round(r, 4) AS correlation, CASE WHEN abs(r) > .7 THEN 'strong' WHEN abs(r) > .3 THEN 'moderate'
  ELSE 'weak' END AS strength FROM p WHERE abs(r) >= .5""")
def _(t):
    rows = t.lineitem.selectExpr("l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net")
    return correlation.strong_pairs(rows)


@query("correlation_bands", banded(0.0))
def _(t):
    return correlation.strong_pairs(t.lineitem, LINE, threshold=0.0)


@query("band_counts", f"""
SELECT count(*) FILTER (r > .7) AS strong_positive, count(*) FILTER (r > .3 AND r <= .7) AS moderate_positive,
  count(*) FILTER (r >= -.3 AND r <= .3) AS weak, count(*) FILTER (r >= -.7 AND r < -.3) AS moderate_negative,
  count(*) FILTER (r < -.7) AS strong_negative FROM (SELECT correlation AS r FROM ({PAIRS}))""")
def _(t):
    return correlation.band_counts(t.lineitem, LINE)


# -- insights ----------------------------------------------------------------------------------


@query("key_candidates", """
WITH e AS (SELECT event_id, user_id, value, value * 2 + event_id * 1e-9 AS twice FROM events),
p AS (SELECT 'event_id' AS l, 'user_id' AS r, corr(event_id, user_id) AS c FROM e UNION ALL
  SELECT 'event_id', 'value', corr(event_id, value) FROM e UNION ALL SELECT 'event_id', 'twice', corr(event_id, twice) FROM e UNION ALL
  SELECT 'user_id', 'value', corr(user_id, value) FROM e UNION ALL SELECT 'user_id', 'twice', corr(user_id, twice) FROM e UNION ALL
  SELECT 'value', 'twice', corr(value, twice) FROM e)
SELECT 'event_id' AS left_column, NULL AS right_column, CASE WHEN count(DISTINCT event_id) >= count(*) - 1
  THEN 'primary_key_candidate' ELSE 'foreign_key_candidate' END AS relationship_type,
  CASE WHEN count(DISTINCT event_id) >= count(*) - 1 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM e UNION ALL
SELECT 'user_id', NULL, CASE WHEN count(DISTINCT user_id) >= count(*) - 1 THEN 'primary_key_candidate' ELSE 'foreign_key_candidate' END,
  CASE WHEN count(DISTINCT user_id) >= count(*) - 1 THEN 0.9 ELSE 0.75 END FROM e UNION ALL
SELECT l, r, 'statistical_correlation', round(abs(c), 2) FROM p WHERE abs(c) >= .65""")
def _(t):
    rows = t.events.selectExpr("event_id", "user_id", "value", "value * 2 + event_id * 1e-9D AS twice")
    return insights.key_candidates(rows)


@query("orphan_keys", """
SELECT count(DISTINCT l_partkey) AS orphan_keys, count(*) AS orphan_rows FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)""")
def _(t):
    return insights.orphan_keys(t.lineitem, "l_partkey", t.part.filter("p_size > 25"), "p_partkey")


DOCS = """SELECT n_chars, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source, 'v1' AS version FROM documents"""


@query("table_insights", f"""
WITH d AS ({DOCS}), q AS (SELECT quantile_cont(n_chars, .25) AS a, quantile_cont(n_chars, .75) AS b FROM d),
o AS (SELECT count(*) FILTER (n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)) AS x, count(*) AS n FROM d, q),
m AS (SELECT (4.0 * count(*) - count(n_chars) - count(lang) - count(source) - count(version)) / 4 / count(*) * 100 AS p FROM d)
SELECT 'anomaly_warning' AS type, 'n_chars' AS "column", CASE WHEN x / n > .05 THEN 'high' ELSE 'low' END AS severity,
  round(x / n * 100, 1) AS value FROM o WHERE x > 0 UNION ALL
SELECT 'constant_column', 'version', NULL, 1 UNION ALL
SELECT 'data_quality', NULL, CASE WHEN p > 20 THEN 'high' ELSE 'medium' END, round(p, 1) FROM m WHERE p > 5""")
def _(t):
    return insights.table_insights(t.documents.selectExpr(
        "n_chars", "lang", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS source", "'v1' AS version"
    ))


@query("auto_insights", """
WITH o AS (SELECT o_orderdate AS day, o_orderkey, o_totalprice, o_totalprice * 0.1 + o_custkey * 1e-3 AS tax,
  CASE WHEN o_custkey % 10 < 7 THEN 'web' ELSE 'shop' END AS channel, o_totalprice * (CASE WHEN o_custkey % 10 < 7 THEN 3 ELSE 1 END) AS weighted FROM orders),
e AS (SELECT min_by(o_totalprice, (day, o_orderkey)) AS a1, max_by(o_totalprice, (day, o_orderkey)) AS b1,
  min_by(tax, (day, o_orderkey)) AS a2, max_by(tax, (day, o_orderkey)) AS b2,
  min_by(weighted, (day, o_orderkey)) AS a3, max_by(weighted, (day, o_orderkey)) AS b3 FROM o),
t AS (SELECT 'o_totalprice' AS metric, (b1 - a1) / a1 * 100 AS pct FROM e UNION ALL SELECT 'tax', (b2 - a2) / a2 * 100 FROM e
  UNION ALL SELECT 'weighted', (b3 - a3) / a3 * 100 FROM e),
c AS (SELECT 'o_totalprice vs tax' AS m, corr(o_totalprice, tax) AS r FROM o UNION ALL
  SELECT 'o_totalprice vs weighted', corr(o_totalprice, weighted) FROM o UNION ALL SELECT 'tax vs weighted', corr(tax, weighted) FROM o),
q AS (SELECT 'o_totalprice' AS m, o_totalprice AS x, quantile_cont(o_totalprice, .25) OVER () AS a, quantile_cont(o_totalprice, .75) OVER () AS b FROM o UNION ALL
  SELECT 'tax', tax, quantile_cont(tax, .25) OVER (), quantile_cont(tax, .75) OVER () FROM o UNION ALL
  SELECT 'weighted', weighted, quantile_cont(weighted, .25) OVER (), quantile_cont(weighted, .75) OVER () FROM o),
f AS (SELECT m, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS n, count(*) AS t FROM q GROUP BY 1),
g AS (SELECT channel, avg(o_totalprice) AS v1, avg(tax) AS v2, avg(weighted) AS v3, count(*) AS n FROM o GROUP BY 1)
SELECT 'trend' AS type, CASE WHEN abs(pct) > 50 THEN 'high' ELSE 'medium' END AS severity, metric, round(pct, 1) AS value,
  CASE WHEN pct > 0 THEN 'increased' ELSE 'decreased' END AS detail FROM t WHERE abs(pct) > 20 UNION ALL
SELECT 'anomaly', 'medium', m, n, round(n / t * 100, 1)::VARCHAR FROM f WHERE n / t > .05 UNION ALL
SELECT 'correlation', CASE WHEN abs(r) > .9 THEN 'high' ELSE 'medium' END, m, round(r, 2), CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END
  FROM c WHERE abs(r) > .7 UNION ALL
SELECT 'distribution', 'low', 'channel', round(max(n) * 100 / sum(n), 1), max_by(channel, n) FROM g HAVING max(n) / sum(n) > .5 UNION ALL
SELECT 'comparison', 'medium', 'channel -> o_totalprice', round((max(v1) - min(v1)) / min(v1) * 100, 1), max_by(channel, v1) FROM g
  HAVING (max(v1) - min(v1)) / min(v1) > .5 UNION ALL
SELECT 'comparison', 'medium', 'channel -> tax', round((max(v2) - min(v2)) / min(v2) * 100, 1), max_by(channel, v2) FROM g
  HAVING (max(v2) - min(v2)) / min(v2) > .5 UNION ALL
SELECT 'comparison', 'medium', 'channel -> weighted', round((max(v3) - min(v3)) / min(v3) * 100, 1), max_by(channel, v3) FROM g
  HAVING (max(v3) - min(v3)) / min(v3) > .5""")
def _(t):
    rows = t.orders.selectExpr(
        "o_orderdate AS day", "o_totalprice", "o_totalprice * 0.1D + o_custkey * 1e-3D AS tax",
        "CASE WHEN o_custkey % 10 < 7 THEN 'web' ELSE 'shop' END AS channel",
        "o_totalprice * (CASE WHEN o_custkey % 10 < 7 THEN 3 ELSE 1 END) AS weighted",
        "o_orderkey",
    )
    return insights.auto_insights(rows, "day", ["o_orderkey"], numbers=["o_totalprice", "tax", "weighted"])


# -- question specs ----------------------------------------------------------------------------


@query("spec_top_groups", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders
WHERE o_totalprice > 1000 AND o_orderstatus IN ('F', 'O') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def _(t):
    out = spec.run_spec(t.orders, {
        "aggregations": [("SUM", "o_totalprice")], "group_by": "o_orderpriority", "order_by": "aggregate", "limit": 3,
        "filters": [("o_totalprice", "greater than", 1000), ("o_orderstatus", "in", ["F", "O"])],
    })
    return out.withColumn("sum_o_totalprice", F.round("sum_o_totalprice", 2))


@query("spec_bottom_groups", """
SELECT p_brand, count(*) AS count, round(avg(p_retailprice), 4) AS avg_p_retailprice FROM part GROUP BY 1 ORDER BY 3, 1 LIMIT 5""")
def _(t):
    out = spec.run_spec(t.part, {
        "aggregations": [("COUNT", None), ("AVG", "p_retailprice")], "group_by": "p_brand",
        "order_by": "aggregate", "order_dir": "ASC", "limit": 5,
    })
    return out.withColumn("avg_p_retailprice", F.round("avg_p_retailprice", 4))


@query("spec_top_rows", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def _(t):
    return spec.run_spec(t.part, spec.top_rows_spec("p_retailprice", ["p_partkey"]))


@query("spec_count", "SELECT count(*) AS count FROM lineitem")
def _(t):
    return spec.run_spec(t.lineitem, spec.count_spec())


@query("spec_sum_by", "SELECT l_returnflag, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1")
def _(t):
    return spec.run_spec(t.lineitem, spec.sum_by_spec("l_returnflag", "l_quantity"))


@query("spec_year", "SELECT * FROM orders WHERE year(o_orderdate) = 1996")
def _(t):
    return spec.run_spec(t.orders, spec.year_spec("o_orderdate", 1996))


@query("spec_category_totals", """
SELECT p_brand, round(sum(p_retailprice), 2) AS sum_p_retailprice FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def _(t):
    out = spec.run_spec(t.part, spec.category_totals_spec("p_brand", "p_retailprice"))
    return out.withColumn("sum_p_retailprice", F.round("sum_p_retailprice", 2))
