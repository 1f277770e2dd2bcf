"""Cleaning and quality operators on customers and line items that are dirtied the same way in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.statistics import each
from tabulon.functions import text as T
from tabulon.operators import clean as C
from tabulon.operators import outliers as O
from tabulon.operators import profile as P
from tabulon.operators import quality as Q
from tabulon.operators import relational as R

# Same cells in both dialects; only the date formatting differs.
COMMON = [
    "c_custkey",
    "CASE WHEN c_custkey % 10 = 0 THEN 'N/A' WHEN c_custkey % 10 = 1 THEN ' ' || c_name || ' ' ELSE c_name END AS name",
    "CASE WHEN c_custkey % 23 = 0 THEN 'nil' ELSE '$' || CAST(c_acctbal AS {text}) END AS balance",
    "CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE ' off' END AS active",
    "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey AS {text}) ELSE c_mktsegment END AS mixed",
    "CASE WHEN c_custkey % 17 = 0 THEN {nan} ELSE c_acctbal END AS amount",
    "CASE WHEN c_custkey % 13 = 0 THEN 'not a date' WHEN c_custkey % 2 = 0 THEN {iso} ELSE {us} END AS joined",
]
SPARK_DAY = "date_add(DATE'2020-01-01', CAST(c_custkey % 700 AS INT))"
DUCK_DAY = "(DATE '2020-01-01' + CAST(c_custkey % 700 AS INT))"
SPARK_CELLS = [
    e.format(
        text="STRING", nan="CAST('NaN' AS DOUBLE)",
        iso=f"date_format({SPARK_DAY}, 'yyyy-MM-dd')", us=f"date_format({SPARK_DAY}, 'MM/dd/yyyy')",
    )
    for e in COMMON
]
DIRTY = "SELECT " + ", ".join(
    e.format(
        text="VARCHAR", nan="'NaN'::DOUBLE", iso=f"strftime({DUCK_DAY}, '%Y-%m-%d')", us=f"strftime({DUCK_DAY}, '%m/%d/%Y')"
    )
    for e in COMMON
) + " FROM customer"
REPEATED = f"SELECT * FROM ({DIRTY}) UNION ALL SELECT * FROM ({DIRTY}) WHERE c_custkey % 4 = 0"

NARROW = "', '".join(T.NULL_TOKENS)
WIDE = "', '".join(T.NULL_TOKENS_WIDE)
NUMBER = "'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


def money(c: str) -> str:
    bare = f"trim(regexp_replace(trim({c}), '[,$€£¥₹₽₩฿₫]', '', 'g'))"
    return f"CASE WHEN regexp_matches({bare}, {NUMBER}) THEN TRY_CAST({bare} AS DOUBLE) END"


def number(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), {NUMBER}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def day(c: str) -> str:
    return f"coalesce(try_strptime(trim({c}), '%Y-%m-%d'), try_strptime(trim({c}), '%m/%d/%Y'))"


def dirty(t):
    return t.customer.selectExpr(*SPARK_CELLS)


def repeated(t):
    rows = dirty(t)
    return rows.unionByName(rows.filter("c_custkey % 4 = 0"))


@query("normalize_nulls", f"""
SELECT c_custkey, CASE WHEN name NOT IN ('{NARROW}') THEN name END AS name,
       CASE WHEN balance NOT IN ('{NARROW}') THEN balance END AS balance, active, mixed,
       CASE WHEN NOT isnan(amount) THEN amount END AS amount, joined FROM ({DIRTY})""")
def _(t):
    return C.normalize_nulls(dirty(t))


@query("trim_strings", f"SELECT c_custkey, trim(name) AS name, trim(active) AS active FROM ({DIRTY})")
def _(t):
    return C.trim_strings(dirty(t).select("c_custkey", "name", "active"))


@query("coerce_numeric", f"SELECT c_custkey, {money('balance')} AS balance, mixed FROM ({DIRTY})")
def _(t):
    return C.coerce_numeric(dirty(t).select("c_custkey", "balance", "mixed"))


@query("coerce_boolean", f"SELECT c_custkey, lower(trim(active)) = 'yes' AS active, mixed FROM ({DIRTY})")
def _(t):
    return C.coerce_boolean(dirty(t).select("c_custkey", "active", "mixed"))


@query("coerce_datetime", f"SELECT c_custkey, {day('joined')} AS joined, name FROM ({DIRTY})")
def _(t):
    return C.coerce_datetime(dirty(t).select("c_custkey", "joined", "name"))


@query("normalize_table", f"""
SELECT c_custkey, trim(CASE WHEN name NOT IN ('{WIDE}') THEN name END) AS name, {money('balance')} AS balance,
       lower(trim(active)) = 'yes' AS active, trim(mixed) AS mixed,
       CASE WHEN NOT isnan(amount) THEN amount END AS amount, {day('joined')} AS joined FROM ({DIRTY})""")
def _(t):
    return C.normalize(dirty(t))


@query("drop_duplicate_rows", f"SELECT DISTINCT * FROM ({REPEATED})")
def _(t):
    return C.drop_duplicate_rows(repeated(t))


CLEANED = f"""SELECT DISTINCT c_custkey, CASE WHEN name NOT IN ('{NARROW}') THEN name END AS name, balance, active,
  mixed, CASE WHEN NOT isnan(amount) THEN amount END AS amount, joined FROM ({REPEATED})"""


@query("complete_cases", f"SELECT * FROM ({CLEANED}) WHERE name IS NOT NULL AND amount IS NOT NULL")
def _(t):
    return C.complete_cases(C.clean_stage(repeated(t)))


@query("impute_mean", f"""
SELECT c_custkey, round(coalesce(amount, (SELECT avg(amount) FROM ({CLEANED}))), 4) AS amount FROM ({CLEANED})""")
def _(t):
    out = C.impute(C.clean_stage(repeated(t)).select("c_custkey", "amount"), "mean", ["amount"])
    return out.withColumn("amount", F.round("amount", 4))


@query("impute_median", f"""
SELECT c_custkey, round(coalesce(amount, (SELECT median(amount) FROM ({CLEANED}))), 4) AS amount FROM ({CLEANED})""")
def _(t):
    out = C.impute(C.clean_stage(repeated(t)).select("c_custkey", "amount"), "median", ["amount"])
    return out.withColumn("amount", F.round("amount", 4))


@query("impute_most_frequent", """
WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(flag, (SELECT flag FROM h WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag
FROM h""")
def _(t):
    rows = t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_returnflag END AS flag"
    )
    return C.impute(rows, "most_frequent")


@query("whitespace_counts", each(["name", "active", "mixed"], f"""
SELECT '{{c}}' AS "column", count(*) FILTER (trim({{c}}) <> {{c}}) AS issue_count FROM ({DIRTY})"""))
def _(t):
    return C.whitespace_counts(dirty(t), ["name", "active", "mixed"])


@query("numeric_mix", each(["name", "mixed"], f"""
SELECT '{{c}}' AS "column", r AS numeric_ratio, r > 0.2 AND r < 0.8 AS mixed FROM (
  SELECT round(count({number('{c}')}) / count(*), 4) AS r FROM (SELECT DISTINCT {{c}} FROM ({DIRTY})))"""))
def _(t):
    return C.numeric_mix(dirty(t), ["name", "mixed"])


@query("clean_transform_features", f"""
SELECT *, round(c_custkey + coalesce(amount, 0), 4) AS _row_sum,
  round((c_custkey + coalesce(amount, 0)) / (CASE WHEN amount IS NULL THEN 1 ELSE 2 END), 4) AS _row_mean
FROM (SELECT c_custkey, trim(name) AS name, trim(balance) AS balance, trim(active) AS active, trim(mixed) AS mixed,
             amount, joined FROM ({CLEANED}))""")
def _(t):
    return C.clean_transform_features(repeated(t)).withColumn("_row_sum", F.round("_row_sum", 4)).withColumn(
        "_row_mean", F.round("_row_mean", 4)
    )


@query("stage_report", f"""
SELECT 0 AS position, 'input' AS stage, count(*) AS row_count, 7 AS columns, 0::BIGINT AS missing_cells FROM ({REPEATED}) UNION ALL
SELECT 1, 'cleaning', count(*), 7, count(*) * 2 - count(name) - count(amount) FROM ({CLEANED}) UNION ALL
SELECT 2, 'transformation', count(*), 7, count(*) * 2 - count(name) - count(amount) FROM ({CLEANED}) UNION ALL
SELECT 3, 'features', count(*), 9, count(*) * 2 - count(name) - count(amount) FROM ({CLEANED})""")
def _(t):
    return C.stage_report(repeated(t))


@query("sanitize_names", "SELECT c_custkey AS customer_key, c_name AS a_b, c_acctbal AS a_b_2, c_mktsegment AS _1st FROM customer")
def _(t):
    raw = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return C.sanitize_names(raw.toDF("Customer Key", "A b", "a-b", "1st!"))


@query("select_present", "SELECT c_custkey, c_name FROM customer")
def _(t):
    return C.select_present(t.customer, ["c_custkey", "absent", "c_name"])


# -- outliers ----------------------------------------------------------------------------------

FENCE = """(SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"""


@query("iqr_outliers", f"""
SELECT o_orderkey, o_totalprice FROM orders, {FENCE.format(k=0.5, c='o_totalprice', t='orders')}
WHERE o_totalprice < lo OR o_totalprice > hi""")
def _(t):
    return O.iqr_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", k=0.5)


@query("iqr_summary", each(["l_quantity", "l_extendedprice", "l_tax"], f"""
SELECT '{{c}}' AS "column", count({{c}}) AS total_points, round(any_value(lo), 4) AS lower, round(any_value(hi), 4) AS upper,
  count(*) FILTER ({{c}} < lo OR {{c}} > hi) AS anomaly_count,
  round(count(*) FILTER ({{c}} < lo OR {{c}} > hi) * 100.0 / count(*), 2) AS anomaly_pct
FROM lineitem, {FENCE.format(k=1.5, c='{c}', t='lineitem')}"""))
def _(t):
    return O.iqr_summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])


@query("zscore_outliers", """
SELECT c_custkey, c_acctbal, round((c_acctbal - m) / s, 6) AS z_score
FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer)
WHERE abs((c_acctbal - m) / s) > 1.6""")
def _(t):
    out = O.zscore_rows(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", 1.6)
    return out.withColumn("z_score", F.round("z_score", 6))


@query("zscore_summary", each(["l_quantity", "l_extendedprice"], """
SELECT '{c}' AS "column", count(*) AS total_points, 1.7::DOUBLE AS threshold,
  count(*) FILTER (abs(({c} - m) / s) > 1.7) AS anomaly_count,
  round(count(*) FILTER (abs(({c} - m) / s) > 1.7) * 100.0 / count(*), 2) AS anomaly_pct
FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)"""))
def _(t):
    return O.zscore_summary(t.lineitem, ["l_quantity", "l_extendedprice"], 1.7)


@query("ranked_deviation", """
SELECT o_orderkey, o_totalprice, round((o_totalprice - m) / s, 6) AS z_score
FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)
ORDER BY abs(o_totalprice - m) DESC, o_orderkey LIMIT 100""")
def _(t):
    out = O.ranked_deviation(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"])
    return out.withColumn("z_score", F.round("z_score", 6))


# -- quality -----------------------------------------------------------------------------------

DUPES = "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) FROM g)"
COLUMNS = ["c_custkey", "name", "balance", "active", "mixed", "amount", "joined"]
TEXT = ["name", "balance", "active", "mixed", "joined"]
GIVEN = f"""g AS (SELECT c_custkey, CASE WHEN name NOT IN ('{NARROW}') THEN name END AS name, balance, active, mixed,
   CASE WHEN NOT isnan(amount) THEN amount END AS amount, joined FROM ({REPEATED}))"""


def given(t):
    return C.normalize_nulls(repeated(t))


METRICS = (
    "SELECT 'completeness' AS category, 'table' AS scope, NULL::VARCHAR AS \"column\", "
    + "sum(m)::BIGINT AS issue_count, sum(m) / sum(n) AS ratio FROM ("
    + each(COLUMNS, "SELECT count(*) - count({c}) AS m, count(*) AS n FROM g")
    + ") UNION ALL "
    + each(COLUMNS, "SELECT 'completeness', 'column', '{c}', count(*) - count({c}), (count(*) - count({c})) / count(*) FROM g")
    + " UNION ALL SELECT 'consistency', 'table', NULL, 0, NULL"
    + f" UNION ALL SELECT 'duplicates', 'table', NULL, {DUPES}, {DUPES} / (SELECT count(*) FROM g) UNION ALL "
    + each(TEXT, "SELECT 'duplicates', 'column', '{c}', (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM g GROUP BY {c})), NULL")
    + " UNION ALL "
    + each(TEXT, f"""SELECT 'data_types', 'column', '{{c}}', NULL,
         (SELECT round(count({number('{c}')}) / count(*), 4) FROM (SELECT DISTINCT {{c}} FROM g WHERE {{c}} IS NOT NULL))""")
    + " UNION ALL "
    + each(TEXT, "SELECT 'consistency', 'column', '{c}', (SELECT count(*) FROM g WHERE trim({c}) <> {c}), NULL")
    + " UNION ALL "
    + each(["c_custkey", "amount"], f"""SELECT 'outliers_iqr', 'column', '{{c}}', count(*) FILTER ({{c}} < lo OR {{c}} > hi),
         count(*) FILTER ({{c}} < lo OR {{c}} > hi) / count({{c}}) FROM g, {FENCE.format(k=1.5, c='{c}', t='g')}""")
    + " UNION ALL "
    + each(["c_custkey", "amount"], """SELECT 'outliers_zscore', 'column', '{c}', count(*) FILTER (abs(({c} - m) / s) > 3),
         count(*) FILTER (abs(({c} - m) / s) > 3) / count({c})
         FROM g, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM g)""")
)
ISSUES = f"""
SELECT *, CASE
  WHEN category = 'completeness' AND scope = 'table' THEN CASE WHEN ratio > .5 THEN 'critical' WHEN ratio > .2 THEN 'error' WHEN ratio > .05 THEN 'warning' END
  WHEN category = 'completeness' THEN CASE WHEN ratio > .5 THEN 'error' WHEN ratio > .2 THEN 'warning' END
  WHEN category = 'duplicates' AND scope = 'table' THEN CASE WHEN ratio > .1 THEN 'error' WHEN ratio > .01 THEN 'warning' END
  WHEN category = 'duplicates' THEN CASE WHEN issue_count > 0 THEN 'info' END
  WHEN category = 'data_types' THEN CASE WHEN ratio > .2 AND ratio < .8 THEN 'warning' END
  WHEN category = 'outliers_iqr' THEN CASE WHEN ratio > .1 THEN 'warning' END
  WHEN category = 'outliers_zscore' THEN CASE WHEN ratio > .05 THEN 'info' END
  WHEN scope = 'table' THEN CASE WHEN issue_count > 0 THEN 'error' END
  WHEN issue_count > 0 THEN 'info' END AS severity FROM ({METRICS})"""


@query("quality_metrics", f"WITH {GIVEN} SELECT category, scope, \"column\", issue_count, round(ratio, 4) AS ratio FROM ({METRICS})")
def _(t):
    return Q.quality_metrics(given(t)).withColumn("ratio", F.round("ratio", 4))


@query("quality_issues", f"""WITH {GIVEN}
SELECT severity, category, scope, "column", issue_count, round(ratio, 4) AS ratio FROM ({ISSUES}) WHERE severity IS NOT NULL""")
def _(t):
    return Q.quality_issues(given(t))


@query("quality_score", f"""WITH {GIVEN}
SELECT c AS critical, e AS errors, w AS warnings,
  greatest(0, least(100, round_even(100 - 20 * c - 10 * e - 3 * w - 30 * nulls - 20 * dupes, 0)))::INTEGER AS quality_score
FROM (SELECT count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'error') AS e,
             count(*) FILTER (severity = 'warning') AS w FROM ({ISSUES})),
     (SELECT avg(m) AS nulls FROM ({each(COLUMNS, 'SELECT (count(*) - count({c})) / count(*) AS m FROM g')})),
     (SELECT {DUPES} / count(*) AS dupes FROM g)""")
def _(t):
    return Q.quality_score(given(t))


@query("quality_report", f"""WITH {GIVEN},
m AS ({each(COLUMNS, '''SELECT '{c}' AS col, round(100.0 * (count(*) - count({c})) / count(*), 2) AS p FROM g''')}),
o AS ({each(["c_custkey", "amount"], f'''SELECT count(*) AS n FROM g, {FENCE.format(k=1.5, c='{c}', t='g')} WHERE {{c}} < lo OR {{c}} > hi''')})
SELECT {DUPES} AS duplicate_rows, round({DUPES} * 100 / (SELECT count(*) FROM g), 2) AS duplicate_pct,
  round(avg(p), 2) AS average_missing_pct, coalesce(string_agg(CASE WHEN p >= 20 THEN col END, ',' ORDER BY col), '') AS high_missing_columns,
  (SELECT count(*) FROM o WHERE n > 0) AS columns_with_outliers, round(100 - round(avg(p), 2), 2) AS completeness_score FROM m""")
def _(t):
    return Q.quality_report(given(t))


SCORES = (
    each(["c_custkey", "amount"], """
SELECT '{c}' AS "column", 'numeric' AS type, count({c}) / count(*) AS co, count(DISTINCT {c}) / count(*) AS ca,
  count(DISTINCT {c}) AS u, greatest(0, least(stddev_samp({c}) / avg({c}) / 10, 1)) AS v FROM g""")
    + " UNION ALL "
    + each(TEXT, """
SELECT '{c}', 'categorical', count({c}) / count(*), count(DISTINCT {c}) / count(*), count(DISTINCT {c}), 0.5 FROM g""")
)


@query("column_scores", f"""WITH {GIVEN}
SELECT "column", type, round(co, 4) AS completeness, round(ca, 4) AS cardinality, u AS unique_count,
  round(co * .4 + (1 - least(ca, 1)) * .3 + v * .3, 4) AS quality_score FROM ({SCORES})""")
def _(t):
    return Q.column_scores(given(t))


@query("overall_score", f"""WITH {GIVEN}
SELECT round(avg(round(co * .4 + (1 - least(ca, 1)) * .3 + v * .3, 4)), 4) AS overall_score FROM ({SCORES})""")
def _(t):
    return Q.overall_score(given(t))


@query("table_checks", f"""WITH {GIVEN}
SELECT count(*) AS row_count, 7 AS column_count,
  round((7.0 * count(*) - count(c_custkey) - count(name) - count(balance) - count(active) - count(mixed) - count(amount)
         - count(joined)) / 7 / count(*), 4) AS null_ratio, {DUPES} AS duplicate_rows,
  false AS valid FROM g""")
def _(t):
    return Q.table_checks(given(t))


# -- relational basics -------------------------------------------------------------------------


@query("join_inner", """
SELECT c_mktsegment, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def _(t):
    joined = R.equi_join(t.orders, t.customer, "o_custkey", "c_custkey")
    return (
        R.equi_join(joined, t.nation, "c_nationkey", "n_nationkey")
        .groupBy("c_mktsegment", "n_name")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    )


@query("semi_join", """
SELECT c_custkey, c_name FROM customer c
WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')""")
def _(t):
    shared = t.orders.filter("o_orderpriority = '1-URGENT'")
    return R.owned_or_shared(t.customer, F.col("c_nationkey") == 3, shared, "c_custkey", "o_custkey").select(
        "c_custkey", "c_name"
    )


@query("in_filter", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    ids = t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return R.in_ids(t.orders, "o_custkey", ids, "c_custkey").select("o_orderkey", "o_totalprice")


@query("aligned_pairs", f"""
SELECT count(*) AS pairs, round(avg(c_custkey - amount), 4) AS mean_difference FROM ({CLEANED}) WHERE amount IS NOT NULL""")
def _(t):
    pairs = R.aligned_pairs(C.clean_stage(repeated(t)), "c_custkey", "amount")
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("x") - F.col("y")), 4).alias("mean_difference")
    )


@query("text_search", """
SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_name) LIKE '%red%' OR lower(p_type) LIKE '%red%'""")
def _(t):
    return t.part.filter(T.contains_any([F.col("p_name"), F.col("p_type")], "RED")).select("p_partkey", "p_name", "p_type")


@query("predicates", """
SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND year(o_orderdate) = 1997
  AND (o_totalprice > 200000 OR o_orderstatus IN ('F', 'P')) AND o_orderpriority = '1-URGENT'""")
def _(t):
    return t.orders.filter(
        F.col("o_orderdate").isNotNull()
        & R.in_year(F.col("o_orderdate"), 1997)
        & ((F.col("o_totalprice") > 200000) | F.col("o_orderstatus").isin("F", "P"))
        & (F.col("o_orderpriority") == "1-URGENT")
    ).select("o_orderkey")


@query("page_with_total", """
SELECT p_partkey, p_name, p_retailprice, (SELECT count(*) FROM part WHERE p_size > 10) AS total FROM part
WHERE p_size > 10 ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40""")
def _(t):
    rows = t.part.filter("p_size > 10").select("p_partkey", "p_name", "p_retailprice")
    return R.page(rows, "p_retailprice", ["p_partkey"], limit=20, offset=40, descending=True)


@query("top_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(t):
    return R.top_rows(t.orders, "o_totalprice", ["o_orderkey"], 10)


@query("first_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50")
def _(t):
    return R.first_rows(t.customer, ["c_custkey"], 50)


@query("missing_grid", f"""
SELECT c_custkey, c_custkey IS NULL AS c_custkey_missing, name IS NULL AS name_missing, amount IS NULL AS amount_missing
FROM ({CLEANED}) ORDER BY c_custkey LIMIT 20""")
def _(t):
    rows = C.clean_stage(repeated(t)).select("c_custkey", "name", "amount")
    return R.missing_grid(rows, ["c_custkey"], 20)


@query("union_by_name", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL
SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(t):
    left = t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")
    right = t.supplier.selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    return R.union_inputs([left, right])


@query("filter_options", each(["p_type", "p_size"], """
SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY v) AS options FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM part)
HAVING count(*) <= 20"""))
def _(t):
    return R.filter_options(t.part, ["p_type", "p_size", "p_name"]).withColumn("options", F.array_join("options", "|"))


@query("distinct_values", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return R.distinct_values(t.part, "p_brand")


@query("forward_fill", """
SELECT l_orderkey, l_linenumber, last_value(v IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shipped
FROM (SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN l_returnflag END AS v FROM lineitem)""")
def _(t):
    rows = t.lineitem.withColumn("shipped", F.when(F.col("l_linenumber") % 2 == 1, F.col("l_returnflag")))
    return R.forward_fill(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_extendedprice"], ["shipped"]).select(
        "l_orderkey", "l_linenumber", "shipped"
    )


@query("share_of_total", """
SELECT o_orderpriority, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS share_pct FROM orders GROUP BY 1""")
def _(t):
    return R.share_of_total(t.orders, "o_orderpriority")


@query("sample_rows")
def _(t):
    return R.hash_sample(t.lineitem, ["l_orderkey", "l_linenumber"], 1000)


@query("train_test_split")
def _(t):
    train, test = R.hash_split(t.lineitem, ["l_orderkey", "l_linenumber"])
    return train.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("train")).unionByName(
        test.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("test"))
    )


# -- types and profiles ------------------------------------------------------------------------

TYPES = """SELECT * FROM (VALUES {rows}) v("column", inferred_type, subtype)"""


@query("infer_types_upload", TYPES.format(rows="""
('c_custkey', 'numerical', 'integer'), ('name', 'categorical', 'category'), ('balance', 'categorical', 'category'),
('active', 'categorical', 'category'), ('mixed', 'categorical', 'category'), ('amount', 'numerical', 'currency'), ('joined', 'temporal', 'date')"""))
def _(t):
    return P.infer_types(given(t))


@query("infer_types_profiler", TYPES.format(rows="""
('c_custkey', 'numerical', 'integer'), ('name', 'categorical', 'category'), ('balance', 'categorical', 'category'),
('active', 'categorical', 'category'), ('mixed', 'categorical', 'category'), ('amount', 'numerical', 'float'), ('joined', 'categorical', 'category')"""))
def _(t):
    return P.infer_types(given(t), "profiler")


ORDER_TEXT = """SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS paid,
  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, strftime(o_orderdate, '%Y-%m-%d') AS placed FROM orders"""


def order_text(t):
    return t.orders.selectExpr(
        "o_orderkey", "CAST(o_totalprice AS STRING) AS price", "CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END AS paid",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority", "date_format(o_orderdate, 'yyyy-MM-dd') AS placed",
    )


@query("profile_columns", f"""
WITH x AS ({ORDER_TEXT}), n AS (SELECT count(*) AS n FROM x),
u AS ({each(["o_orderkey", "price", "paid", "priority", "placed"], """SELECT '{c}' AS "column", count(*) - count({c}) AS null_count,
  round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct, count(DISTINCT {c}) AS unique_count,
  CASE WHEN count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) / count(*) <= .1 THEN 'low'
       WHEN count(DISTINCT {c}) <= 50 OR count(DISTINCT {c}) / count(*) <= .5 THEN 'medium' ELSE 'high' END AS cardinality FROM x""")}),
k AS (SELECT * FROM (VALUES ('o_orderkey', 'numerical', 'integer'), ('price', 'numerical', 'currency'), ('paid', 'boolean', 'binary'),
  ('priority', 'categorical', 'category'), ('placed', 'temporal', 'date')) v("column", inferred_type, subtype)),
m AS (SELECT 'o_orderkey' AS "column", round(avg(o_orderkey), 4) AS mean, round(median(o_orderkey), 4) AS median, round(stddev_pop(o_orderkey), 4) AS std_dev FROM x UNION ALL
  SELECT 'price', round(avg(price::DOUBLE), 4), round(median(price::DOUBLE), 4), round(stddev_pop(price::DOUBLE), 4) FROM x)
SELECT k.*, null_count, missing_pct, unique_count, cardinality, mean, median, std_dev,
  CASE WHEN "column" = 'priority' THEN (SELECT round(avg(length(priority)), 2) FROM x) END AS average_length,
  CASE WHEN "column" = 'priority' THEN (SELECT round(-sum(p * log2(p + 1e-10)), 4) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM x WHERE priority IS NOT NULL GROUP BY priority)) END AS entropy,
  CASE WHEN "column" = 'paid' THEN (SELECT count(*) FROM x WHERE paid = 'Yes') END AS true_count,
  CASE WHEN "column" = 'placed' THEN (SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) FROM orders) END AS range_days
FROM k JOIN u USING ("column") LEFT JOIN m USING ("column")""")
def _(t):
    return P.profile_columns(order_text(t)).select(
        "column", "inferred_type", "subtype", "null_count", "missing_pct", "unique_count", "cardinality", "mean", "median",
        "std_dev", "average_length", "entropy", "true_count", "range_days",
    )
