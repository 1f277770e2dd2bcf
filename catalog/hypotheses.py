"""Hypothesis tests on line items, orders and parts.

The t tail in SQL is Simpson's rule on the density; F with two numerator degrees of freedom and
chi-square with an even number have closed forms.
"""

from __future__ import annotations

from catalog.base import query
from catalog.business import LINE, PAIRS
from catalog.statistics import each, k2_sql
from tabulon.operators import hypothesis as H

STEPS = 4000


def t_tail(inner: str) -> str:
    """Rows of `inner` (with columns t and v) plus p, the two-sided t tail."""
    pdf = "exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow(abs(t) * i / {s}, 2) / v, -(v + 1) / 2)".format(s=STEPS)
    weight = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"""(SELECT q.*, greatest(0, 1 - 2 * (SELECT sum({weight} * {pdf}) FROM range({STEPS + 1}) r(i)) * abs(t) / {STEPS} / 3) AS p
  FROM (SELECT *, v::DOUBLE AS v_ FROM ({inner})) q)"""


TWO = """
SELECT count(*) FILTER (g = 'R') AS n1, count(*) FILTER (g = 'A') AS n2, avg(x) FILTER (g = 'R') AS m1, avg(x) FILTER (g = 'A') AS m2,
  var_samp(x) FILTER (g = 'R') AS v1, var_samp(x) FILTER (g = 'A') AS v2 FROM (SELECT l_returnflag AS g, {x} AS x FROM lineitem)"""


@query("t_test", f"""
SELECT n1 AS group1_n, n2 AS group2_n, round(m1, 4) AS group1_mean, round(m2, 4) AS group2_mean, v AS df,
  round(t, 4) AS t_statistic, round(p, 6) AS p_value, p < 0.05 AS significant
FROM {t_tail(f'''SELECT *, n1 + n2 - 2 AS v, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t
  FROM ({TWO.format(x='l_quantity')})''')}""")
def _(t):
    return H.t_test(H.group_moments(t.lineitem, "l_returnflag", "l_quantity"), "R", "A")


@query("t_test_paired", f"""
SELECT n AS n_pairs, round(m1, 4) AS before_mean, round(m2, 4) AS after_mean, round(-md, 4) AS mean_difference,
  round(t, 4) AS t_statistic, round(p, 6) AS p_value, p < 0.05 AS significant
FROM {t_tail('''SELECT *, n - 1 AS v, md / (sd / sqrt(n)) AS t FROM (
  SELECT count(*) AS n, avg(l_discount) AS m1, avg(l_tax) AS m2,
    avg(l_discount - l_tax) AS md, stddev_samp(l_discount - l_tax) AS sd FROM lineitem)''')}""")
def _(t):
    return H.t_test_paired(t.lineitem, "l_discount", "l_tax")


ANOVA = """
SELECT k AS n_groups, total::BIGINT AS n_total, k - 1 AS df_between, (total - k)::BIGINT AS df_within, round(f, 4) AS f_statistic,
  round(pow((total - k) / ((total - k) + 2 * f), (total - k) / 2), 6) AS p_value,
  pow((total - k) / ((total - k) + 2 * f), (total - k) / 2) < 0.05 AS significant FROM (
SELECT count(*) AS k, sum(n) AS total,
  (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f FROM ({g}))"""


@query("anova_groups", ANOVA.format(g="SELECT count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY l_returnflag"))
def _(t):
    return H.anova(H.group_moments(t.lineitem, "l_returnflag", "l_extendedprice"))


@query("anova_columns", ANOVA.format(g=each(["l_discount", "l_tax", "l_linenumber"],
    "SELECT count({c}) AS n, avg({c}) AS m, var_samp({c}::DOUBLE) AS v FROM lineitem")))
def _(t):
    return H.anova(H.column_moments(t.lineitem, ["l_discount", "l_tax", "l_linenumber"]))


@query("chi_square_fit", """
SELECT k AS n_categories, k - 1 AS df, round(x, 4) AS chi_square, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value,
  exp(-x / 2) * (1 + x / 2) < 0.05 AS significant FROM (
  SELECT count(*) AS k, sum(o * o) * count(*) / sum(o) - sum(o) AS x FROM (SELECT count(*)::DOUBLE AS o FROM orders GROUP BY o_orderpriority))""")
def _(t):
    return H.chi_square_fit(t.orders, "o_orderpriority")


@query("chi_square_two_columns", """
WITH o AS (SELECT count(*) AS c, row_number() OVER (ORDER BY count(*) DESC) AS i FROM lineitem GROUP BY l_returnflag),
e AS (SELECT count(*) AS c, row_number() OVER (ORDER BY count(*) DESC) AS i FROM lineitem GROUP BY l_linenumber % 3)
SELECT 3::BIGINT AS n_categories, 2::BIGINT AS df, round(x, 4) AS chi_square, round(exp(-x / 2), 6) AS p_value, exp(-x / 2) < 0.05 AS significant
FROM (SELECT sum(pow(o.c - e.c, 2) / e.c) AS x FROM o JOIN e USING (i))""")
def _(t):
    rows = t.lineitem.selectExpr("l_returnflag", "l_linenumber % 3 AS line3")
    return H.chi_square_fit(rows, "l_returnflag", "line3")


@query("chi_square_independence", """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
m AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
SELECT sum(o)::BIGINT AS n_samples, 2::BIGINT AS df, round(sum(pow(o - e, 2) / e), 4) AS chi_square,
  round(exp(-sum(pow(o - e, 2) / e) / 2), 6) AS p_value, exp(-sum(pow(o - e, 2) / e) / 2) < 0.05 AS significant FROM m""")
def _(t):
    return H.chi_square_independence(t.lineitem, "l_returnflag", "l_linestatus")


CORR_T = "SELECT *, n - 2 AS v, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({inner})"


@query("pearson", f"""
SELECT 'l_linenumber' AS "left", 'l_quantity' AS "right", n AS n_samples, round(r, 4) AS correlation, round(p, 6) AS p_value, p < 0.05 AS significant
FROM {t_tail(CORR_T.format(inner='SELECT count(*) AS n, corr(l_linenumber, l_quantity) AS r FROM lineitem'))}""")
def _(t):
    return H.pearson(t.lineitem, "l_linenumber", "l_quantity")


@query("spearman", f"""
SELECT 'l_quantity' AS "left", 'l_extendedprice' AS "right", n AS n_samples, round(r, 4) AS correlation, round(p, 6) AS p_value, p < 0.05 AS significant
FROM {t_tail(CORR_T.format(inner='''SELECT count(*) AS n, corr(a, b) AS r FROM (
  SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
         rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)'''))}""")
def _(t):
    return H.spearman(t.lineitem, "l_quantity", "l_extendedprice")


@query("correlation_significance", f"""
SELECT "left", "right", n, round(r, 4) AS correlation, round(p, 6) AS p_value, p < 0.05 AS significant
FROM {t_tail(f'''SELECT *, n - 2 AS v, r * sqrt(n - 2) / sqrt(1 - r * r + 1e-10) AS t FROM (
  SELECT "left", "right", n, correlation AS r FROM ({PAIRS}))''')}""")
def _(t):
    return H.correlation_significance(t.lineitem, LINE)


@query("normality_k2", each(["p_size", "p_retailprice"], f"""
SELECT '{{c}}' AS "column", (SELECT count(*) FROM part) AS n, round(k2, 4) AS k2, round(exp(-k2 / 2), 6) AS p_value,
  exp(-k2 / 2) > 0.05 AS is_normal FROM ({k2_sql('{c}', 'part')})"""))
def _(t):
    return H.normality_k2_test(t.part, ["p_size", "p_retailprice"])


# The critical value is bracketed by bisection on the same tail in a recursive query.
@query("confidence_interval", """
WITH RECURSIVE s AS (SELECT count(*)::DOUBLE AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, stddev_pop(c_acctbal) AS s0 FROM customer),
b(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 4.0::DOUBLE UNION ALL
  SELECT k + 1, CASE WHEN p > 0.05 THEN mid ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE mid END FROM (
    SELECT k, lo, hi, (lo + hi) / 2 AS mid, 1 - 2 * (SELECT sum((CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
      exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * pow(1 + pow((lo + hi) / 2 * i / 1000, 2) / v, -(v + 1) / 2))
      FROM range(1001) r(i)) * (lo + hi) / 2 / 3000 AS p FROM b, (SELECT n - 1 AS v FROM s) WHERE k < 40))
SELECT 'c_acctbal' AS "column", n::BIGINT AS n, round(m, 4) AS mean, round(s0, 4) AS std, round(m - q * s / sqrt(n), 4) AS lower_bound,
  round(m + q * s / sqrt(n), 4) AS upper_bound, round(q * s / sqrt(n), 4) AS margin_of_error
FROM s, (SELECT (lo + hi) / 2 AS q FROM b WHERE k = 40)""")
def _(t):
    return H.confidence_interval(t.customer, ["c_acctbal"])


@query("variance_inflation", """
WITH n AS (SELECT l_quantity AS a, l_extendedprice AS b, l_extendedprice * (1 - l_discount) AS c FROM lineitem),
r AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM n),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
SELECT 'l_quantity' AS "column", round((1 - bc * bc) / det, 4) AS vif, (1 - bc * bc) / det > 5 AS high FROM d UNION ALL
SELECT 'l_extendedprice', round((1 - ac * ac) / det, 4), (1 - ac * ac) / det > 5 FROM d UNION ALL
SELECT 'net', round((1 - ab * ab) / det, 4), (1 - ab * ab) / det > 5 FROM d""")
def _(t):
    rows = t.lineitem.selectExpr("l_quantity", "l_extendedprice", "l_extendedprice * (1 - l_discount) AS net")
    return H.variance_inflation(rows, ["l_quantity", "l_extendedprice", "net"])


@query("breusch_pagan", """
WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
e AS (SELECT l_quantity AS x, pow(l_extendedprice - a - b * l_quantity, 2) AS e2 FROM lineitem, f),
z AS (SELECT count(*) AS n, count(*) * regr_r2(e2, x) AS lm FROM e)
SELECT n, 1::BIGINT AS df, round(lm, 4) AS lm_statistic, round(p, 6) AS p_value, p < 0.05 AS heteroscedastic FROM (
  SELECT *, greatest(0, 1 - 2 * (SELECT sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(sqrt(lm) * i / 4000, 2) / 2))
    FROM range(4001) r(i)) / sqrt(2 * pi()) * sqrt(lm) / 12000) AS p FROM z)""")
def _(t):
    return H.breusch_pagan(t.lineitem, "l_extendedprice", ["l_quantity"])


# Normal scores by Newton's method on the series of the normal integral, the p-value by Simpson's rule.
@query("shapiro_wilk", """
WITH RECURSIVE r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i, count(*) OVER () AS n
  FROM customer WHERE c_acctbal IS NOT NULL),
q(i, p, m, k) AS (SELECT i, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE), 0.0::DOUBLE, 0 FROM r UNION ALL
  SELECT i, p, m - (0.5 - p) * sqrt(2 * pi()) * exp(m * m / 2) - list_sum(list_transform(range(80),
    lambda j: pow(m, 2 * j + 1) * exp(lgamma(j + 1) + j * ln(2) - lgamma(2 * j + 2)))), k + 1 FROM q WHERE k < 25),
s AS (SELECT i, n, x, m FROM r JOIN q USING (i) WHERE k = 25),
t AS (SELECT any_value(n)::DOUBLE AS n, 1 / sqrt(any_value(n)::DOUBLE) AS u, sum(m * m) AS total, sum(m * x) AS mx, var_pop(x) * count(*) AS squares,
  max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS d1,
  max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS d2 FROM s),
a AS (SELECT *, m1 / sqrt(total) + ((((-2.706056 * u + 4.434685) * u - 2.071190) * u - 0.147981) * u + 0.221157) * u AS a1,
  m2 / sqrt(total) + ((((-3.582633 * u + 5.682633) * u - 1.752461) * u - 0.293762) * u + 0.042981) * u AS a2 FROM t),
w AS (SELECT n, ln(n) AS l, least(1, pow(a1 * d1 + a2 * d2 + (mx - m1 * d1 - m2 * d2) /
  sqrt((total - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / squares) AS w FROM a),
z AS (SELECT *, (ln(1 - w) - (((0.0038915 * l - 0.083751) * l - 0.31082) * l - 1.5861)) / exp((0.0030302 * l - 0.082676) * l - 0.4803) AS z FROM w),
p AS (SELECT *, CASE WHEN n <= 5000 THEN greatest(0, 0.5 - (SELECT sum((CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) *
  exp(-pow(z * i / 4000, 2) / 2)) FROM range(4001) r(i)) / sqrt(2 * pi()) * z / 12000) END AS p FROM z)
SELECT 'c_acctbal' AS "column", n::BIGINT AS n_samples, round(w, 4) AS statistic, round(p, 6) AS p_value, p > 0.05 AS is_normal FROM p""")
def _(t):
    return H.shapiro_test(t.customer, "c_acctbal", ["c_custkey"])
