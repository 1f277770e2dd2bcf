"""Features, models, clusters and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.statistics import each
from tabulon.operators import classify, cluster, density, features, isolation, regression
from tabulon.operators.models import hash_flag

# -- features ----------------------------------------------------------------------------------


@query("date_features", """
SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month,
  quarter(o_orderdate)::INTEGER AS o_orderdate_quarter, (isodow(o_orderdate) - 1)::INTEGER AS o_orderdate_day_of_week,
  day(o_orderdate)::INTEGER AS o_orderdate_day_of_month, weekofyear(o_orderdate)::INTEGER AS o_orderdate_week_of_year,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS o_orderdate_month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS o_orderdate_month_cos,
  date_diff('day', (SELECT min(o_orderdate) FROM orders), o_orderdate)::INTEGER AS o_orderdate_days_since_start FROM orders""")
def _(t):
    out = features.date_features(t.orders.select("o_orderkey", "o_orderdate"))
    return out.withColumn("o_orderdate_month_sin", F.round("o_orderdate_month_sin", 6)).withColumn(
        "o_orderdate_month_cos", F.round("o_orderdate_month_cos", 6)
    )


@query("encode_categorical", """
WITH c AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)),
v AS (SELECT list_sort(list(DISTINCT p_type)) AS l FROM part)
SELECT p_partkey, code::INTEGER AS p_brand, p_type = l[2] AS p_type_LARGE, p_type = l[3] AS p_type_MEDIUM,
  p_type = l[4] AS p_type_PROMO, p_type = l[5] AS p_type_SMALL, p_type = l[6] AS p_type_STANDARD FROM part JOIN c USING (p_brand), v""")
def _(t):
    return features.encode_categorical(t.part.select("p_partkey", "p_brand", "p_type"))


@query("label_codes", """
SELECT value, (row_number() OVER (ORDER BY value) - 1)::INTEGER AS code FROM (SELECT DISTINCT url AS value FROM pages)""")
def _(t):
    return features.label_codes(t.pages, "url")


@query("standard_scale", each(["l_quantity"], """
SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity FROM lineitem"""))
def _(t):
    out = features.standard_scale(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


@query("drop_low_variance", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return features.drop_low_variance(t.lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax"))


@query("log_transform", """
SELECT doc_id, round(ln(1 + abs(n_chars - 2000)), 6) AS shifted FROM documents""")
def _(t):
    rows = t.documents.select("doc_id", (F.col("n_chars") - F.lit(2000)).alias("shifted"))
    out = features.repair_skew(rows, ["shifted"])
    return out.withColumn("shifted", F.round("shifted", 6))


@query("box_cox")
def _(t):
    return features.repair_skew(t.documents.select("doc_id", "n_chars"), ["n_chars"])


@query("engineered_features")
def _(t):
    return features.engineered_features(
        t.orders.select("o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice"), target="o_totalprice"
    )


# -- regression --------------------------------------------------------------------------------

NET = "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge"


def charged(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", NET)


# Two features, so the normal equations can be written out; the split is by order key.
TWO_FEATURES = f"""
WITH n AS (SELECT l_orderkey % 5 <> 0 AS tr, l_quantity AS q, l_extendedprice AS p, {NET.replace(' AS charge', '')} AS y FROM lineitem),
m AS (SELECT count(*)::DOUBLE AS n, avg(q) AS mq, stddev_pop(q) AS sq, avg(p) AS mp, stddev_pop(p) AS sp, avg(y) AS my, corr(q, p) AS r,
  covar_pop(q, y) / stddev_pop(q) AS cq, covar_pop(p, y) / stddev_pop(p) AS cp FROM n WHERE tr),
b AS (SELECT *, {{a}} AS d, ((d) * cq - r * cp) / (d * d - r * r) AS bq, ((d) * cp - r * cq) / (d * d - r * r) AS bp FROM m),
e AS (SELECT tr, y, y - (my + bq * (q - mq) / sq + bp * (p - mp) / sp) AS e FROM n, b)"""


def metrics_sql(name: str, alpha: str, best: bool) -> str:
    return TWO_FEATURES.replace("{a}", alpha) + f"""
SELECT '{name}' AS model, count(*) FILTER (tr) AS train_rows, count(*) FILTER (NOT tr) AS test_rows,
  round(1 - avg(e * e) FILTER (tr) / var_pop(y) FILTER (tr), 4) AS train_r2, round(1 - avg(e * e) FILTER (NOT tr) / var_pop(y) FILTER (NOT tr), 4) AS r2,
  round(sqrt(avg(e * e) FILTER (NOT tr)), 4) AS rmse, round(avg(abs(e)) FILTER (NOT tr), 4) AS mae, false AS overfit, {str(best).lower()} AS best FROM e"""


def by_order():
    return F.col("l_orderkey") % 5 != 0


@query("linear_regression", metrics_sql("linear", "1.0", True))
def _(t):
    return regression.linear_models(charged(t), "charge", ["l_quantity", "l_extendedprice"], by_order(),
                                    {"linear": ("plain", 0.0, 0.0)})


@query("ridge_regression", metrics_sql("ridge", "1 + 1 / n", True))
def _(t):
    return regression.linear_models(charged(t), "charge", ["l_quantity", "l_extendedprice"], by_order(),
                                    {"ridge": ("ridge", 1.0, 0.0)})


@query("linear_coefficients", TWO_FEATURES.replace("{a}", "1.0") + """
SELECT 'linear' AS model, 'l_quantity' AS feature, round(bq, 4) AS coefficient, round(abs(bq) / (abs(bq) + abs(bp)), 4) AS importance FROM b UNION ALL
SELECT 'linear', 'l_extendedprice', round(bp, 4), round(abs(bp) / (abs(bq) + abs(bp)), 4) FROM b""")
def _(t):
    return regression.linear_coefficients(charged(t), "charge", ["l_quantity", "l_extendedprice"], by_order(),
                                          {"linear": ("plain", 0.0, 0.0)})


# With one standardised feature the penalised solution is a soft threshold and a shrinkage.
ONE_FEATURE = f"""
WITH n AS (SELECT l_orderkey % 5 <> 0 AS tr, l_extendedprice AS p, {NET.replace(' AS charge', '')} AS y FROM lineitem),
m AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(y) AS my, covar_pop(p, y) / stddev_pop(p) AS c FROM n WHERE tr),
k AS (SELECT 'lasso' AS model, 1.0 AS a, 1.0 AS l UNION ALL SELECT 'elastic_net', 1.0, 0.5),
b AS (SELECT *, sign(c) * greatest(abs(c) - a * l, 0) / (1 + a * (1 - l)) AS bp FROM m, k),
e AS (SELECT model, tr, y, y - (my + bp * (p - mp) / sp) AS e FROM n, b)"""


@query("lasso_and_elastic_net", ONE_FEATURE + """
SELECT model, count(*) FILTER (tr) AS train_rows, count(*) FILTER (NOT tr) AS test_rows,
  round(1 - avg(e * e) FILTER (tr) / var_pop(y) FILTER (tr), 4) AS train_r2, round(1 - avg(e * e) FILTER (NOT tr) / var_pop(y) FILTER (NOT tr), 4) AS r2,
  round(sqrt(avg(e * e) FILTER (NOT tr)), 2) AS rmse, round(avg(abs(e)) FILTER (NOT tr), 2) AS mae, false AS overfit, model = 'lasso' AS best FROM e GROUP BY 1""")
def _(t):
    out = regression.linear_models(charged(t), "charge", ["l_extendedprice"], by_order(),
                                   {"lasso": ("net", 1.0, 1.0), "elastic_net": ("net", 1.0, 0.5)})
    return out.withColumn("rmse", F.round("rmse", 2)).withColumn("mae", F.round("mae", 2))


@query("model_comparison")
def _(t):
    return regression.linear_models(
        charged(t), "charge", ["l_quantity", "l_extendedprice"], hash_flag(["l_orderkey", "l_linenumber"])
    )


def priced_orders(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_custkey", "o_totalprice")


@query("mixed_regression")
def _(t):
    rows = priced_orders(t)
    metrics, _, _ = regression.mixed_regression(rows, "o_totalprice", hash_flag(["o_orderkey"]))
    return metrics


@query("residual_checks")
def _(t):
    _, _, checks = regression.mixed_regression(priced_orders(t), "o_totalprice", hash_flag(["o_orderkey"]))
    return checks


@query("forest_regression")
def _(t):
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    metrics, _ = regression.forest_regression(rows, "p_retailprice", ["p_partkey", "p_size"], hash_flag(["p_partkey"]))
    return metrics


# -- classification ----------------------------------------------------------------------------


def labelled(t):
    text = F.col("text")
    letters = F.length(text)
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "quality", "toxic", "n_chars",
        (F.length(F.regexp_replace(text, "[^0-9]", "")) / F.greatest(letters, F.lit(1))).alias("digit_share"),
        (F.length(F.regexp_replace(text, "[^\n]", "")) / F.greatest(letters, F.lit(1))).alias("line_share"),
        (letters / F.greatest(F.size(F.split(text, r"\s+")), F.lit(1))).alias("word_length"),
    )


FEATURES = ["n_chars", "digit_share", "line_share", "word_length"]


@query("classification")
def _(t):
    return classify.classification_metrics(labelled(t), "quality", FEATURES, hash_flag(["doc_id"]))


@query("feature_importance")
def _(t):
    return classify.feature_importance(labelled(t), "quality", FEATURES, hash_flag(["doc_id"]))


@query("batch_predict")
def _(t):
    rows = labelled(t)
    model = classify.train(rows, "quality", FEATURES, hash_flag(["doc_id"]))
    return model.transform(rows).select("doc_id", "quality", "predicted")


# The metrics themselves are exact: a fixed rule stands in for a model.
@query("classifier_scores", """
WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS g FROM documents JOIN labels USING (doc_id)),
c AS (SELECT v, count(*) FILTER (y = v)::DOUBLE AS a, count(*) FILTER (g = v)::DOUBLE AS q, count(*) FILTER (y = v AND g = v)::DOUBLE AS r
  FROM p, (SELECT unnest([0, 1]) AS v) GROUP BY 1)
SELECT sum(a)::BIGINT AS test_rows, round(sum(r) / sum(a), 4) AS accuracy, round(sum(a * CASE WHEN q > 0 THEN r / q ELSE 0 END) / sum(a), 4) AS precision,
  round(sum(a * CASE WHEN a > 0 THEN r / a ELSE 0 END) / sum(a), 4) AS recall, round(sum(a * CASE WHEN a + q > 0 THEN 2 * r / (a + q) ELSE 0 END) / sum(a), 4) AS f1 FROM c""")
def _(t):
    rows = t.documents.join(t.labels, "doc_id").withColumn("predicted", F.when(F.col("n_chars") > 400, 1).otherwise(0))
    return classify.evaluate(rows, "quality")


# -- clusters ----------------------------------------------------------------------------------

LINE = ["l_quantity", "l_extendedprice", "l_discount"]


@query("segmentation")
def _(t):
    return cluster.segment(t.lineitem, LINE, k=3)


@query("silhouette_by_k")
def _(t):
    return cluster.silhouette_table(t.customer.select("c_acctbal", "c_nationkey"))


@query("cluster_quality")
def _(t):
    rows = t.customer.select("c_acctbal", "c_nationkey")
    found = cluster.kmeans(rows, k=3)
    return cluster.cluster_quality(found.assign(rows), 2)


def _steps_sql(steps: int) -> str:
    """Lloyd's iteration from three given centres, step by step."""
    parts = ["p AS (SELECT row_number() OVER () AS line, l_quantity::DOUBLE AS x, l_extendedprice / 1000 AS y FROM lineitem)",
             "c0(id, x, y) AS (VALUES (0, 5.0, 10.0), (1, 25.0, 40.0), (2, 45.0, 70.0))"]
    for i in range(steps + 1):
        parts.append(f"""a{i} AS (SELECT p.*, c.id, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 AS d FROM p CROSS JOIN c{i} c
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY d, c.id) = 1)""")
        parts.append(f"c{i + 1} AS (SELECT id, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY id)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT id AS cluster_id, count(*) AS size, round(avg(x), 4) AS mean_x, round(avg(y), 4) AS mean_y, round(sum(d), 2) AS cost
FROM a{steps} GROUP BY id"""


@query("kmeans_given_centres", _steps_sql(4))
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    found = cluster.kmeans_from(rows, [[5, 10], [25, 40], [45, 70]], ["x", "y"], steps=4).assign(rows)
    return found.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.avg("y"), 4).alias("mean_y"),
        F.round(F.sum("_d2"), 2).alias("cost"),
    )


# Quality of a given grouping is exact: part types stand in for clusters.
@query("grouping_quality", """
WITH p AS (SELECT p_type AS g, p_size / 10.0 AS a, p_retailprice / 100.0 AS b FROM part),
c AS (SELECT g, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM p GROUP BY 1),
s AS (SELECT g, avg(sqrt(pow(a - ca, 2) + pow(b - cb, 2))) AS s, sum(pow(a - ca, 2) + pow(b - cb, 2)) AS w FROM p JOIN c USING (g) GROUP BY 1),
d AS (SELECT x.g, max((sx.s + sy.s) / sqrt(pow(x.ca - y.ca, 2) + pow(x.cb - y.cb, 2))) AS r FROM c x JOIN c y ON x.g <> y.g
  JOIN s sx ON sx.g = x.g JOIN s sy ON sy.g = y.g GROUP BY 1),
k AS (SELECT count(*) AS k, sum(n) AS n, sum(n * ca) / sum(n) AS ga, sum(n * cb) / sum(n) AS gb FROM c)
SELECT any_value(k)::INTEGER AS clusters, any_value(k.n)::BIGINT AS rows, (SELECT round(avg(r), 4) FROM d) AS davies_bouldin,
  round(sum(c.n * (pow(ca - ga, 2) + pow(cb - gb, 2))) / (any_value(k) - 1) / ((SELECT sum(w) FROM s) / (any_value(k.n) - any_value(k))), 4) AS calinski_harabasz
FROM c, k""")
def _(t):
    rows = t.part.select(
        F.col("p_type").alias("cluster_id"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 100.0).alias("_scaled")
    )
    return cluster.cluster_quality(rows, 2)


# -- anomalies and density ---------------------------------------------------------------------


@query("isolation_forest")
def _(t):
    return isolation.isolation_forest(
        t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], ["o_orderkey"]
    )


@query("anomaly_summary")
def _(t):
    return isolation.anomaly_summary(
        t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"),
        LINE, ["l_orderkey", "l_linenumber"], contamination=0.05,
    )


# All pairs and their closure are affordable on 1,500 customers only.
@query("density_clusters", """
WITH RECURSIVE p AS MATERIALIZED (SELECT c_custkey AS id, c_acctbal / 100 AS x, c_nationkey * 2.0 AS y FROM customer),
n AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1.2 * 1.2
  AND b.x BETWEEN a.x - 1.2 AND a.x + 1.2),
c AS MATERIALIZED (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 5),
e AS MATERIALIZED (SELECT a, b FROM n WHERE a IN (FROM c) AND b IN (FROM c)),
r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a AS id, min(b) AS cluster_id FROM r GROUP BY 1),
k AS (SELECT a AS id, min(cluster_id) AS cluster_id FROM n JOIN l ON n.b = l.id WHERE a NOT IN (FROM c) GROUP BY 1)
SELECT id AS c_custkey, coalesce(l.cluster_id, k.cluster_id) AS cluster_id, l.id IS NOT NULL AS core
FROM p LEFT JOIN l USING (id) LEFT JOIN k USING (id)""")
def _(t):
    rows = t.customer.select("c_custkey", (F.col("c_acctbal") / 100).alias("x"), (F.col("c_nationkey") * 2.0).alias("y"))
    return density.dbscan(rows, ["x", "y"], "c_custkey", eps=1.2, min_points=5)
