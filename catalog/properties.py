"""Properties that hold for results SQL cannot compute row by row: sizes, bounds, shares, order."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from catalog.learning import FEATURES, LINE, charged, labelled
from catalog.series import DAILY, MONTHLY, points
from tabulon.operators import classify, cluster, cluster_job, features, isolation, regression, relational
from tabulon.operators import smoothing as M
from tabulon.operators.models import hash_flag


@query("sample_properties", """
SELECT 1000::BIGINT AS sampled, 1000::BIGINT AS different, 1000::BIGINT AS from_table""")
def _(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    picked = relational.hash_sample(t.lineitem, key, 1000).select(*key)
    inside = picked.join(t.lineitem.select(*key).distinct(), key, "left_semi")
    return picked.agg(F.count(F.lit(1)).alias("sampled")).select(
        "sampled",
        picked.distinct().agg(F.count(F.lit(1))).scalar().alias("different"),
        inside.agg(F.count(F.lit(1))).scalar().alias("from_table"),
    )


@query("split_properties", "SELECT count(*) AS total, true AS four_fifths FROM lineitem")
def _(t):
    flag = hash_flag(["l_orderkey", "l_linenumber"])
    return t.lineitem.agg(
        F.count(F.lit(1)).alias("total"), (F.abs(F.avg(flag.cast("double")) - 0.8) < 0.02).alias("four_fifths")
    )


FORECAST_SQL = """
SELECT o_orderpriority AS series, 12::BIGINT AS steps, true AS bracketed, (date_trunc('month', max(o_orderdate)) + INTERVAL 12 MONTH)::DATE AS last_date
FROM orders GROUP BY 1"""


def forecast_check(df):
    return df.groupBy("series").agg(
        F.count(F.lit(1)).alias("steps"),
        F.bool_and((F.col("lower") <= F.col("predicted")) & (F.col("predicted") <= F.col("upper"))).alias("bracketed"),
        F.max("date").alias("last_date"),
    )


@query("smoothing_properties", FORECAST_SQL)
def _(t):
    return forecast_check(M.smoothing_forecast(points(t), 12))


@query("best_forecast_properties", FORECAST_SQL)
def _(t):
    return forecast_check(M.best_forecast(points(t), 12))


@query("backtest_line_errors", MONTHLY + """
, f AS (SELECT series, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM o WHERE x < floor(n * 0.8) GROUP BY 1)
SELECT series, round(sqrt(avg(pow(value - a - b * x, 2))), 2) AS rmse, round(avg(abs(value - a - b * x)), 2) AS mae
FROM o JOIN f USING (series) WHERE x >= floor(n * 0.8) GROUP BY 1""")
def _(t):
    rows = M.backtest(points(t)).filter("method = 'linear_trend'")
    return rows.select("series", F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"))


# The regression behind the unit-root test, without lagged differences.
@query("unit_root_plain", DAILY + """
, d AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY ts) AS dy, lag(value) OVER (PARTITION BY series ORDER BY ts) AS y FROM p)
SELECT series, round(regr_slope(dy, y) / sqrt((regr_syy(dy, y) - pow(regr_sxy(dy, y), 2) / regr_sxx(dy, y)) / (count(dy) - 2) / regr_sxx(dy, y)), 4) AS statistic
FROM d WHERE dy IS NOT NULL GROUP BY 1""")
def _(t):
    def run(pdf):
        fit = M._adf_fit(pdf.sort_values("ts")["value"].to_numpy(dtype=float), 0, 0)
        return pdf.iloc[:1][["series"]].assign(statistic=round(fit[0], 4))

    return points(t, "day").groupBy("series").applyInPandas(run, "series string, statistic double")


@query("segment_planted", """
SELECT count(*) AS size, round(count(*) / (SELECT count(*) FROM customer), 4) AS share,
  round(avg(c_custkey % 3 * 1000 + c_acctbal / 1000), 4) AS mean_big, round(avg(c_custkey % 2), 4) AS mean_flag
FROM customer GROUP BY c_custkey % 3""")
def _(t):
    rows = t.customer.selectExpr("c_custkey % 3 * 1000 + c_acctbal / 1000 AS big", "CAST(c_custkey % 2 AS double) AS flag")
    return cluster.segment(rows, ["big", "flag"], k=3).select("size", "share", "mean_big", "mean_flag")


@query("anomaly_share", """
SELECT count(*) AS rows, (count(*) - 1 - floor((count(*) - 1) * 0.95))::BIGINT AS anomaly_count FROM orders""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", (F.col("o_custkey") * 1.0).alias("customer"))
    found = isolation.isolation_forest(rows, ["o_totalprice", "customer"], ["o_orderkey"], contamination=0.05)
    return found.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anomaly").alias("anomaly_count"))


@query("prediction_properties", "SELECT count(*) AS rows, true AS known_classes FROM documents JOIN labels USING (doc_id)")
def _(t):
    rows = labelled(t)
    model = classify.train(rows, "toxic", FEATURES, hash_flag(["doc_id"]), "random_forest")
    return model.transform(rows).agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("predicted").isin(0, 1)).alias("known_classes")
    )


@query("model_order", "SELECT 'lasso' AS model, true AS fits UNION ALL SELECT 'linear', true UNION ALL SELECT 'ridge', true")
def _(t):
    out = regression.linear_models(
        charged(t), "charge", ["l_quantity", "l_extendedprice"], hash_flag(["l_orderkey", "l_linenumber"])
    )
    return out.filter("model <> 'elastic_net'").select(
        "model", ((F.col("r2") > 0.9) & (F.col("r2") <= 1) & (F.col("mae") <= F.col("rmse"))).alias("fits")
    )


@query("box_cox_power", """
SELECT round(arg_min(l, v), 1) AS power FROM (
  SELECT l, var_pop(CASE WHEN abs(l) < 1e-9 THEN ln(x) ELSE (pow(x, l) - 1) / l END) AS v FROM
    (SELECT (n_chars + 1) / exp((SELECT avg(ln(n_chars + 1)) FROM documents)) AS x FROM documents), (SELECT unnest(range(-400, 401)) / 100.0 AS l)
  GROUP BY l)""")
def _(t):
    power = features.box_cox_lambda(t.documents, F.col("n_chars").cast("double") + 1)
    return t.documents.agg(F.round(F.lit(power), 1).alias("power"))


# Every 50th customer lies far off, the others in two groups.
PLANTED = """SELECT c_custkey, c_custkey % 50 = 0 AS far, CASE WHEN c_custkey % 50 = 0 THEN 10000 + c_custkey * 10 ELSE c_custkey % 2 * 100 END
  + CAST(c_acctbal AS DOUBLE) / 10000 AS a, CASE WHEN c_custkey % 50 = 0 THEN -10000 - c_custkey * 10 ELSE c_custkey % 2 * 100 END
  - CAST(c_acctbal AS DOUBLE) / 10000 AS b FROM customer"""


def planted(t):
    t.customer.createOrReplaceTempView("customer")
    return t.spark.sql(PLANTED)


@query("anomaly_planted", "SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0")
def _(t):
    found = isolation.isolation_forest(planted(t), ["a", "b"], ["c_custkey"], contamination=0.02)
    return found.filter("anomaly").select("c_custkey")


@query("cluster_outliers_planted", f"""
SELECT CASE WHEN far THEN 'outlier' ELSE 'segment' END AS type, count(*) AS size, round(count(*) / (SELECT count(*) FROM customer), 4) AS share,
  round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b FROM ({PLANTED}) GROUP BY far, CASE WHEN far THEN 0 ELSE c_custkey % 2 END""")
def _(t):
    rows = cluster_job.cluster_rows(planted(t), "c_custkey", ["a", "b"], contamination=0.02)
    return cluster.cluster_summary(rows, ["a", "b"]).select("type", "size", "share", "mean_a", "mean_b")


@query("cluster_count_planted", """
SELECT count(*) AS size, round(avg(c_custkey % 3 * 100), 4) AS mean_a, round(avg(CASE WHEN c_custkey % 3 = 1 THEN 100 ELSE 0 END), 4) AS mean_b
FROM customer GROUP BY c_custkey % 3""")
def _(t):
    rows = t.customer.selectExpr(
        "c_custkey", "CAST(c_custkey % 3 * 100 AS double) AS a", "CAST(IF(c_custkey % 3 = 1, 100, 0) AS double) AS b"
    )
    found = cluster_job.cluster_rows(rows, "c_custkey", ["a", "b"])
    return cluster.cluster_summary(found, ["a", "b"]).select("size", "mean_a", "mean_b")


def separable(t):
    return t.customer.selectExpr(
        "c_custkey", "CAST(c_custkey % 2 AS int) AS side", "c_custkey % 2 * 100 AS flag", "CAST(c_acctbal AS double) AS noise"
    )


@query("predict_planted", "SELECT c_custkey, (c_custkey % 2)::INTEGER AS predicted FROM customer")
def _(t):
    rows = separable(t)
    model = classify.train(rows, "side", ["flag", "noise"], hash_flag(["c_custkey"]), "random_forest")
    return model.transform(rows).select("c_custkey", "predicted")


@query("accuracy_planted", """
SELECT model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1
FROM (SELECT unnest(['logistic', 'random_forest', 'gradient_boosting']) AS model)""")
def _(t):
    out = classify.classification_metrics(separable(t), "side", ["flag", "noise"], hash_flag(["c_custkey"]))
    return out.drop("test_rows")
