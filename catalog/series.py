"""Time series by order priority and over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import query
from tabulon.operators import smoothing as M
from tabulon.operators import timeseries as K
from tabulon.streaming import windows

POINTS = """p AS (SELECT o_orderpriority AS series, date_trunc('{g}', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS value
  FROM orders GROUP BY 1, 2),
o AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY ts) - 1)::INTEGER AS x, count(*) OVER (PARTITION BY series) AS n FROM p)"""
MONTHLY, DAILY = "WITH " + POINTS.format(g="month"), "WITH " + POINTS.format(g="day")


def points(t, grain="month"):
    return K.regularize(t.orders, "o_orderdate", "o_totalprice", grain, "o_orderpriority")


@query("regularize", MONTHLY + " SELECT series, ts, round(value, 2) AS value FROM p")
def _(t):
    return points(t).withColumn("value", F.round("value", 2))


@query("ordinal", DAILY + " SELECT series, ts, x FROM o")
def _(t):
    return K.ordinal(points(t, "day")).select("series", "ts", "x")


@query("rolling_mean", MONTHLY + """
SELECT series, ts, round(value, 2) AS value, least(7, n // 3)::INTEGER AS window,
  CASE WHEN x + 1 >= least(7, n // 3) THEN round(avg(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) END
  AS rolling_mean FROM o""")
def _(t):
    return K.rolling_mean(points(t)).withColumn("value", F.round("value", 2)).withColumn(
        "rolling_mean", F.round("rolling_mean", 4)
    )


DRIFT = """, w AS (SELECT series, least(7, any_value(n) // 3) AS w, any_value(n) AS n FROM o GROUP BY 1),
m AS (SELECT series, any_value(w) AS w, any_value(w.n) AS n, avg(value) FILTER (x >= o.n - w) AS mw, avg(value) FILTER (x >= o.n - 2 * w) AS m2w,
  max_by(value, x) AS last, avg(value) AS average FROM o JOIN w USING (series) GROUP BY 1)"""


@query("recent_means", MONTHLY + DRIFT + """
SELECT series, n AS points, w::BIGINT AS window, round(last, 4) AS last_value, round(average, 4) AS average,
  round(mw, 4) AS mean_w, round(m2w, 4) AS mean_2w FROM m""")
def _(t):
    out = K.recent_means(points(t))
    return out.select("series", "points", "window", *[F.round(c, 4).alias(c) for c in ("last_value", "average", "mean_w", "mean_2w")])


@query("moving_average_forecast", MONTHLY + DRIFT + """
SELECT series, step::INTEGER AS step, w::BIGINT AS window, CASE WHEN n < 50 THEN 'low' ELSE 'medium' END AS confidence,
  round((mw - m2w) / w, 4) AS trend, round(mw + (mw - m2w) / w * step, 4) AS forecast FROM m, range(1, 6) r(step)""")
def _(t):
    return K.moving_average_forecast(points(t))


@query("timestamp_gaps", """
SELECT 'all' AS series, ts, date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 86400000000 AS gap_days
FROM (SELECT DISTINCT ts FROM events)""")
def _(t):
    return K.distinct_gaps(t.events, "ts")


LABEL = """CASE WHEN {m} <= 1.5 THEN 'daily' WHEN {m} <= 8 THEN 'weekly' WHEN {m} <= 32 THEN 'monthly'
  WHEN {m} <= 100 THEN 'quarterly' ELSE 'yearly' END"""


@query("median_gap", f"""
SELECT count(*) AS timestamps, round(median(g), 4) AS median_gap_days, {LABEL.format(m='median(g)')} AS frequency FROM (
  SELECT date_diff('microsecond', lag(d) OVER (ORDER BY d), d) / 86400000000 AS g FROM (SELECT DISTINCT o_orderdate AS d FROM orders))""")
def _(t):
    return K.median_gap(t.orders, "o_orderdate")


@query("series_frequency", f"""
SELECT c::VARCHAR AS series, count(*) AS timestamps, round(median(g), 4) AS median_gap_days,
  CASE WHEN count(*) >= 3 AND median(g) IS NOT NULL THEN {LABEL.format(m='median(g)')} END AS frequency FROM (
  SELECT c, date_diff('microsecond', lag(d) OVER (PARTITION BY c ORDER BY d), d) / 86400000000 AS g
  FROM (SELECT DISTINCT o_custkey AS c, o_orderdate AS d FROM orders)) GROUP BY 1""")
def _(t):
    return K.series_frequency(t.orders, "o_orderdate", "o_custkey")


@query("gap_check", """
SELECT count(o_totalprice) AS data_points, min(o_orderdate) AS "first", max(o_orderdate) AS "last",
  count(*) - count(DISTINCT o_orderdate) AS duplicates,
  (SELECT count(*) FROM (SELECT d - lag(d) OVER (ORDER BY d) AS g FROM (SELECT DISTINCT o_orderdate AS d FROM orders)) WHERE g > INTERVAL 1 DAY) AS gaps
FROM orders""")
def _(t):
    return K.gap_check(t.orders, "o_orderdate", "o_totalprice")


@query("first_last", MONTHLY + """
SELECT series, round(min_by(value, ts), 2) AS first_value, round(max_by(value, ts), 2) AS last_value FROM p GROUP BY 1""")
def _(t):
    out = K.first_last(points(t))
    return out.select("series", F.round("first_value", 2).alias("first_value"), F.round("last_value", 2).alias("last_value"))


@query("series_growth", MONTHLY + """
SELECT series, count(*) AS periods, round((max_by(value, ts) - min_by(value, ts)) / abs(min_by(value, ts)) * 100, 4) AS growth_pct FROM p GROUP BY 1""")
def _(t):
    return K.growth(points(t))


@query("seasonality", """
SELECT series, sum(n)::BIGINT AS rows, round(stddev_pop(m) / avg(m), 4) AS seasonality_index FROM (
  SELECT o_orderpriority AS series, month(o_orderdate), avg(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return K.seasonality(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority")


@query("volatility", """
SELECT o_orderpriority AS series, round(stddev_pop(o_totalprice) / abs(avg(o_totalprice)) * 100, 4) AS volatility_index FROM orders GROUP BY 1""")
def _(t):
    return K.volatility_index(t.orders, "o_totalprice", "o_orderpriority")


@query("trend_strength", DAILY + " SELECT series, round(corr(x, value), 4) AS trend_strength FROM o GROUP BY 1")
def _(t):
    return K.trend_strength(points(t, "day"))


@query("autocorrelation", DAILY + """
SELECT series, round(sum((value - m) * (l - m)) / sum((value - m) * (value - m)), 4) AS lag_1_autocorrelation FROM (
  SELECT series, value, avg(value) OVER (PARTITION BY series) AS m, lag(value) OVER (PARTITION BY series ORDER BY ts) AS l FROM p) GROUP BY 1""")
def _(t):
    return K.autocorrelation(points(t, "day"))


@query("linear_trend", DAILY + """
SELECT series, CASE WHEN regr_slope(value, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, round(regr_slope(value, x), 4) AS slope,
  count(*) AS data_points, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, round(avg(value), 4) AS avg_value FROM o GROUP BY 1""")
def _(t):
    return K.linear_trend(points(t, "day"))


FIT = """, f AS (SELECT series, any_value(n) AS n, max(ts) AS last, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, regr_r2(value, x) AS r2,
  stddev_pop(value) AS sd, sqrt(regr_syy(value, x) * (1 - regr_r2(value, x)) / count(*)) AS rd FROM o GROUP BY 1),
y AS (SELECT f.*, step::INTEGER AS step, a + b * (n - 1 + step) AS v FROM f, range(1, {k}) r(step))"""


def forecast_sql(grain_sql: str, width: str, day: str, k: int = 6) -> str:
    return grain_sql + FIT.format(k=k) + f"""
SELECT series, step, ({day})::DATE AS date, round(b, 4) AS slope, round(a, 4) AS intercept, round(r2, 4) AS r_squared,
  round(v, 4) AS predicted, round(v - 1.96 * {width}, 4) AS lower, round(v + 1.96 * {width}, 4) AS upper FROM y"""


@query("linear_forecast", forecast_sql(MONTHLY, "sd", "last + to_months(step)"))
def _(t):
    return K.linear_forecast(points(t))


@query("linear_forecast_residual", forecast_sql(DAILY, "rd", "last + to_days(step)"))
def _(t):
    return K.linear_forecast(points(t, "day"), bounds="residual")


@query("forecast_trend", MONTHLY + FIT.format(k=31) + """
SELECT series, CASE WHEN (max_by(v, step) - min_by(v, step)) / abs(min_by(v, step)) * 100 > 5 THEN 'increasing'
  WHEN (max_by(v, step) - min_by(v, step)) / abs(min_by(v, step)) * 100 < -5 THEN 'decreasing' ELSE 'flat' END AS trend FROM y GROUP BY 1""")
def _(t):
    return K.forecast_trend(K.linear_forecast(points(t), 30))


@query("step_trend", MONTHLY + FIT.format(k=2) + """
SELECT series, CASE WHEN v > l THEN 'increasing' WHEN v < l THEN 'decreasing' ELSE 'flat' END AS trend,
  round((round(v, 4) - l) / l * 100, 4) AS predicted_change_pct
FROM y JOIN (SELECT series, max_by(value, ts) AS l FROM p GROUP BY 1) USING (series)""")
def _(t):
    pts = points(t)
    return K.step_trend(pts, K.linear_forecast(pts, 1))


@query("seasonal_period", MONTHLY + """
SELECT series, 'monthly' AS frequency, count(*) AS points, 12 AS seasonal_period, 12 AS smoothing_period, count(*) >= 365 AS yearly FROM p GROUP BY 1
UNION ALL SELECT series, 'daily', count(*), 7, 7, count(*) >= 365 FROM (SELECT DISTINCT o_orderpriority || ' by day' AS series, date_trunc('day', o_orderdate) FROM orders) GROUP BY 1""")
def _(t):
    days = points(t, "day").withColumn("series", F.concat("series", F.lit(" by day")))
    return K.seasonal_period(points(t).unionByName(days))


@query("backtest_linear", DAILY + """
, f AS (SELECT series, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM o WHERE x < floor(n * 0.8) GROUP BY 1)
SELECT series, count(*) AS test_points, round(sqrt(avg(pow(value - a - b * x, 2))), 4) AS rmse, round(avg(abs(value - a - b * x)), 4) AS mae
FROM o JOIN f USING (series) WHERE x >= floor(n * 0.8) GROUP BY 1""")
def _(t):
    return K.backtest_linear(points(t, "day"))


def smoothed(source: str, name: str) -> str:
    """Tables of a query: `name` has, for each series of source(series, x, y), the state behind its last point and the sums of the
    errors under the parameters of least squared error: a grid, then two finer ones. Seasons of twelve."""
    state = f"""
{name}_i AS (SELECT series, avg(y) FILTER (x < 12) AS level, (avg(y) FILTER (x >= 12 AND x < 24) - avg(y) FILTER (x < 12)) / 12 AS trend,
  list(y ORDER BY x) FILTER (x < 12) AS ys, count(*) AS n FROM {source} GROUP BY 1),
{name}_0 AS (SELECT series, level, trend, n, list_transform(ys, lambda v: v - level) AS season FROM {name}_i)"""
    first = "(SELECT unnest([0.05, 0.2, 0.4, 0.6, 0.8, 0.95])::DOUBLE AS v)"
    for turn, width in ((1, 0), (2, 0.1), (3, 0.025)):
        if turn == 1:
            grid = f"SELECT series, a.v AS a, b.v AS b, g.v AS g FROM {name}_0, {first} a, {first} b, {first} g"
        else:
            steps = f"(SELECT unnest([{-width}, {-width / 2}, 0, {width / 2}, {width}])::DOUBLE AS v)"
            near = [f"least(0.999::DOUBLE, greatest(0.001::DOUBLE, c.{x} + {x}.v)) AS {x}" for x in "abg"]
            grid = f"SELECT DISTINCT c.series, {', '.join(near)} FROM {name}_{turn - 1} c, {steps} a, {steps} b, {steps} g"
        state += f""",
{name}_f{turn}(series, a, b, g, n, x, level, trend, season, se, sse) AS (
  SELECT series, a, b, g, n, 0, level, trend, season, 0::DOUBLE, 0::DOUBLE FROM ({grid}) JOIN {name}_0 USING (series)
  UNION ALL
  SELECT series, a, b, g, n, x + 1, now, b * (now - level) + (1 - b) * trend,
    list_transform(season, lambda v, i: CASE WHEN i = x % 12 + 1 THEN g * (y - now) + (1 - g) * s ELSE v END), se + e, sse + e * e
  FROM (SELECT *, a * (y - s) + (1 - a) * (level + trend) AS now, y - (level + trend + s) AS e
    FROM (SELECT f.*, y, season[f.x % 12 + 1] AS s FROM {name}_f{turn} f JOIN {source} p ON p.series = f.series AND p.x = f.x))),
{name}_{turn} AS (SELECT * FROM {name}_f{turn} WHERE x = n QUALIFY row_number() OVER (PARTITION BY series ORDER BY sse, a, b, g) = 1)"""
    return state + f",\n{name} AS (SELECT * FROM {name}_3)"


RECURSIVE = MONTHLY.replace("WITH", "WITH RECURSIVE", 1) + """,
whole AS (SELECT series, x, value AS y, n, ts FROM o),
early AS (SELECT * FROM whole WHERE x < floor(n * 0.8)),
steps AS (SELECT unnest(range(1, 13))::INTEGER AS step),
ends AS (SELECT series, max(ts) AS last FROM whole GROUP BY 1),"""
AHEAD = """
curves AS (SELECT series, 'exponential_smoothing' AS method, step, level + trend * step + season[(n + step - 1) % 12 + 1] AS y,
  1.96 * sqrt(sse / n - pow(se / n, 2)) AS half FROM fit, steps)"""
BACKTESTED = smoothed("early", "trial") + """,
line AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM early GROUP BY 1),
gaps AS (SELECT w.series, 'linear_trend' AS method, y - a - b * x AS gap FROM whole w JOIN line USING (series) WHERE x >= floor(n * 0.8)
  UNION ALL SELECT w.series, 'exponential_smoothing', y - level - trend * (w.x - t.n + 1) - season[w.x % 12 + 1] FROM whole w JOIN trial t USING (series) WHERE w.x >= t.n),
errors AS (SELECT series, method, sqrt(avg(gap * gap)) AS rmse, avg(abs(gap)) AS mae FROM gaps GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rmse, method) = 1 AS best FROM errors)"""
DATED = """
SELECT series, method, step, (last + to_months(step))::DATE AS date, round(y, 4) AS predicted, round(y - half, 4) AS lower, round(y + half, 4) AS upper
FROM {rows} JOIN ends USING (series)"""


@query("smoothing_forecast", RECURSIVE + smoothed("whole", "fit") + "," + AHEAD + DATED.format(rows="curves"))
def _(t):
    return M.smoothing_forecast(points(t), 12)


@query("backtest_methods", RECURSIVE + BACKTESTED + """
SELECT series, method, round(rmse, 4) AS rmse, round(mae, 4) AS mae, best FROM ranked""")
def _(t):
    return M.backtest(points(t))


@query("best_forecast", RECURSIVE + BACKTESTED + "," + smoothed("whole", "fit") + "," + AHEAD + """,
full_line AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM whole GROUP BY 1),
spread AS (SELECT series, stddev_pop(y - a - b * x) AS s FROM whole JOIN full_line USING (series) GROUP BY 1),
either AS (SELECT * FROM curves UNION ALL
  SELECT series, 'linear_trend', step, a + b * (n + step - 1), 1.96 * s FROM full_line JOIN spread USING (series), steps),
won AS (SELECT either.* FROM either JOIN ranked USING (series, method) WHERE best)""" + DATED.format(rows="won"))
def _(t):
    return M.best_forecast(points(t), 12)


@query("stationarity")
def _(t):
    return M.stationarity(points(t))


@query("event_windows", """
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS window_end,
  event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3""")
def _(t):
    return windows.event_counts(t.events, "ts", "event_type", "value", "1 hour")


@query("recent_events", "SELECT event_id, ts, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(t):
    return windows.recent_events(t.events, "ts", "event_id", 10).select("event_id", "ts", "event_type", "user_id")


@query("event_totals", """
SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def _(t):
    return windows.event_totals(t.events, "event_type", "user_id", "value")
