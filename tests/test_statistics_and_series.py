import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import dist
from tabulon.operators import hypothesis as H
from tabulon.operators import smoothing as M
from tabulon.operators import timeseries as K


def test_tails_match_tables():
    assert dist.t_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.f_p(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_p(3.841458821, 1) == pytest.approx(0.05, abs=1e-8)
    assert dist.chi2_p(18.30703805, 10) == pytest.approx(0.05, abs=1e-8)
    assert dist.normal_p(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert dist.t_quantile(0.95, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert dist.t_p(0.0, 5) == 1.0 and dist.t_p(math.inf, 5) == 0.0


def test_normal_quantile_expression(spark):
    shares = [1e-300, 1e-40, 1e-12, 1e-5, 0.01, 0.0749, 0.075, 0.2, 0.5, 0.7, 0.925, 0.9251, 0.99, 1 - 1e-12]
    found = spark.createDataFrame([(p,) for p in shares], "p double").select(dist.normal_quantile_column(F.col("p"))).collect()
    for p, (z,) in zip(shares, found):
        assert z == pytest.approx(dist.normal_quantile(p), rel=1e-13, abs=1e-14)


def test_shapiro_over_all_rows(spark):
    rng = np.random.default_rng(5)
    for n, ties in ((5, 0), (9, 3), (600, 200), (6000, 2000)):
        values = np.concatenate([np.full(ties, 0.25), rng.normal(size=n - ties)])
        rows = [(i, float(v)) for i, v in enumerate(values)] + [(n, None)]
        found = H.shapiro_test(spark.createDataFrame(rows, "k long, v double").repartition(7), "v", ["k"]).first()
        w, p = H.shapiro_wilk(values)
        assert found["n_samples"] == n and abs(found["statistic"] - w) < 1e-4
        assert found["p_value"] is None if n > H.P_LIMIT else abs(found["p_value"] - p) < 1e-5
    few = H.shapiro_test(spark.createDataFrame([], "k long, v double"), "v", ["k"]).first()
    assert (few["n_samples"], few["statistic"], few["is_normal"]) == (0, None, None)


def test_shapiro_wilk_known_values():
    w, p = H.shapiro_wilk(np.arange(1.0, 11.0))
    assert (round(w, 4), round(p, 3)) == (0.9702, 0.892)
    rng = np.random.default_rng(3)
    assert H.shapiro_wilk(rng.normal(size=2000))[1] > 0.05
    assert H.shapiro_wilk(rng.exponential(size=500))[1] < 1e-6
    assert math.isnan(H.shapiro_wilk(np.ones(20))[0])


@pytest.mark.parametrize("a,b,c,d", [(10, 20, 30, 5), (12, 0, 9, 14), (10, 0, 0, 12)])
def test_yates_on_two_by_two(spark, a, b, c, d):
    cells = {("a", "x"): a, ("a", "y"): b, ("b", "x"): c, ("b", "y"): d}
    df = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "g string, h string")
    row = H.chi_square_independence(df, "g", "h").first()
    n = a + b + c + d
    want = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert row["chi_square"] == pytest.approx(want, abs=1e-4) and row["df"] == 1


def test_empty_cell_counts_in_independence(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 20 + [("a", "z")] * 5 + [("b", "z")] * 5
    df = spark.createDataFrame(rows, "g string, h string")
    table = np.array([[10, 0, 5], [0, 20, 5]], dtype=float)
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert H.chi_square_independence(df, "g", "h").first()["chi_square"] == pytest.approx(((table - e) ** 2 / e).sum(), abs=1e-4)


def test_spearman_matches_ranks(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, 300).astype(float)
    y = x + rng.normal(size=300).round(1)
    import pandas as pd

    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert H.spearman(df, "x", "y").first()["correlation"] == pytest.approx(want, abs=1e-4)


def test_breusch_pagan_sees_growing_spread(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 10, 400)
    even, growing = 3 * x + rng.normal(size=400), 3 * x + x * rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, even, growing)], "x double, e double, g double")
    assert not H.breusch_pagan(df, "e", ["x"]).first()["heteroscedastic"]
    assert H.breusch_pagan(df, "g", ["x"]).first()["heteroscedastic"]


def series(spark, values, start=dt.datetime(2024, 1, 1), days=1, name="s"):
    rows = [(name, start + dt.timedelta(days=days * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series string, ts timestamp, value double")


def test_linear_forecast_of_a_line(spark):
    out = K.linear_forecast(series(spark, [100, 110, 120, 130, 140]), 2).orderBy("step").collect()
    assert [r["predicted"] for r in out] == [150.0, 160.0]
    assert str(out[0]["date"]) == "2024-01-06" and out[0]["r_squared"] == 1.0
    flat = K.linear_forecast(series(spark, [100] * 30), 1).first()
    assert flat["predicted"] == 100.0 and flat["lower"] <= 100.0 <= flat["upper"]


def test_gaps_cross_hours(spark):
    stamps = [dt.datetime(2024, 1, 1, 0, 59), dt.datetime(2024, 1, 1, 1, 1), dt.datetime(2024, 1, 1, 1, 1), dt.datetime(2024, 1, 4)]
    df = spark.createDataFrame([(t, 1.0) for t in stamps], "t timestamp, v double")
    gaps = sorted(r[0] for r in K.distinct_gaps(df, "t").select("gap_days").collect() if r[0] is not None)
    assert gaps == pytest.approx([2 / 1440, 3 - 61 / 1440])
    row = K.gap_check(df, "t", "v").first()
    assert (row["data_points"], row["duplicates"], row["gaps"]) == (4, 1, 1)


@pytest.mark.parametrize("days,label", [(1, "daily"), (7, "weekly"), (30, "monthly"), (90, "quarterly"), (365, "yearly")])
def test_frequency_labels(spark, days, label):
    assert K.median_gap(series(spark, range(6), days=days), "ts").first()["frequency"] == label


def test_smoothing_follows_trend_and_season():
    t = np.arange(84)
    y = 50 + 2 * t + 10 * np.sin(2 * np.pi * t / 7)
    forecast, residuals = M.holt_winters(y, 7, 14)
    ahead = np.arange(84, 98)
    assert np.abs(forecast - (50 + 2 * ahead + 10 * np.sin(2 * np.pi * ahead / 7))).max() < 3
    constant, residuals = M.holt_winters(np.full(30, 100.0), 7, 5)
    assert np.allclose(constant, 100) and np.allclose(residuals, 0)


def test_backtest_prefers_the_line(spark):
    rng = np.random.default_rng(2)
    pts = series(spark, 100 + 3 * np.arange(60) + rng.normal(size=60) * 0.5)
    rows = {r["method"]: r for r in M.backtest(pts).collect()}
    assert sum(r["best"] for r in rows.values()) == 1 and rows["linear_trend"]["rmse"] < 2
    best = M.best_forecast(pts, 5).orderBy("step").collect()
    assert len(best) == 5 and all(r["lower"] <= r["predicted"] <= r["upper"] for r in best)
    assert K.forecast_trend(M.best_forecast(pts, 20)).first()["trend"] == "increasing"


def test_unit_root(spark):
    rng = np.random.default_rng(11)
    walks = rng.normal(size=(100, 300)).cumsum(axis=1)
    assert 1 <= sum(M.adf(w)[1] < 0.05 for w in walks) <= 12  # the test's own error rate is 5 percent
    noise = rng.normal(size=300)
    both = series(spark, noise, name="noise").union(series(spark, np.arange(300) + noise.cumsum(), name="trend"))
    got = {r["series"]: r["stationary"] for r in M.stationarity(both).collect()}
    assert got == {"noise": True, "trend": False}
    assert M.unit_root_p(-2.86) == pytest.approx(0.05, abs=0.002)  # tabulated 5 percent point
