"""Exponential smoothing, method choice by back-test, and the unit-root test, one series per group.

Input is the regularised (series, ts, value) frame, so a group is bounded by the calendar.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dist import normal_p
from tabulon.operators.timeseries import future, period_label, seasonal_period

GRID = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)


def _start(y: np.ndarray, m: int):
    if m > 1:
        level = y[:m].mean()
        trend = (y[m : 2 * m].mean() - level) / m
        return level, trend, y[:m] - level
    return y[0], (y[1] - y[0] if len(y) > 1 else 0.0), np.zeros(1)


def _smooth(y: np.ndarray, m: int, params: np.ndarray):
    """Additive recursion for many parameter triples at once; columns of params are alpha, beta, gamma."""
    level0, trend0, season0 = _start(y, m)
    k = len(params)
    a, b, g = params.T
    level, trend = np.full(k, level0), np.full(k, trend0)
    season = np.tile(season0, (k, 1))
    residuals = np.empty((len(y), k))
    for i, value in enumerate(y):
        s = season[:, i % m] if m > 1 else 0.0
        residuals[i] = value - (level + trend + s)
        old = level
        level = a * (value - s) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        if m > 1:
            season[:, i % m] = g * (value - level) + (1 - g) * s
    return level, trend, season, residuals


def holt_winters(y: np.ndarray, m: int, steps: int):
    """(forecast, residuals) with the parameters of least squared error: a grid, then two finer ones."""
    m = m if m > 1 and len(y) >= 2 * m else 1
    axes = [GRID, GRID, GRID if m > 1 else (0.0,)]
    width = 0.1
    for _ in range(3):
        params = np.array(list(product(*axes)))
        level, trend, season, residuals = _smooth(y, m, params)
        best = int(np.argmin((residuals**2).sum(axis=0)))
        centre = params[best]
        axes = [
            sorted({min(0.999, max(0.001, c + d)) for d in (-width, -width / 2, 0.0, width / 2, width)}) if c else (0.0,)
            for c in centre
        ]
        width /= 4
    ahead = np.arange(1, steps + 1)
    forecast = level[best] + trend[best] * ahead
    if m > 1:
        forecast = forecast + season[best][(len(y) + ahead - 1) % m]
    return forecast, residuals[:, best]


def line(y: np.ndarray, steps: int):
    x = np.arange(len(y))
    slope, intercept = np.polyfit(x, y, 1)
    ahead = np.arange(len(y), len(y) + steps)
    return slope * ahead + intercept, y - (slope * x + intercept)


def _run(method: str, y: np.ndarray, m: int, steps: int):
    return line(y, steps) if method == "linear_trend" else holt_winters(y, m, steps)


def _with_period(points: DataFrame) -> DataFrame:
    return points.join(seasonal_period(points).select("series", "smoothing_period"), "series")


FORECAST = "series string, last_ts timestamp, method string, step int, predicted double, lower double, upper double"


def _rows(series, last, method, forecast, residuals):
    half = 1.96 * float(np.std(residuals))
    return pd.DataFrame(
        {
            "series": series,
            "last_ts": last,
            "method": method,
            "step": np.arange(1, len(forecast) + 1, dtype="int32"),
            "predicted": np.round(forecast, 4),
            "lower": np.round(forecast - half, 4),
            "upper": np.round(forecast + half, 4),
        }
    )


def _dated(forecast: DataFrame, points: DataFrame) -> DataFrame:
    return forecast.join(period_label(points), "series").select(
        "series", "method", "step", future(F.col("last_ts"), F.col("frequency"), F.col("step")).alias("date"),
        "predicted", "lower", "upper",
    )


def smoothing_forecast(points: DataFrame, periods: int = 30, min_points: int = 12) -> DataFrame:
    """Additive exponential smoothing with a season where two of them are present, else the line."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y = pdf["value"].to_numpy(dtype=float)
        method = "exponential_smoothing" if len(y) >= min_points else "linear_trend"
        if len(y) < 2:
            return pd.DataFrame(columns=[c.split()[0] for c in FORECAST.split(", ")])
        forecast, residuals = _run(method, y, int(pdf["smoothing_period"].iloc[0]), periods)
        return _rows(pdf["series"].iloc[0], pdf["ts"].iloc[-1], method, forecast, residuals)

    return _dated(_with_period(points).groupBy("series").applyInPandas(run, FORECAST), points)


METHODS = ("exponential_smoothing", "linear_trend")


def _errors(y: np.ndarray, m: int, share: float = 0.8) -> dict[str, tuple[float, float]]:
    cut = int(share * len(y))
    train, test = y[:cut], y[cut:]
    out = {}
    for method in METHODS:
        forecast, _ = _run(method, train, m, len(test))
        gap = test - forecast
        out[method] = float(np.sqrt(np.mean(gap**2))), float(np.mean(np.abs(gap)))
    return out


def backtest(points: DataFrame, min_points: int = 10) -> DataFrame:
    """RMSE and MAE of each method on the last fifth, and which one wins, per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y = pdf["value"].to_numpy(dtype=float)
        if len(y) < min_points:
            return pd.DataFrame(columns=["series", "method", "rmse", "mae", "best"])
        errors = _errors(y, int(pdf["smoothing_period"].iloc[0]))
        best = min(errors, key=lambda k: errors[k][0])
        return pd.DataFrame(
            [(pdf["series"].iloc[0], k, round(r, 4), round(a, 4), k == best) for k, (r, a) in errors.items()],
            columns=["series", "method", "rmse", "mae", "best"],
        )

    return _with_period(points).groupBy("series").applyInPandas(
        run, "series string, method string, rmse double, mae double, best boolean"
    )


def best_forecast(points: DataFrame, periods: int = 30, min_points: int = 10) -> DataFrame:
    """Forecast of the back-test winner, refitted on the whole series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        y = pdf["value"].to_numpy(dtype=float)
        if len(y) < min_points:
            return pd.DataFrame(columns=[c.split()[0] for c in FORECAST.split(", ")])
        m = int(pdf["smoothing_period"].iloc[0])
        errors = _errors(y, m)
        method = min(errors, key=lambda k: errors[k][0])
        forecast, residuals = _run(method, y, m, periods)
        return _rows(pdf["series"].iloc[0], pdf["ts"].iloc[-1], method, forecast, residuals)

    return _dated(_with_period(points).groupBy("series").applyInPandas(run, FORECAST), points)


# Published response surface of the unit-root p-value, constant only (MacKinnon 1994).
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
LOW_TAIL = (0.038269, 1.4412, 2.1659)
HIGH_TAIL = (-0.010368, -0.12745, 0.93202, 1.7339)


def unit_root_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    return normal_p(-float(np.polyval(LOW_TAIL if tau <= TAU_STAR else HIGH_TAIL, tau)))


def _adf_fit(y: np.ndarray, lags: int, skip: int):
    """Regression of the difference on the level, lagged differences and a constant."""
    d = np.diff(y)
    rows = np.arange(skip, len(d))
    columns = [y[rows]] + [d[rows - j] for j in range(1, lags + 1)] + [np.ones(len(rows))]
    x, target = np.column_stack(columns), d[rows]
    beta, _, rank, _ = np.linalg.lstsq(x, target, rcond=None)
    residual = target - x @ beta
    sse, n, k = float(residual @ residual), len(target), x.shape[1]
    if rank < k or n <= k or sse <= 0:
        return None
    error = math.sqrt(sse / (n - k) * np.linalg.inv(x.T @ x)[0, 0])
    loglik = -n / 2 * (math.log(2 * math.pi) + math.log(sse / n) + 1)
    return float(beta[0]) / error, 2 * k - 2 * loglik


def adf(y: np.ndarray) -> tuple[float, float, int] | None:
    """(statistic, p, lags) with the lag order of least AIC on a common sample."""
    n = len(y)
    top = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if top < 0 or np.ptp(y) == 0:
        return None
    fits = [(f[1], lag) for lag in range(top + 1) if (f := _adf_fit(y, lag, top)) is not None]
    if not fits:
        return None
    lag = min(fits)[1]
    fit = _adf_fit(y, lag, lag)
    return (fit[0], unit_root_p(fit[0]), lag) if fit else None


def stationarity(points: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller test per series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        result = adf(pdf.sort_values("ts")["value"].to_numpy(dtype=float))
        columns = ["series", "statistic", "p_value", "lags", "stationary"]
        if result is None:
            return pd.DataFrame([(pdf["series"].iloc[0], None, None, None, None)], columns=columns)
        tau, p, lags = result
        return pd.DataFrame([(pdf["series"].iloc[0], round(tau, 4), round(p, 6), lags, p < 0.05)], columns=columns)

    return points.groupBy("series").applyInPandas(
        run, "series string, statistic double, p_value double, lags int, stationary boolean"
    )
