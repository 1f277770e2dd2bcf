"""Hypothesis tests: sufficient statistics in one aggregate, p-values on the result rows."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError
from tabulon.functions import dist
from tabulon.functions.stats import normality_k2, normality_p, round4
from tabulon.operators.correlation import pair_correlations
from tabulon.plans.longform import identity, numeric_columns, per_column, ref
from tabulon.plans.quantiles import numeric
from tabulon.plans.ranks import average_ranks, row_ranks
from tabulon.plans.stage import stage

ALPHA = 0.05
P_LIMIT = 5000  # the published p-value of Shapiro-Wilk holds up to this many values


def _p6(c):
    return F.round(c, 6)


def _with_verdict(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, _p6(F.col("p")).alias("p_value"), (F.col("p") < ALPHA).alias("significant"))


def group_moments(df: DataFrame, group: str, value: str, min_size: int = 10) -> DataFrame:
    """(g, n, mean, var) per group with enough values."""
    x = numeric(df, value)
    return (
        df.select(ref(group).cast("string").alias("g"), x.cast("double").alias("x"))
        .na.drop()
        .groupBy("g")
        .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
        .filter(F.col("n") >= min_size)
    )


def column_moments(df: DataFrame, columns: Iterable[str], min_size: int = 10) -> DataFrame:
    """(g, n, mean, var) with one group per column."""
    stats = per_column(
        df,
        columns,
        lambda c: {
            "n": F.count(numeric(df, c)),
            "mean": F.avg(numeric(df, c)),
            "var": F.var_samp(numeric(df, c).cast("double")),
        },
    )
    return stats.withColumnRenamed("column", "g").filter(F.col("n") >= min_size)


def _two(moments: DataFrame, a: str, b: str) -> DataFrame:
    def pick(g, c):
        return F.max(F.when(F.col("g") == g, F.col(c)))

    return moments.agg(*[pick(g, c).alias(f"{c}{i}") for i, g in ((1, a), (2, b)) for c in ("n", "mean", "var")])


def t_test(moments: DataFrame, a: str, b: str) -> DataFrame:
    """Independent t-test with pooled variance between two groups of a moments frame."""
    n1, n2 = F.col("n1"), F.col("n2")
    freedom = n1 + n2 - 2
    pooled = ((n1 - 1) * F.col("var1") + (n2 - 1) * F.col("var2")) / freedom
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / n1 + 1 / n2))
    out = _two(moments, a, b).select("*", freedom.alias("df"), t.alias("t")).filter(F.col("t").isNotNull())
    out = out.withColumn("p", dist.t_p_column(F.col("t"), F.col("df")))
    return _with_verdict(
        out.select(
            F.col("n1").alias("group1_n"),
            F.col("n2").alias("group2_n"),
            round4(F.col("mean1")).alias("group1_mean"),
            round4(F.col("mean2")).alias("group2_mean"),
            "df",
            round4(F.col("t")).alias("t_statistic"),
            "p",
        ),
        "group1_n", "group2_n", "group1_mean", "group2_mean", "df", "t_statistic",
    )


def t_test_paired(df: DataFrame, before: str, after: str, min_size: int = 10) -> DataFrame:
    a, b = ref(before).cast("double"), ref(after).cast("double")
    d = F.when(a.isNotNull() & b.isNotNull(), a - b)
    both = a.isNotNull() & b.isNotNull()
    out = df.agg(
        F.count(d).alias("n_pairs"),
        F.avg(F.when(both, a)).alias("m1"),
        F.avg(F.when(both, b)).alias("m2"),
        F.avg(d).alias("md"),
        F.stddev(d).alias("sd"),
    ).filter(F.col("n_pairs") >= min_size)
    out = out.withColumn("t", F.col("md") / (F.col("sd") / F.sqrt("n_pairs")))
    out = out.withColumn("p", dist.t_p_column(F.col("t"), F.col("n_pairs") - 1))
    return _with_verdict(
        out.select(
            "n_pairs",
            round4(F.col("m1")).alias("before_mean"),
            round4(F.col("m2")).alias("after_mean"),
            round4(-F.col("md")).alias("mean_difference"),
            round4(F.col("t")).alias("t_statistic"),
            "p",
        ),
        "n_pairs", "before_mean", "after_mean", "mean_difference", "t_statistic",
    )


def anova(moments: DataFrame) -> DataFrame:
    """One-way ANOVA over the groups of a moments frame."""
    n, m = F.col("n"), F.col("mean")
    sums = moments.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(n * m).alias("s1"),
        F.sum(n * m * m).alias("s2"),
        F.sum((n - 1) * F.col("var")).alias("within"),
    )
    d1, d2 = F.col("k") - 1, F.col("total") - F.col("k")
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")
    out = sums.filter(F.col("k") >= 2).select(
        F.col("k").alias("n_groups"),
        F.col("total").alias("n_total"),
        d1.alias("df_between"),
        d2.alias("df_within"),
        ((between / d1) / (F.col("within") / d2)).alias("f"),
    )
    out = out.withColumn("p", dist.f_p_column(F.col("f"), F.col("df_between"), F.col("df_within")))
    return _with_verdict(
        out.withColumn("f_statistic", round4(F.col("f"))), "n_groups", "n_total", "df_between", "df_within", "f_statistic"
    )


def chi_square_fit(df: DataFrame, column: str, expected: str | None = None) -> DataFrame:
    """Goodness of fit of value counts to equal counts, or to another column's ordered counts."""
    counts = df.filter(ref(column).isNotNull()).groupBy(ref(column).alias("v")).agg(F.count(F.lit(1)).alias("o"))
    if expected is None:
        o = F.col("o")
        sums = counts.agg(F.count(F.lit(1)).alias("k"), F.sum("o").alias("n"), F.sum(o * o).alias("s2"))
        out = sums.select(
            F.col("k").alias("n_categories"),
            (F.col("s2") * F.col("k") / F.col("n") - F.col("n")).alias("x"),
            (F.col("k") - 1).alias("df"),
        )
    else:
        hoped = df.filter(ref(expected).isNotNull()).groupBy(ref(expected).alias("v")).agg(F.count(F.lit(1)).alias("o"))
        seen = _counts_in_order(counts)
        hoped = _counts_in_order(hoped).withColumnRenamed("o", "e")
        k, k2 = seen.count(), hoped.count()
        if k != k2:
            raise AnalysisError(f"categories differ: {k} and {k2}")
        o, e = F.col("o"), F.col("e")
        out = seen.join(hoped, "rank").agg(
            F.count(F.lit(1)).alias("n_categories"), F.sum((o - e) * (o - e) / e).alias("x")
        )
        out = out.withColumn("df", F.col("n_categories") - 1)
    out = out.filter(F.col("n_categories") >= 2).withColumn("p", dist.chi2_p_column(F.col("x"), F.col("df")))
    return _with_verdict(out.withColumn("chi_square", round4(F.col("x"))), "n_categories", "df", "chi_square")


def _counts_in_order(counts: DataFrame) -> DataFrame:
    """(rank, o): the category counts by size, ranked over ranges without a global sort."""
    short = counts.select("o", identity(F.col("v").cast("string")).alias("v"))
    return stage(row_ranks(short, "o", ["v"]).select("rank", "o"))


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns; Yates' correction on a 2 x 2 table."""
    pairs = df.select(ref(a).alias("a"), ref(b).alias("b")).na.drop()
    cells = stage(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("o")))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("rb"))
    shape = rows.agg(F.count(F.lit(1)).alias("r"), F.sum("ra").alias("n")).withColumn(
        "c", cols.agg(F.count(F.lit(1))).scalar()
    )
    # Empty cells add their whole expectation: sum(e) over all cells is n.
    e = F.col("ra") * F.col("rb") / shape.select("n").scalar()
    met = cells.join(rows, "a").join(cols, "b").select("o", e.alias("e"))
    gap = F.col("o") - F.col("e")
    sums = met.agg(
        F.sum(gap * gap / F.col("e")).alias("plain"), F.sum("e").alias("covered"), F.max(F.abs(gap)).alias("gap")
    )
    one = sums.select(F.struct("*").alias("s")).scalar()
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    full = one["plain"] + (F.col("n") - one["covered"])
    # In a 2 x 2 table all four gaps are equal, so the margins are enough even when a cell is empty.
    margins = rows.agg(F.product("ra")).scalar() * cols.agg(F.product("rb")).scalar()
    shrunk = one["gap"] - F.least(F.lit(0.5), one["gap"])
    yates = shrunk * shrunk * F.pow(F.col("n").cast("double"), F.lit(3.0)) / margins
    x = F.when((F.col("r") == 2) & (F.col("c") == 2), yates).otherwise(full)
    out = shape.select(F.col("n").alias("n_samples"), dof.alias("df"), x.alias("x"))
    out = out.withColumn("p", dist.chi2_p_column(F.col("x"), F.col("df")))
    return _with_verdict(out.withColumn("chi_square", round4(F.col("x"))), "n_samples", "df", "chi_square")


def _r_rows(df: DataFrame, r) -> DataFrame:
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((F.col("n") - 2) / (1 - r * r)))
    out = df.withColumn("t", t).withColumn("p", dist.t_p_column(F.col("t"), F.col("n") - 2))
    return out.withColumn("correlation", round4(r))


def pearson(df: DataFrame, x: str, y: str, min_size: int = 10) -> DataFrame:
    pairs = pair_correlations(df, [x, y]).filter(F.col("n") >= min_size)
    out = _r_rows(pairs, F.col("correlation"))
    return _with_verdict(out.withColumnRenamed("n", "n_samples"), "left", "right", "n_samples", "correlation")


def correlation_significance(df: DataFrame, columns=None) -> DataFrame:
    """p-value of every pairwise correlation, with the small guard in the denominator."""
    pairs = pair_correlations(df, columns)
    r = F.col("correlation")
    t = r * F.sqrt(F.col("n") - 2) / F.sqrt(1 - r * r + 1e-10)
    out = pairs.withColumn("p", dist.t_p_column(t, F.col("n") - 2)).withColumn("correlation", round4(r))
    return _with_verdict(out, "left", "right", "n", "correlation")


def spearman(df: DataFrame, x: str, y: str, min_size: int = 10) -> DataFrame:
    """Rank correlation with average ranks.

    Equal pairs are combined first; that table is scanned once from the source, staged, and gives
    both rank tables.
    """
    pairs = stage(
        df.select(numeric(df, x).alias("x"), numeric(df, y).alias("y"))
        .na.drop()
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    ranked = (
        pairs.join(average_ranks(pairs, "x", "w").withColumnRenamed("rank", "rx"), "x")
        .join(average_ranks(pairs, "y", "w").withColumnRenamed("rank", "ry"), "y")
    )
    n = pairs.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    middle = F.lit((n + 1) / 2)
    a, b, w = F.col("rx") - middle, F.col("ry") - middle, F.col("w")
    sums = ranked.agg(F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    out = sums.select(
        F.lit(x).alias("left"), F.lit(y).alias("right"), F.lit(n).cast("long").alias("n"),
        (F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"),
    ).filter(F.col("n") >= min_size)
    out = _r_rows(out, F.col("rho"))
    return _with_verdict(out.withColumnRenamed("n", "n_samples"), "left", "right", "n_samples", "correlation")


# Published polynomial coefficients of the weights and of the p-value (Royston 1995).
LAST_WEIGHT = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
SECOND_WEIGHT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
MEAN_SMALL = (-0.0006714, 0.025054, -0.39978, 0.5440)
SPREAD_SMALL = (-0.0020322, 0.062767, -0.77857, 1.3822)
MEAN_LARGE = (0.0038915, -0.083751, -0.31082, -1.5861)
SPREAD_LARGE = (0.0030302, -0.082676, -0.4803)


def _shapiro(n: int, total: float, mx: float, last: list[float], ends: list[float], squares: float) -> tuple[float, float]:
    """(W, p) from sums over the sorted values x and the normal scores m of their ranks.

    total: of m^2; mx: of m * x; last: m of the second-last and the last rank; ends: the first, second, second-last
    and last x; squares: of x about its mean. The p-value is nan beyond P_LIMIT values."""
    second, top = last
    u = 1.0 / math.sqrt(n)
    a_top = top / math.sqrt(total) + float(np.polyval(LAST_WEIGHT, u))
    fixed, used, taken = a_top * (ends[3] - ends[0]), a_top**2, top**2
    middle = mx - top * (ends[3] - ends[0])
    if n > 5:
        a_second = second / math.sqrt(total) + float(np.polyval(SECOND_WEIGHT, u))
        fixed, used, taken = fixed + a_second * (ends[2] - ends[1]), used + a_second**2, taken + second**2
        middle -= second * (ends[2] - ends[1])
    phi = (total - 2 * taken) / (1 - 2 * used)
    w = min(1.0, (fixed + middle / math.sqrt(phi)) ** 2 / squares)
    if n > P_LIMIT:
        return w, float("nan")
    gap = math.log(max(1e-300, 1.0 - w))
    if n <= 11:
        edge = 0.459 * n - 2.273
        if gap >= edge:
            return w, 0.0
        z = (-math.log(edge - gap) - np.polyval(MEAN_SMALL, n)) / math.exp(np.polyval(SPREAD_SMALL, n))
    else:
        z = (gap - np.polyval(MEAN_LARGE, math.log(n))) / math.exp(np.polyval(SPREAD_LARGE, math.log(n)))
    return w, dist.normal_p(float(z))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """(W, p) of values in memory; nan below four values or if all are equal."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([dist.normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    centred = x - x.mean()
    return _shapiro(n, float(m @ m), float(m @ centred), [m[-2], m[-1]], [*x[:2], *x[-2:]], float(centred @ centred))


def shapiro_test(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Shapiro-Wilk over all rows with a value: one row of column, n_samples, statistic, p_value, is_normal.

    Only a value's rank enters its weight, so the rows are ranked over ranges of (value, key) and summed once. The
    p-value and the verdict are null beyond P_LIMIT values, where the published approximation ends; with fewer than
    four values or equal ones the statistic is null too."""
    x = numeric(df, column).cast("double")
    keys = [f"_k{i}" for i in range(len(key))]
    rows = df.filter(x.isNotNull()).select(x.alias("x"), *[ref(k).alias(name) for k, name in zip(key, keys)])
    ranked = row_ranks(rows, "x", keys)
    n, mean, low, high = ranked.agg(F.count("x"), F.avg("x"), F.min("x"), F.max("x")).first()
    w = p = None
    if n >= 4 and low < high:
        scored = ranked.withColumn("m", dist.normal_quantile_column((F.col("rank") - 0.375) / F.lit(n + 0.25)))
        centred = F.col("x") - F.lit(mean)

        def at(value: str, rank: int):
            return F.max(F.when(F.col("rank") == rank, F.col(value)))

        total, mx, squares, *rest = scored.agg(
            F.sum(F.col("m") * F.col("m")),
            F.sum(F.col("m") * centred),
            F.sum(centred * centred),
            *[at("m", r) for r in (n - 1, n)],
            *[at("x", r) for r in (1, 2, n - 1, n)],
        ).first()
        w, p = _shapiro(n, total, mx, rest[:2], rest[2:], squares)
        w, p = round(w, 4), None if math.isnan(p) else round(p, 6)
    return df.sparkSession.createDataFrame(
        [(column, n, w, p, None if p is None else p > ALPHA)],
        "column string, n_samples long, statistic double, p_value double, is_normal boolean",
    )


def normality_k2_test(df: DataFrame, columns=None) -> DataFrame:
    """D'Agostino-Pearson test per column, in plain expressions."""
    columns = list(columns or numeric_columns(df))
    base = per_column(
        df,
        columns,
        lambda c: {"n": F.count(numeric(df, c)), "g1": F.skewness(numeric(df, c)), "g2": F.kurtosis(numeric(df, c))},
    ).filter(F.col("n") >= 8)
    k2 = normality_k2(F.col("g1"), F.col("g2"), F.col("n"))
    out = base.select("column", "n", k2.alias("k2"))
    return out.select(
        "column",
        "n",
        round4(F.col("k2")).alias("k2"),
        _p6(normality_p(F.col("k2"))).alias("p_value"),
        (normality_p(F.col("k2")) > ALPHA).alias("is_normal"),
    )


def confidence_interval(df: DataFrame, columns: Iterable[str], confidence: float = 0.95) -> DataFrame:
    """t interval of the mean per column."""
    base = per_column(
        df,
        columns,
        lambda c: {"n": F.count(numeric(df, c)), "m": F.avg(numeric(df, c)), "s": F.stddev(numeric(df, c)), "s0": F.stddev_pop(numeric(df, c))},
    )
    q = dist.t_quantile_column(F.lit(confidence), F.col("n") - 1)
    out = base.withColumn("margin", q * F.col("s") / F.sqrt("n"))
    return out.select(
        "column",
        "n",
        round4(F.col("m")).alias("mean"),
        round4(F.col("s0")).alias("std"),
        round4(F.col("m") - F.col("margin")).alias("lower_bound"),
        round4(F.col("m") + F.col("margin")).alias("upper_bound"),
        round4(F.col("margin")).alias("margin_of_error"),
    )


def variance_inflation(df: DataFrame, columns: list[str], threshold: float = 5.0) -> DataFrame:
    """VIF with an intercept: the diagonal of the inverse correlation matrix over complete rows."""
    rows = pair_correlations(df.select(*[ref(c) for c in columns]).na.drop(), columns).collect()
    r = np.eye(len(columns))
    for row in rows:
        i, j = columns.index(row["left"]), columns.index(row["right"])
        r[i, j] = r[j, i] = row["correlation"] if row["correlation"] is not None else 0.0
    try:
        diagonal = [float(v) for v in np.diag(np.linalg.inv(r))]
    except np.linalg.LinAlgError:
        diagonal = [float("inf")] * len(columns)
    out = [(c, round(v, 4), v > threshold) for c, v in zip(columns, diagonal)]
    return df.sparkSession.createDataFrame(out, "column string, vif double, high boolean")


def least_squares(df: DataFrame, y, xs: list) -> tuple[np.ndarray, float, int]:
    """(coefficients with the intercept first, R squared, n) from one pass of cross products."""
    terms = [F.lit(1.0), *xs, y]
    k = len(terms)
    row = df.agg(
        *[F.sum((terms[i] * terms[j]).cast("double")).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    ).first()
    gram = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = row[f"c{i}_{j}"] or 0.0
    xtx, xty, yty = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    beta = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    n = gram[0, 0]
    total = yty - xty[0] ** 2 / n
    explained = beta @ xty - xty[0] ** 2 / n
    return beta, float(explained / total) if total > 0 else 0.0, int(n)


def breusch_pagan(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """LM test of heteroscedasticity: n R^2 of squared residuals on the features."""
    kept = df.select(ref(target).cast("double").alias("_y"), *[ref(c).cast("double").alias(c) for c in features]).na.drop()
    stats = kept.agg(*[e for c in features for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    xs = [(ref(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in features]
    mean = kept.agg(F.avg("_y")).first()[0]
    beta, _, _ = least_squares(kept, F.col("_y") - F.lit(mean), xs)
    fitted = F.lit(mean + float(beta[0]))
    for b, x in zip(beta[1:], xs):
        fitted = fitted + F.lit(float(b)) * x
    squared = (F.col("_y") - fitted) * (F.col("_y") - fitted)
    scale = kept.agg(F.avg(squared)).first()[0] or 1.0
    _, r2, n = least_squares(kept, squared / F.lit(scale) - F.lit(1.0), xs)
    lm = float(n * r2)
    p = dist.chi2_p(lm, len(features))
    return df.sparkSession.createDataFrame(
        [(n, len(features), round(lm, 4), round(p, 6), p < ALPHA)],
        "n long, df long, lm_statistic double, p_value double, heteroscedastic boolean",
    )

