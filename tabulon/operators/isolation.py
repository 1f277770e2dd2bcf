"""Isolation forest: trees from a bounded random pool, scores for every row.

The pool is trees x sample rows, a constant. Each tree is grown in its own task, the trees (at most
2 x sample nodes each) are broadcast, and scoring is vectorised over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import InsufficientDataError
from tabulon.plans.longform import ref
from tabulon.plans.quantiles import quantile_exprs
from tabulon.plans.sample import smallest_hashes
from tabulon.plans.spread import spread
from tabulon.plans.stage import stage

EULER = 0.5772156649015329


def average_path(n):
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length); a leaf has feature -1."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        index = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + float(average_path(len(rows)))))
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_axes = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_axes):
            return index
        axis = int(rng.choice(open_axes))
        cut = float(rng.uniform(low[axis], high[axis]))
        mask = rows[:, axis] <= cut
        if mask.all() or not mask.any():
            return index
        left, right = add(rows[mask], depth + 1), add(rows[~mask], depth + 1)
        nodes[index] = (axis, cut, left, right, 0.0)
        return index

    add(x, 0)
    return nodes


def path_lengths(x: np.ndarray, tree) -> np.ndarray:
    axis, cut, left, right, length = tree
    at = np.zeros(len(x), dtype=np.int64)
    open_rows = np.arange(len(x))
    while len(open_rows):
        node = at[open_rows]
        inner = axis[node] >= 0
        open_rows, node = open_rows[inner], node[inner]
        go_left = x[open_rows, axis[node]] <= cut[node]
        at[open_rows] = np.where(go_left, left[node], right[node])
    return length[at]


def isolation_scores(df: DataFrame, features: list[str], key: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Complete rows with their anomaly score in (0, 1)."""
    spark = df.sparkSession
    values = F.array(*[ref(c).cast("double") for c in features])
    complete = df.na.drop(subset=features)
    pool = smallest_hashes(complete, key, trees * sample, seed).select(values.alias("x")).toPandas()
    if len(pool) < 10:
        raise InsufficientDataError("rows for isolation forest", 10, len(pool))
    matrix = spark.sparkContext.broadcast(np.vstack(pool["x"].to_numpy()))
    size = min(sample, len(pool))
    limit = math.ceil(math.log2(max(2, size)))

    def build(batches):
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                rows = matrix.value[rng.choice(len(matrix.value), size, replace=False)]
                yield pd.DataFrame(grow(rows, rng, limit), columns=["axis", "cut", "left", "right", "length"]).assign(
                    tree=int(tree), node=lambda d: np.arange(len(d))
                )

    schema = "axis int, cut double, left int, right int, length double, tree long, node long"
    grown = spark.range(trees).mapInPandas(build, schema).toPandas().sort_values(["tree", "node"])
    forest = spark.sparkContext.broadcast(
        [
            tuple(g[c].to_numpy() for c in ("axis", "cut", "left", "right", "length"))
            for _, g in grown.groupby("tree")
        ]
    )
    scale = float(average_path(size))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        depth = sum(path_lengths(x, tree) for tree in forest.value) / len(forest.value)
        return pd.Series(2.0 ** (-depth / scale))

    return spread(complete).withColumn("score", score(*[ref(c).cast("double") for c in features]))


def isolation_forest(df: DataFrame, features: list[str], key: list[str], contamination: float = 0.1, **options) -> DataFrame:
    """Rows with score and whether it lies above the exact (1 - contamination) quantile."""
    scored = stage(isolation_scores(df, features, key, **options))
    cut = quantile_exprs(scored, {"score": F.col("score")}, (1 - contamination,))["score"][0]
    return scored.withColumn("anomaly", F.col("score") > F.lit(cut))


def anomaly_summary(df: DataFrame, features: list[str], key: list[str], contamination: float = 0.1, **options) -> DataFrame:
    found = isolation_forest(df, features, key, contamination, **options)
    return found.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("anomaly").alias("anomaly_count"),
        F.round(F.avg(F.col("anomaly").cast("double")) * 100, 2).alias("anomaly_pct"),
    )
