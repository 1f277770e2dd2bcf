"""K-means segmentation, choice of k and cluster quality."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import InsufficientDataError
from tabulon.functions.stats import round4
from tabulon.operators.clean import impute
from tabulon.operators.lloyd import MOST_STEPS, lloyd, seed_sample, seeds, silhouettes
from tabulon.operators.models import Preparation, prepare, unscaled
from tabulon.plans.longform import numeric_columns, ref
from tabulon.plans.spread import spread

RESTARTS = 10
MAX_CLUSTERS = 10


@dataclass
class Clusters:
    k: int
    cost: float
    preparation: Preparation
    centers: list[list[float]]

    def assign(self, df: DataFrame) -> DataFrame:
        """Rows with cluster_id (the nearest centre, the first of equals), the features as `_scaled` and the squared
        distance to the centre."""

        def to(centre: list[float], i: int):
            square = [(F.col("_scaled")[j] - v) * (F.col("_scaled")[j] - v) for j, v in enumerate(centre)]
            return F.struct(sum(square, F.lit(0.0)).alias("d2"), F.lit(i).alias("id"))

        found = [to(c, i) for i, c in enumerate(self.centers)]
        nearest = F.least(*found) if len(found) > 1 else found[0]
        out = df.withColumn("_scaled", F.array(*self.preparation.scaled())).withColumn("_nearest", nearest)
        return out.withColumn("cluster_id", F.col("_nearest.id")).withColumn("_d2", F.col("_nearest.d2")).drop("_nearest")


def _points(df: DataFrame, features: list[str], scale: bool = True):
    prep = prepare(df, features) if scale else unscaled(features)
    inputs = spread(df.select(*[ref(c) for c in features]))
    columns = [x.cast("double").alias(f"f{i}") for i, x in enumerate(prep.scaled())]
    return prep, inputs.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)


def _best(points: DataFrame, ks: list[int], restarts: int, seed: int) -> list[tuple[np.ndarray, float]]:
    """Centres and cost of the cheapest start for each k; all starts of all k run together."""
    sample = seed_sample(points)
    lanes = [(k, i) for k in ks for i in range(restarts)]
    found = lloyd(points, [seeds(sample, k, seed + i) for k, i in lanes])
    return [min((f for f, (k, _) in zip(found, lanes) if k == wanted), key=lambda f: f[1]) for wanted in ks]


def _wrap(found: tuple[np.ndarray, float], prep: Preparation) -> Clusters:
    centers, cost = found
    return Clusters(len(centers), cost, prep, centers.tolist())


def kmeans(
    df: DataFrame, features=None, k: int = 3, restarts: int = RESTARTS, seed: int = 42, scale: bool = True
) -> Clusters:
    """Best of several starts on standardised features, where missing cells take the median; without `scale`
    on the columns as they are, which must be complete."""
    features = list(features or numeric_columns(df))
    prep, points = _points(df, features, scale)
    try:
        n = points.count()
        if n < k:
            raise InsufficientDataError("rows for clustering", k, n)
        return _wrap(_best(points, [k], restarts, seed)[0], prep)
    finally:
        points.unpersist()


def kmeans_from(df: DataFrame, centers: list[list[float]], features=None, steps: int = MOST_STEPS) -> Clusters:
    """Lloyd's iteration from given centres on the columns as they are, which must be complete."""
    features = list(features or numeric_columns(df))
    prep, points = _points(df, features, scale=False)
    try:
        return _wrap(lloyd(points, [np.array(centers, dtype=np.float64)], steps, 0.0)[0], prep)
    finally:
        points.unpersist()


def choose_k(df: DataFrame, features=None, max_k: int = 6, restarts: int = RESTARTS, seed: int = 42):
    """(clusters of the best k, [(k, silhouette)]). The silhouette uses squared Euclidean distance."""
    features = list(features or numeric_columns(df))
    prep, points = _points(df, features)
    try:
        n = points.count()
        if n < 3:
            raise InsufficientDataError("rows for clustering", 3, n)
        ks = list(range(2, min(max_k, n - 1) + 1))
        found = _best(points, ks, restarts, seed)
        judged = zip(ks, found, silhouettes(points, [c for c, _ in found]))
        scores = [(k, f, score) for k, f, score in judged if score is not None]
        if not scores:
            raise InsufficientDataError("distinct rows for clustering", 2, 1)
        best = max(scores, key=lambda s: s[2])
        return _wrap(best[1], prep), [(k, score) for k, _, score in scores]
    finally:
        points.unpersist()


def silhouette_table(df: DataFrame, features=None, max_k: int = 6, restarts: int = RESTARTS) -> DataFrame:
    best, scores = choose_k(df, features, max_k, restarts)
    rows = [(k, round(s, 4), k == best.k) for k, s in scores]
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double, best boolean")


def cluster_summary(assigned: DataFrame, features: list[str]) -> DataFrame:
    """Size, share, raw feature means, spread in scaled units; id -1 marks outliers."""
    total = assigned.agg(F.count(F.lit(1))).scalar()
    d = range(len(features))
    spread = sum((F.stddev_pop(F.col("_scaled")[i]) for i in d), F.lit(0.0)) / len(features)
    grouped = assigned.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"),
        *[round4(F.avg(ref(c))).alias(f"mean_{c}") for c in features],
        round4(spread).alias("spread"),
    )
    return grouped.select(
        "cluster_id", "size", round4(F.col("size") / total).alias("share"),
        F.when(F.col("cluster_id") == -1, "outlier").otherwise("segment").alias("type"),
        *[f"mean_{c}" for c in features], "spread",
    )


def segment(df: DataFrame, features=None, k: int = 3, restarts: int = RESTARTS) -> DataFrame:
    """Unscaled segmentation as sizes and centroids, missing cells filled with means."""
    features = list(features or numeric_columns(df))
    filled = impute(df.select(*[ref(c) for c in features]), "mean", features)
    clusters = kmeans(filled, features, k, restarts, scale=False)
    return cluster_summary(clusters.assign(filled), features)


def cluster_quality(assigned: DataFrame, dims: int, label: str = "cluster_id") -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz from one aggregate per cluster.

    `_scaled` holds the features; rows labelled -1 are left out. Only k rows reach the driver.
    """
    kept = assigned.filter(F.col(label).cast("string") != "-1")
    sums = kept.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.col("_scaled")[i]) for i in range(dims)]).alias("centre")
    )
    centres = {r[label]: (r["n"], list(r["centre"])) for r in sums.collect()}
    if len(centres) < 2:
        raise InsufficientDataError("clusters", 2, len(centres))
    ids = list(centres)
    table = F.create_map(*[v for c in ids for v in (F.lit(c), F.array(*[F.lit(x) for x in centres[c][1]]))])
    d2 = F.aggregate(
        F.zip_with("_scaled", table[F.col(label)], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v
    )
    spread = {
        r[label]: (r["mean_distance"], r["within"])
        for r in kept.groupBy(label).agg(F.avg(F.sqrt(d2)).alias("mean_distance"), F.sum(d2).alias("within")).collect()
    }
    n = sum(c[0] for c in centres.values())
    k = len(ids)
    grand = [sum(centres[c][0] * centres[c][1][i] for c in ids) / n for i in range(dims)]
    between = sum(centres[c][0] * sum((a - b) ** 2 for a, b in zip(centres[c][1], grand)) for c in ids)
    within = sum(spread[c][1] for c in ids)
    worst = []
    for a in ids:
        ratios = [
            (spread[a][0] + spread[b][0]) / math.dist(centres[a][1], centres[b][1])
            for b in ids
            if b != a and centres[a][1] != centres[b][1]
        ]
        worst.append(max(ratios, default=0.0))
    ch = between / (k - 1) / (within / (n - k)) if within > 0 and n > k else 1.0
    return assigned.sparkSession.createDataFrame(
        [(k, n, round(sum(worst) / k, 4), round(ch, 4))],
        "clusters int, rows long, davies_bouldin double, calinski_harabasz double",
    )
