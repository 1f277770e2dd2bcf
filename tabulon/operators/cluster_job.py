"""The clustering job: choose k by silhouette, fall back to density clusters, label outliers -1."""

from __future__ import annotations

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.errors import InsufficientDataError
from tabulon.operators.cluster import RESTARTS, choose_k
from tabulon.operators.density import MAX_DIMENSIONS, dbscan
from tabulon.operators.isolation import isolation_forest
from tabulon.operators.models import Preparation, prepare
from tabulon.plans.longform import numeric_columns, ref
from tabulon.plans.ranks import row_ranks
from tabulon.plans.stage import stage

EPS, MIN_POINTS = 1.2, 5
OUTLIER = -1


def density_labels(df: DataFrame, key: str, features: list[str], prep: Preparation, eps: float, min_points: int) -> DataFrame:
    """(key, cluster_id) on standardised features: clusters numbered from 0 by their least core key, noise -1."""
    names = [f"_f{i}" for i in range(len(features))]
    points = df.select(ref(key), *[x.alias(n) for x, n in zip(prep.scaled(), names)])
    found = stage(dbscan(points, names, key, eps, min_points).select(ref(key), F.col("cluster_id").alias("_name")))
    numbers = row_ranks(found.select("_name").na.drop().distinct(), "_name", [])
    number = F.coalesce(F.col("rank") - 1, F.lit(OUTLIER)).cast("int")
    return found.join(numbers, "_name", "left").select(ref(key), number.alias("cluster_id"))


def _silhouette(df: DataFrame, prep: Preparation) -> float | None:
    """Of the rows that are no outliers; None with fewer than two clusters."""
    kept = df.filter(F.col("cluster_id") != OUTLIER)
    shape = kept.agg(F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high")).first()
    if shape["low"] == shape["high"]:
        return None
    vectors = kept.select(prep.vector().alias("features"), F.col("cluster_id").alias("prediction"))
    return float(ClusteringEvaluator(predictionCol="prediction", featuresCol="features").evaluate(vectors))


def cluster_rows(
    df: DataFrame,
    key: str,
    features=None,
    max_k: int = 6,
    restarts: int = RESTARTS,
    contamination: float = 0.0,
    eps: float = EPS,
    min_points: int = MIN_POINTS,
) -> DataFrame:
    """df with cluster_id (-1: outlier), algorithm, and the standardised features as `_scaled`.

    Without contamination, k-means takes the k of best silhouette, and density clusters are the way out where
    no k gives two clusters. With contamination, the isolation forest's share of rows is set apart first and
    gets -1; on the rest the better silhouette of k-means and density clusters wins, k-means on a tie. Density
    clusters take at most MAX_DIMENSIONS features; beyond that only k-means is tried. The key must be unique.
    """
    features = list(features or [c for c in numeric_columns(df) if c != key])
    rest, apart = df, None
    if contamination > 0:
        marked = isolation_forest(df, features, [key], contamination).select(ref(key), "anomaly")
        rows = stage(df.join(marked, key, "left"))
        apart = rows.filter("anomaly").drop("anomaly")
        rest = rows.filter("anomaly IS NULL OR NOT anomaly").drop("anomaly")
    best, score = None, None
    try:
        best, scores = choose_k(rest, features, max_k, restarts)
        score = max(s for _, s in scores)
    except InsufficientDataError:
        if rest.isEmpty() or len(features) > MAX_DIMENSIONS:
            raise
    prep = best.preparation if best else prepare(rest, features)
    chosen, algorithm = None, "kmeans"
    if best is None or (contamination > 0 and len(features) <= MAX_DIMENSIONS):
        labels = density_labels(rest, key, features, prep, eps, min_points)
        dense = stage(rest.join(labels, key))
        other = _silhouette(dense, prep) if best else None
        if best is None or (other is not None and other > score):
            chosen, algorithm = dense, "dbscan"
    if chosen is None:
        chosen = best.assign(rest).select(*[ref(c) for c in df.columns], "cluster_id")
    chosen = chosen.select(*[ref(c) for c in df.columns], "cluster_id")
    if apart is not None:
        chosen = chosen.unionByName(apart.withColumn("cluster_id", F.lit(OUTLIER)))
    return chosen.withColumn("algorithm", F.lit(algorithm)).withColumn("_scaled", F.array(*prep.scaled()))
