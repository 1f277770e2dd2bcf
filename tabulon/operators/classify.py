"""Classification with preparation from the training rows and metrics from one confusion table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError, InsufficientDataError
from tabulon.functions.stats import round4
from tabulon.operators.models import Preparation, prepare
from tabulon.operators.regression import importance_rows
from tabulon.plans.longform import ref

CLASS_LIMIT = 1000  # labels are held on the driver


@dataclass
class Classifier:
    """A trained model with the preparation of its inputs; transform scores any rows."""

    kind: str
    preparation: Preparation
    labels: list
    model: object
    importance: np.ndarray | None

    def transform(self, df: DataFrame) -> DataFrame:
        ready = df.withColumn("features", self.preparation.vector())
        scored = self.model.transform(ready)
        names = F.array(*[F.lit(v) for v in self.labels])
        kept = [ref(c) for c in df.columns]
        return scored.select(*kept, F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def _learner(kind: str, classes: int, n: int):
    if kind == "logistic":
        # A unit penalty on the summed loss is 1 / n on the mean loss.
        return LogisticRegression(maxIter=1000, regParam=1.0 / n, standardization=False)
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=50, maxDepth=10, seed=42)
    if kind == "gradient_boosting":
        boosted = GBTClassifier(maxIter=50, maxDepth=5, seed=42)
        return boosted if classes == 2 else OneVsRest(classifier=boosted)
    raise AnalysisError(f"unknown classifier {kind}")


def _importance(kind: str, model, classes: int):
    if kind == "logistic":
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if kind == "gradient_boosting" and classes > 2:
        return np.mean([m.featureImportances.toArray() for m in model.models], axis=0)
    return model.featureImportances.toArray()


def train(df: DataFrame, target: str, features: list[str], split: Column, kind: str = "logistic") -> Classifier:
    rows = df.filter(split & ref(target).isNotNull())
    labels = [r[0] for r in rows.select(ref(target)).distinct().limit(CLASS_LIMIT + 1).collect()]
    if not 2 <= len(labels) <= CLASS_LIMIT:
        raise InsufficientDataError("classes between 2 and the limit", 2, len(labels))
    labels.sort()
    prep = prepare(rows, features)
    code = F.array_position(F.array(*[F.lit(v) for v in labels]), ref(target)) - 1
    vectors = rows.select(prep.vector().alias("features"), code.cast("double").alias("label")).persist()
    try:
        model = _learner(kind, len(labels), vectors.count()).fit(vectors)
    finally:
        vectors.unpersist()
    return Classifier(kind, prep, labels, model, _importance(kind, model, len(labels)))


def evaluate(scored: DataFrame, target: str) -> DataFrame:
    """Accuracy and class-weighted precision, recall and F1 from label x prediction counts."""
    cells = scored.groupBy(ref(target).alias("y"), F.col("predicted").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("y") == F.col("p")
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"), F.when(hit, F.col("n")).otherwise(0).alias("right")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("right")),
    )).alias("s")).select("s.*")
    per = sides.groupBy("c").agg(F.sum("actual").alias("a"), F.sum("guessed").alias("g"), F.sum("right").alias("r"))
    a, g, r = F.col("a"), F.col("g"), F.col("r")
    precision = F.when(g > 0, r / g).otherwise(0.0)
    recall = F.when(a > 0, r / a).otherwise(0.0)
    f1 = F.when(a + g > 0, 2 * r / (a + g)).otherwise(0.0)
    n = F.sum(a)
    return per.agg(
        F.sum(a).alias("test_rows"),
        round4(F.sum(r) / n).alias("accuracy"),
        round4(F.sum(a * precision) / n).alias("precision"),
        round4(F.sum(a * recall) / n).alias("recall"),
        round4(F.sum(a * f1) / n).alias("f1"),
    )


def classification_metrics(df: DataFrame, target: str, features: list[str], split: Column, kinds=("logistic", "random_forest", "gradient_boosting")) -> DataFrame:
    out = None
    for kind in kinds:
        model = train(df, target, features, split, kind)
        test = df.filter(~split & ref(target).isNotNull())
        row = evaluate(model.transform(test), target).select(F.lit(kind).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def feature_importance(df: DataFrame, target: str, features: list[str], split: Column, kind: str = "random_forest") -> DataFrame:
    return importance_rows(df, features, train(df, target, features, split, kind).importance)
