"""Linear and tree regression.

Linear models use the normal-equation solver: one pass of cross products per model, whatever the
row count. The penalties are stated per standardised feature and mapped to the solver's scale.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.errors import AnalysisError, NoVarianceError
from tabulon.functions.stats import round4
from tabulon.operators.features import date_features
from tabulon.operators.hypothesis import breusch_pagan, shapiro_test
from tabulon.operators.models import Preparation, prepare
from tabulon.plans.longform import freeze, numeric_columns, ref, text_columns, time_columns

# name: (kind, alpha, l1 share)
LINEAR_MODELS = {
    "linear": ("plain", 0.0, 0.0),
    "ridge": ("ridge", 1.0, 0.0),
    "lasso": ("net", 1.0, 1.0),
    "elastic_net": ("net", 1.0, 0.5),
}
MIXED_MODELS = {"elastic_net": ("net", 0.05, 0.3), "ridge": ("ridge", 1.0, 0.0), "linear": ("plain", 0.0, 0.0)}
OVERFIT_GAP = 0.15
CATEGORY_LIMIT = 10_000  # one-hot labels are held on the driver


def _solver(spec, n: int, spread: float, **columns) -> LinearRegression:
    kind, alpha, share = spec
    if kind == "ridge":
        reg, mix = alpha * spread / n, 0.0
    elif kind == "net":
        reg = alpha * (share + (1 - share) * spread)
        mix = share / (share + (1 - share) * spread)
    else:
        reg, mix = 0.0, 0.0
    return LinearRegression(
        regParam=reg, elasticNetParam=mix, standardization=False, solver="normal", maxIter=5000, tol=1e-12, **columns
    )


@dataclass
class LinearFit:
    name: str
    preparation: Preparation
    intercept: float
    coefficients: list[float]

    def predicted(self) -> Column:
        out = F.lit(self.intercept)
        for b, x in zip(self.coefficients, self.preparation.scaled()):
            out = out + F.lit(b) * x
        return out


def fit_linear(df: DataFrame, target: str, features: list[str], train: Column, models=None) -> list[LinearFit]:
    rows = df.filter(train & ref(target).isNotNull())
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(ref(target)).alias("s")).first()
    if not head["s"]:
        raise NoVarianceError(f"target {target} is constant")
    prep = prepare(rows, features)
    vectors = rows.select(prep.vector().alias("features"), ref(target).cast("double").alias("label"))
    fits = []
    for name, spec in (models or LINEAR_MODELS).items():
        model = _solver(spec, head["n"], head["s"]).fit(vectors)
        fits.append(LinearFit(name, prep, float(model.intercept), [float(v) for v in model.coefficients]))
    return fits


def _scores(df: DataFrame, y: Column, train: Column, predictions: dict[str, Column]) -> DataFrame:
    """Train and test errors of all models in one aggregate."""
    test = ~train
    cells = []
    for name, p in predictions.items():
        e = y - p
        cells.append(
            F.struct(
                F.lit(name).alias("model"),
                F.avg(F.when(train, e * e)).alias("mse_train"),
                F.avg(F.when(test, e * e)).alias("mse"),
                F.avg(F.when(test, F.abs(e))).alias("mae"),
            )
        )
    wide = df.agg(
        F.array(*cells).alias("rows"),
        F.count_if(train).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        F.var_pop(F.when(train, y)).alias("var_train"),
        F.var_pop(F.when(test, y)).alias("var_test"),
    )
    flat = wide.select("train_rows", "test_rows", "var_train", "var_test", F.inline("rows"))
    train_r2 = 1 - F.col("mse_train") / F.col("var_train")
    r2 = 1 - F.col("mse") / F.col("var_test")
    scored = flat.select(
        "model", "train_rows", "test_rows", train_r2.alias("train_r2"), r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae"
    )
    winner = F.min(F.struct(-F.col("r2"), F.col("model"))).over(Window.partitionBy(F.lit(1)))  # one row per model
    return scored.select(
        "model", "train_rows", "test_rows",
        round4(F.col("train_r2")).alias("train_r2"), round4(F.col("r2")).alias("r2"),
        round4(F.col("rmse")).alias("rmse"), round4(F.col("mae")).alias("mae"),
        (F.col("train_r2") - F.col("r2") > OVERFIT_GAP).alias("overfit"),
        (F.col("model") == winner["model"]).alias("best"),
    )


def linear_models(df: DataFrame, target: str, features: list[str], train: Column, models=None) -> DataFrame:
    """Test metrics per model, the overfit flag and the best by test R squared."""
    fits = fit_linear(df, target, features, train, models)
    kept = df.filter(ref(target).isNotNull())
    return _scores(kept, ref(target).cast("double"), train, {f.name: f.predicted() for f in fits})


def linear_coefficients(df: DataFrame, target: str, features: list[str], train: Column, models=None) -> DataFrame:
    """Coefficients per standardised feature and their share of the absolute sum."""
    rows = []
    for f in fit_linear(df, target, features, train, models):
        total = sum(abs(b) for b in f.coefficients)
        rows += [
            (f.name, c, round(b, 4), round(abs(b) / total, 4) if total else 0.0)
            for c, b in zip(features, f.coefficients)
        ]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, coefficient double, importance double")


def forest_regression(df: DataFrame, target: str, features: list[str], train: Column, trees: int = 50, depth: int = 10):
    """(metrics, importance) of a random forest."""
    kept = df.filter(ref(target).isNotNull())
    prep = prepare(kept.filter(train), features)
    vectors = kept.select(prep.vector().alias("features"), ref(target).cast("double").alias("label"), train.alias("_train"))
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=42).fit(vectors.filter("_train"))
    scored = model.transform(vectors)
    metrics = _scores(scored, F.col("label"), F.col("_train"), {"random_forest": F.col("prediction")})
    return metrics, importance_rows(df, features, model.featureImportances.toArray())


def importance_rows(df: DataFrame, features: list[str], values) -> DataFrame:
    rows = [(c, round(float(v), 6)) for c, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def _mixed_frame(df: DataFrame, target: str, train: Column):
    """Median and most-frequent imputation, date parts, one-hot categories and scaled numbers."""
    flagged = df.filter(ref(target).isNotNull()).withColumn("_train", train)
    times = time_columns(flagged)
    if times:
        flagged = date_features(flagged, times)
        flagged = flagged.drop(
            *[f"{c}_{p}" for c in times for p in ("quarter", "day_of_month", "week_of_year", "month_sin", "month_cos")]
        )
    words = [c for c in text_columns(flagged) if c != target]
    numbers = [c for c in numeric_columns(flagged) if c != target]
    rows = flagged.filter("_train")
    prep = prepare(rows, numbers)
    modes = {}
    if words:
        sizes = rows.agg(*[F.approx_count_distinct(ref(c)).alias(c) for c in words]).first()
        wide = [c for c in words if sizes[c] > CATEGORY_LIMIT]
        if wide:
            raise AnalysisError(f"too many categories for one-hot columns, encode them first: {wide}")
        from tabulon.operators.aggregate import value_counts

        modes = {r["column"]: r["value"] for r in value_counts(rows, words, top=1).collect()}
    frame = flagged.select(
        "_train",
        ref(target).cast("double").alias("label"),
        *[x.alias(f"n_{c}") for c, x in zip(numbers, prep.scaled())],
        *[F.coalesce(ref(c), F.lit(modes.get(c))).alias(f"w_{c}") for c in words],
    )
    stages = []
    if words:
        stages += [
            StringIndexer(
                inputCols=[f"w_{c}" for c in words], outputCols=[f"i_{c}" for c in words], handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=[f"i_{c}" for c in words], outputCols=[f"h_{c}" for c in words]),
        ]
    stages.append(
        VectorAssembler(inputCols=[*[f"n_{c}" for c in numbers], *[f"h_{c}" for c in words]], outputCol="features")
    )
    return frame, stages, numbers


def mixed_regression(df: DataFrame, target: str, train: Column, models=None):
    """(metrics, coefficients, residual checks) with mixed column types; the best model is chosen on the test rows."""
    frame, stages, numbers = _mixed_frame(df, target, train)
    fitted = Pipeline(stages=stages).fit(frame.filter("_train"))
    ready = fitted.transform(frame)
    rows = ready.filter("_train")
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    trained = {
        name: _solver(spec, head["n"], head["s"], featuresCol="features", labelCol="label", predictionCol=f"p_{name}").fit(rows)
        for name, spec in (models or MIXED_MODELS).items()
    }
    scored = ready
    for model in trained.values():
        scored = model.transform(scored)
    metrics = freeze(_scores(scored, F.col("label"), F.col("_train"), {m: F.col(f"p_{m}") for m in trained}))
    best = metrics.filter("best").first()["model"]
    names = [a["name"] for kind in ready.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(kind, key=lambda a: a["idx"])]
    order = [a["idx"] for kind in ready.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(kind, key=lambda a: a["idx"])]
    weights = trained[best].coefficients.toArray()
    ranked = sorted(
        ((name, round(float(weights[i]), 4), round(abs(float(weights[i])), 4)) for name, i in zip(names, order)),
        key=lambda r: (-r[2], r[0]),
    )
    coefficients = df.sparkSession.createDataFrame(ranked, "feature string, coefficient double, magnitude double")
    test = scored.filter("NOT _train").withColumn("_residual", F.col("label") - F.col(f"p_{best}"))
    normal = shapiro_test(test, "_residual", ["label", f"p_{best}"]).select(
        F.lit("shapiro").alias("test"), "statistic", "p_value", (~F.col("is_normal")).alias("violated")
    )
    spread = breusch_pagan(
        test.select("_residual", *[f"n_{c}" for c in numbers]), "_residual", [f"n_{c}" for c in numbers]
    ).select(F.lit("breusch_pagan").alias("test"), F.col("lm_statistic").alias("statistic"), "p_value", F.col("heteroscedastic").alias("violated"))
    return metrics, coefficients, normal.unionByName(spread)
