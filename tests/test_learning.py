import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon import errors
from tabulon.operators import classify, cluster, cluster_job, density, features, isolation, regression
from tabulon.operators.models import hash_flag


def brute_dbscan(points, eps, min_points):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= min_points
    label = [None] * len(points)
    for i in np.flatnonzero(core):
        if label[i] is None:
            stack, members = [i], []
            label[i] = i
            while stack:
                p = stack.pop()
                members.append(p)
                for q in np.flatnonzero(d[p] & core):
                    if label[q] is None:
                        label[q] = i
                        stack.append(q)
    for i in np.flatnonzero(~core):
        near = [label[j] for j in np.flatnonzero(d[i] & core)]
        label[i] = min(near) if near else None
    return [None if v is None else int(v) for v in label], core.tolist()


@pytest.mark.parametrize("dims,small_box", [(2, 32), (2, 1), (3, 2)])
def test_dbscan_matches_brute_force(spark, monkeypatch, dims, small_box):
    monkeypatch.setattr(density, "SMALL_BOX", small_box)
    rng = np.random.default_rng(dims)
    hot = np.tile(rng.normal(size=(1, dims)), (60, 1))  # one cell holds a third of the rows
    points = np.vstack([rng.normal(size=(60, dims)) * 0.4, rng.normal(size=(60, dims)) * 0.4 + 2, hot])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", *[f"x{j}" for j in range(dims)]])
    got = {r["id"]: (r["cluster_id"], r["core"]) for r in density.dbscan(df, [f"x{j}" for j in range(dims)], "id", 0.35, 5).collect()}
    labels, core = brute_dbscan(points, 0.35, 5)
    assert got == {i: (labels[i], core[i]) for i in range(len(points))}


def test_dbscan_of_noise_only(spark):
    df = spark.createDataFrame([(i, float(i * 10)) for i in range(8)], "id int, x double")
    assert all(r["cluster_id"] is None for r in density.dbscan(df, ["x"], "id").collect())
    with pytest.raises(errors.AnalysisError):
        density.dbscan(df, ["x"] * 5, "id")


def test_isolation_forest_finds_the_far_points(spark):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(size=(285, 2)), rng.normal(size=(15, 2)) + 12])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    out = isolation.isolation_forest(df, ["a", "b"], ["id"], contamination=0.05, trees=40, sample=64).toPandas()
    assert set(out[out["anomaly"]]["id"]) == set(range(285, 300))
    again = isolation.isolation_forest(df.repartition(5), ["a", "b"], ["id"], contamination=0.05, trees=40, sample=64).toPandas()
    assert np.allclose(out.sort_values("id")["score"], again.sort_values("id")["score"])


def test_kmeans_on_two_blobs(spark):
    rng = np.random.default_rng(42)
    points = np.vstack([rng.normal(size=(50, 3)), rng.normal(size=(50, 3)) + 5])
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], ["a", "b", "c"])
    best, scores = cluster.choose_k(df, max_k=3, restarts=2)
    assert best.k == 2 and all(-1 <= s <= 1 for _, s in scores)
    assigned = best.assign(df)
    summary = cluster.cluster_summary(assigned, ["a", "b", "c"]).toPandas()
    assert sorted(summary["size"]) == [50, 50] and summary["share"].sum() == pytest.approx(1)
    row = cluster.cluster_quality(assigned, 3).first()
    assert 0 < row["davies_bouldin"] < 1 and row["calinski_harabasz"] > 50
    with pytest.raises(errors.InsufficientDataError):
        cluster.kmeans(df.limit(2), k=3, restarts=1)


def descent(x, y, alpha, share):
    n, b = len(y), np.zeros(x.shape[1])
    yc = y - y.mean()
    for _ in range(3000):
        for j in range(len(b)):
            rho = x[:, j] @ (yc - x @ b + x[:, j] * b[j]) / n
            b[j] = np.sign(rho) * max(0, abs(rho) - alpha * share) / (x[:, j] @ x[:, j] / n + alpha * (1 - share))
    return b


def test_penalties_match_their_definition(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(400, 3))
    x[:, 2] += 0.5 * x[:, 0]
    y = 10 + 5 * x[:, 0] + 3 * x[:, 1] - 0.4 * x[:, 2] + 2 * rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    z = (x - x.mean(0)) / x.std(0)
    want = {
        "linear": np.linalg.lstsq(z, y - y.mean(), rcond=None)[0],
        "ridge": np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())),
        "lasso": descent(z, y, 1.0, 1.0),
        "elastic_net": descent(z, y, 1.0, 0.5),
    }
    for f in regression.fit_linear(df, "y", ["a", "b", "c"], F.lit(True)):
        assert np.allclose(f.coefficients, want[f.name], atol=1e-5), f.name
    with pytest.raises(errors.NoVarianceError):
        regression.fit_linear(df.withColumn("y", F.lit(1.0)), "y", ["a"], F.lit(True))


def test_mixed_regression_uses_categories(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), "ab"[i % 2], float(3 * x + 20 * (i % 2) + rng.normal())) for i, x in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id int, x double, kind string, y double")
    metrics, coefficients, checks = regression.mixed_regression(df.drop("id"), "y", hash_flag(["x"]))
    assert metrics.filter("best").first()["r2"] > 0.95
    assert {r["feature"] for r in coefficients.collect()} >= {"n_x"}
    assert {r["test"] for r in checks.collect()} == {"shapiro", "breusch_pagan"}


def test_classifier_predicts_with_training_medians(spark):
    rng = np.random.default_rng(9)
    rows = [(i, None if i % 10 == 0 else float(v + 6 * (i % 2)), "yes" if i % 2 else "no") for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id int, x double, label string")
    split = hash_flag(["id"])
    model = classify.train(df, "label", ["x"], split, "logistic")
    scored = model.transform(df.filter(~split))
    assert scored.count() == df.filter(~split).count()
    # A filled cell lies between the classes, so only rows with a value can be told apart.
    assert classify.evaluate(scored.filter("x IS NOT NULL"), "label").first()["accuracy"] > 0.95
    alone = model.transform(spark.createDataFrame([(1, None, "no")], "id int, x double, label string")).first()
    assert alone["predicted"] in ("yes", "no")


def test_box_cox_power(spark):
    rng = np.random.default_rng(6)
    x = np.exp(rng.normal(size=800)) + 0.5
    grid = np.linspace(-2, 2, 4001)

    def likelihood(lam):
        t = np.log(x) if abs(lam) < 1e-9 else (x**lam - 1) / lam
        return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(t.var())

    want = max(grid, key=likelihood)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert features.box_cox_lambda(df, F.col("x"), rounds=5) == pytest.approx(want, abs=2e-3)


def test_encoding_and_engineering(spark):
    rows = [(f"k{i:02d}" if i else None, "ab"[i % 2], float(i), 1.0) for i in range(14)]
    df = spark.createDataFrame(rows, "many string, few string, x double, flat double")
    out = features.encode_categorical(df)
    assert out.columns == ["many", "x", "flat", "few_b"] and out.schema["few_b"].dataType.typeName() == "boolean"
    codes = {r["x"]: r["many"] for r in out.collect()}
    assert codes[1.0] == 0 and codes[13.0] == 12 and codes[0.0] is None
    assert features.low_variance_columns(df) == ["flat"]
    ready = features.engineered_features(df, target="x")
    assert "flat" not in ready.columns
    assert ready.agg(F.round(F.stddev_pop("many"), 6)).first()[0] == 1.0


def test_cluster_rows_falls_back_to_density_clusters(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(40)], "id int, a double, b double")
    rows = cluster_job.cluster_rows(df, "id", ["a", "b"], restarts=1).toPandas()
    assert len(rows) == 40 and set(rows["algorithm"]) == {"dbscan"} and set(rows["cluster_id"]) == {0}


def test_density_labels_number_clusters_and_mark_noise(spark):
    points = [(i, float(i % 2) * 50) for i in range(40)] + [(99, 1000.0)]
    df = spark.createDataFrame(points, "id int, a double")
    prep = cluster_job.Preparation(["a"], [0.0], [0.0], [1.0])
    got = {r["id"]: r["cluster_id"] for r in cluster_job.density_labels(df, "id", ["a"], prep, 1.2, 5).collect()}
    assert got == {**{i: i % 2 for i in range(40)}, 99: -1}


def test_check_clustering(spark):
    from tabulon.operators import quality

    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "a int, b double")
    quality.check_clustering(df)
    with pytest.raises(errors.InsufficientDataError):
        quality.check_clustering(df.filter("a < 29"))
    with pytest.raises(errors.InsufficientFeaturesError):
        quality.check_clustering(df.select("a"))


def test_lloyd_lanes_equal_plain_loops(spark):
    """All starts together give what each gives alone in numpy, an empty centre stays, silhouettes equal all pairs."""
    from tabulon.operators import lloyd

    r = np.random.default_rng(4)
    rows = np.concatenate([r.normal(c, 1, (40, 2)) for c in ((0, 0), (6, 1), (2, 7))]).round(3)
    points = spark.createDataFrame(rows.tolist(), "f0 double, f1 double").repartition(3)
    starts = [rows[[0, 50]], rows[[3, 4, 90]], np.array([[0.0, 0.0], [900.0, 900.0]])]
    for start, (centers, cost) in zip(starts, lloyd.lloyd(points, starts, 7, 0.0), strict=True):
        want = start.copy()
        for _ in range(7):
            label = ((rows[:, None] - want) ** 2).sum(axis=2).argmin(axis=1)
            want = np.array([rows[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(want)])
        assert np.allclose(centers, want)
        assert cost == pytest.approx(((rows[:, None] - want) ** 2).sum(axis=2).min(axis=1).sum())
    lanes = [rows[[0, 50, 100]], starts[2]]
    d2 = ((rows[:, None] - rows) ** 2).sum(axis=2)
    label = ((rows[:, None] - lanes[0]) ** 2).sum(axis=2).argmin(axis=1)
    scores = []
    for i in range(len(rows)):
        own = d2[i, label == label[i]].sum() / max((label == label[i]).sum() - 1, 1)
        other = min(d2[i, label == c].mean() for c in set(label.tolist()) - {label[i]})
        scores.append((other - own) / max(own, other))
    found = lloyd.silhouettes(points, lanes)
    assert found[0] == pytest.approx(np.mean(scores)) and found[1] is None
