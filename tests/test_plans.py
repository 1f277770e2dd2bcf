from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.plans import stage as stage_plan
from tabulon.plans.quantiles import exact_quantiles, string_at_rank
from tabulon.plans.quartiles import edge_quartiles, rank_quartiles
from tabulon.plans.ranks import average_ranks
from tabulon.plans.slots import edge_counts, joint_counts
from tabulon.plans.stage import _CLEAN_UP, discard, stage

PROBS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def columns(n=4000):
    rng = np.random.default_rng(7)
    third = rng.normal(size=n)
    third[: n // 3] = 1.5  # one value holds a third of the rows
    return pd.DataFrame(
        {
            "normal": rng.normal(size=n),
            "heavy": np.exp(rng.normal(size=n) * 12),
            "ties": rng.integers(0, 5, n),
            "third": third,
            "wide": rng.integers(-(2**62), 2**62, n),
            "constant": np.full(n, 3.25),
        }
    )


@pytest.mark.parametrize("limits", [{}, {"listed": 20, "bins": 16}])
def test_quantiles_match_numpy(spark, limits):
    pdf = columns()
    found = exact_quantiles(spark.createDataFrame(pdf), list(pdf), PROBS, **limits)
    for c in pdf:
        want = np.quantile(pdf[c].astype(float), PROBS)
        assert np.allclose(found[c], want, rtol=1e-12, atol=0), c


def test_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert exact_quantiles(df, ["x"], (0.5,)) == {"x": [2.0]}
    assert exact_quantiles(df.limit(0), ["x"], (0.5,)) == {"x": [None]}


def test_string_rank(spark):
    words = ["", "a", "aa", "ab", "b", "ba", "zebra", "é", "é", "zz"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    ordered = sorted(words, key=lambda w: w.encode())
    assert [string_at_rank(df, "w", i, step=1) for i in range(len(words))] == ordered


@pytest.mark.parametrize("n", [4, 5, 6, 7, 30])
def test_rank_quartiles_match_qcut(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"k": np.arange(n), "m": rng.integers(0, 3, n).astype(float)})
    want = pd.qcut(pdf.sort_values("k")["m"].rank(method="first"), 4, labels=[1, 2, 3, 4]).astype(int)
    df = spark.createDataFrame(pdf)
    for key, frame in (("k", df), ("s", df.withColumn("s", F.format_string("%04d", "k")))):
        q = rank_quartiles(frame, ["m"], key, listed=2, bins=4)["m"]
        got = frame.select("k", q.alias("q")).orderBy("k").toPandas()["q"]
        assert list(got) == list(want)
        assert max(np.bincount(got)[1:]) - min(np.bincount(got, minlength=5)[1:]) <= 1


def test_edge_quartiles_match_qcut(spark):
    values = [1.0] * 10 + [2.0] * 3 + [5.0, 9.0, 11.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, m double")
    got = df.select("k", edge_quartiles(df, ["m"])["m"].alias("q")).orderBy("k").toPandas()["q"]
    want = pd.qcut(pd.Series(values), 4, labels=False, duplicates="drop") + 1
    assert list(got) == list(want)


def test_average_ranks(spark):
    values = [3.0, 1.0, 1.0, 7.0, 3.0, 3.0]
    df = spark.createDataFrame([(v, 1) for v in values], "x double, w long")
    got = dict(average_ranks(df, "x", "w").collect())
    want = dict(zip(values, pd.Series(values).rank()))
    assert got == want


def test_joint_counts_over_many_columns(spark):
    df = spark.range(100).select(*[(F.col("id") % (i + 2)).cast("int").alias(f"c{i}") for i in range(6)])
    got = joint_counts(df, {f"c{i}": F.when(F.col(f"c{i}") > 0, F.col(f"c{i}")) for i in range(6)})
    for i in range(6):
        values = [k % (i + 2) for k in range(100)]
        assert got[f"c{i}"] == {v: values.count(v) for v in set(values) - {0}}


def test_edge_counts_on_both_paths(spark):
    rows = [(1.0, 1), (2.0, 2), (2.0, 2**60), (3.5, 2**60 + 1), (None, None), (float("inf"), 2**61)]
    df = spark.createDataFrame(rows, "x double, k long")
    assert edge_counts(df, {"x": [2.0, 3.0]}, points=True)["x"] == {0: 1, 1: 2, 4: 2}
    assert edge_counts(df, {"x": [2.0, 3.0]})["x"] == {0: 1, 1: 2, 2: 2}
    assert edge_counts(df, {"k": [2, 2**60]}, points=True)["k"] == {0: 1, 1: 1, 3: 1, 4: 2}


def test_stages_can_be_discarded(spark):
    before = spark.conf.get(_CLEAN_UP, None)
    first = stage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    second = stage(first.where("k > 3"))
    path = first.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert Path(path).exists()
    discard(first, first, spark.range(1))  # a second time, and a frame that isn't staged
    assert not Path(path).exists()
    assert sorted(r["k"] for r in second.collect()) == [4, 5, 6]
    assert spark.conf.get(_CLEAN_UP, None) == before


def test_staged_texts_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(stage_plan, "TEXT_ROWS", 7)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    found = stage_plan.stage(spark.range(0, 100, 1, 1).mapInArrow(sizes, "n long"), texts=True).collect()
    assert sum(r["n"] for r in found) == 100 and max(r["n"] for r in found) == 7
    assert spark.conf.get(name) == before
