import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon import errors
from tabulon.functions import text as T
from tabulon.operators import aggregate as A
from tabulon.operators import clean as C
from tabulon.operators import cohort, correlation, insights, kpi, outliers, profile, quality, relational, rfm, spec

SALES = [
    (dt.date(2025, 1, 1), "C001", "North", 1200, 3),
    (dt.date(2025, 2, 1), "C002", "South", 1800, 4),
    (dt.date(2025, 3, 1), "C001", "North", 2200, 5),
]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(SALES, "order_date date, customer_id string, region string, revenue long, orders long")


def test_sales_goldens(sales):
    row = A.numeric_profile(sales, ["revenue"]).first()
    assert (row["mean"], row["mode"], row["distinct"]) == (1733.3333, 1200.0, 3)
    assert A.completeness(sales).first()[0] == 100.0
    assert kpi.growth(sales, "order_date", "revenue").first()["growth_pct"] == pytest.approx(83.3333)
    assert [r["label"] for r in A.top_groups(sales, "region", "revenue").collect()] == ["North", "South"]


def test_profile_edge_columns(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None, float("nan")), (1.0, 6.0, None, 2.0), (1.0, 9.0, None, 4.0)],
        "flat double, x double, empty double, holes double",
    )
    rows = {r["column"]: r for r in A.numeric_profile(df).collect()}
    assert rows["flat"]["std_dev"] == 0.0 and rows["flat"]["outlier_count"] == 0
    assert rows["empty"]["count"] == 0 and rows["empty"]["mean"] is None
    assert rows["holes"]["count"] == 2 and rows["holes"]["mean"] == 3.0
    one = A.describe(df.limit(1), ["x"]).first()
    assert one["std"] == 0.0 and one["median"] == one["min"]


def test_histogram_counts_and_constant(spark):
    df = spark.createDataFrame([(float(i % 10), 4.0) for i in range(100)], "x double, flat double")
    rows = A.histogram(df, ["x", "flat"]).toPandas()
    assert rows.groupby("column")["n"].sum().to_dict() == {"x": 100, "flat": 100}
    flat = rows[rows["column"] == "flat"]
    assert flat["low"].min() == 3.5 and flat["high"].max() == 4.5 and len(flat) == 3


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, "a"), (None, None), (None, None), ("a", "a")], "x string, y string")
    row = A.duplicate_rows(df).first()
    assert (row["total_rows"], row["duplicate_rows"]) == (6, 2)
    assert A.duplicate_rows(df.limit(0)).first()["duplicate_rows"] == 0
    assert C.drop_duplicate_rows(df).count() == 4


def test_entropy_and_rate(spark):
    df = spark.createDataFrame([("a", "yes", 0.5), ("b", "no", 0.25), ("a", "yes", 0.75), ("b", None, 0.5)], "g string, w string, r double")
    assert A.entropy(df, ["g"]).first()["entropy"] == pytest.approx(1.0, abs=1e-4)
    got = kpi.kpi_rows(df, {"words": kpi.rate(F.col("w")), "share": kpi.rate(F.col("r"))}).collect()
    assert {r["kpi"]: r["value"] for r in got} == {"words": 66.6667, "share": 50.0}


def test_cleaning_of_dirty_text(spark):
    df = spark.createDataFrame(
        [("$1,200.50", "Yes", "2024-01-05", " x "), ("€3", "off", "05/01/2024", "N/A"), ("nil", "on", "2024-02-01", "y")] * 4,
        "Amount string, Flag string, `When?` string, Name string",
    )
    out = C.normalize(df)
    assert dict(out.dtypes) == {"amount": "string", "flag": "boolean", "when": "timestamp", "name": "string"}
    filled = C.normalize(df.filter("Amount <> 'nil'"))
    assert [r[0] for r in filled.limit(2).collect()] == [1200.5, 3.0]
    assert filled.first()["name"] == "x" and filled.filter("name IS NULL").count() == 4
    assert filled.filter("when = timestamp'2024-05-01 00:00:00'").count() == 4
    assert C.coerce_numeric(spark.createDataFrame([("1d",), ("2f",)], "x string")).dtypes == [("x", "string")]


def test_names_collide(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A b", "a-b", "1st", "%%"])
    assert C.sanitize_names(df).columns == ["a_b", "a_b_2", "_1st", "column_3"]
    assert C.sanitize_names(df, "sql").columns == ["A_b", "a_b_2", "col_1st", "__"]
    long = spark.createDataFrame([(1, 2, 3)], ["x" * 70, "X" * 64, ""])
    assert C.sanitize_names(long, "sql").columns == ["x" * 64, "X" * 62 + "_2", "column_2"]


def test_complete_cases_fall_back(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    assert C.complete_cases(df).count() == 2 and C.complete_cases_or_all(df)[1]
    assert C.complete_cases(df.union(spark.createDataFrame([(1, 1)], "a int, b int"))).count() == 1


def test_impute(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "b"), (10.0, None)], "x double, w string")
    assert C.impute(df, "median").filter("x = 3.0").count() == 2
    assert C.impute(df, "mean").filter("abs(x - 14.0D / 3) < 1e-9").count() == 1
    assert C.impute(df, "most_frequent").filter("w = 'b'").count() == 3


def test_zscore_of_constant_column(spark):
    df = spark.createDataFrame([(5.0,)] * 20, "x double")
    assert outliers.zscore_rows(df, "x").count() == 0
    assert outliers.iqr_summary(df, ["x"]).first()["anomaly_count"] == 0


def test_quality_score_bounds(spark):
    bad = spark.createDataFrame([(None, None)] * 30, "a string, b double")
    assert quality.quality_score(bad).first()["quality_score"] <= 30
    clean = spark.createDataFrame([(float(i), float(i * i)) for i in range(30)], "a double, b double")
    assert quality.quality_score(clean).first()["quality_score"] == 100


def test_preconditions(spark, sales):
    with pytest.raises(errors.MissingColumnError):
        quality.require_columns(sales, ["nope"])
    with pytest.raises(errors.InsufficientDataError):
        quality.check_time_series(sales, "order_date", "revenue")
    with pytest.raises(errors.InsufficientDataError):
        quality.check_rfm(sales, "customer_id", "order_date", "revenue")
    with pytest.raises(errors.NoVarianceError):
        quality.check_regression(spark.createDataFrame([(100, 1), (100, 2)], "target int, x int"), "target")
    with pytest.raises(errors.EmptyInputError):
        quality.require_rows(sales.limit(0))


def test_cohorts(spark):
    rows = [("a", dt.date(2024, 1, 3), 10.0), ("a", dt.date(2024, 1, 9), 1.0), ("a", dt.date(2024, 3, 1), 5.0), ("b", dt.date(2024, 2, 1), 7.0)]
    cells = cohort.cohort_cells(spark.createDataFrame(rows, "m string, t date, v double"), "m", "t", "v")
    got = {(str(r["cohort"])[:7], r["cohort_index"]): (r["members"], r["retention"], r["value"]) for r in cells.collect()}
    assert got == {("2024-01", 0): (1, 1.0, 11.0), ("2024-01", 2): (1, 1.0, 5.0), ("2024-02", 0): (1, 1.0, 7.0)}
    avg = cohort.average_retention(cells).first()
    assert (avg["cohort_count"], avg["period_count"], avg["average_retention"]) == (2, 2, 0.5)


def test_rfm_segments_sum_up(spark):
    rows = [(f"CUST_{c:05d}", dt.datetime(2023, 1 + (c * k) % 12, 1 + c % 28), float(10 + c * k % 90)) for c in range(40) for k in range(1, 2 + c % 7)]
    df = spark.createDataFrame(rows, "c string, t timestamp, v double")
    scored = rfm.rfm_rank(df, "c", "t", "v")
    pdf = scored.toPandas()
    for s in ("r_score", "f_score", "m_score"):
        assert pdf[s].value_counts().max() - pdf[s].value_counts().min() <= 1
    summary = rfm.segment_summary(scored).toPandas()
    assert summary["customers"].sum() == 40 and math.isclose(summary["revenue_pct"].sum(), 100, abs_tol=0.01)
    edges = rfm.rfm_edges(df, "c", "t", "v").toPandas()
    assert (edges["rfm_score"].str.len() == 3).all()


def test_correlation_pairs_skip_nulls(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 5.0], "b": [2.0, 4.1, 6.0, None, 9.9], "c": [5.0, 3.0, 4.0, 1.0, 0.0]})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in pdf.itertuples(index=False)], "a double, b double, c double")
    got = {(r["left"], r["right"]): r["correlation"] for r in correlation.pair_correlations(df).collect()}
    want = pdf.corr()
    for (x, y), r in got.items():
        assert r == pytest.approx(want.loc[x, y])


def test_keys_and_orphans(spark, sales):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(20)], "order_id int, user_id int, x double")
    got = {r["left_column"]: r["relationship_type"] for r in insights.key_candidates(df).collect() if r["right_column"] is None}
    assert got == {"order_id": "primary_key_candidate", "user_id": "foreign_key_candidate"}
    parents = spark.createDataFrame([(0,), (1,)], "id int")
    assert tuple(insights.orphan_keys(df, "user_id", parents, "id").first()) == (1, 6)


def test_specs_apply_filters(sales):
    out = spec.run_spec(sales, {"aggregations": [("SUM", "revenue")], "group_by": "region", "order_by": "aggregate", "filters": [("orders", "above", 3)]})
    assert [tuple(r) for r in out.collect()] == [("North", 2200), ("South", 1800)]
    with pytest.raises(errors.AnalysisError):
        spec.run_spec(sales, {"aggregations": [("MEDIAN", "revenue")]})


def test_platform_rows(spark):
    projects = spark.createDataFrame([(1, "mine", 7), (2, "shared", 8), (3, "hidden", 8)], "id int, name string, owner int")
    shares = spark.createDataFrame([(2, 7), (2, 7)], "project int, member int")
    got = relational.owned_or_shared(projects, F.col("owner") == 7, shares, "id", "project")
    assert sorted(r["name"] for r in got.collect()) == ["mine", "shared"]


def test_samples_repeat_under_repartitioning(spark):
    df = spark.range(5000)
    a = {r[0] for r in relational.hash_sample(df, ["id"], 100).collect()}
    b = {r[0] for r in relational.hash_sample(df.repartition(7), ["id"], 100).collect()}
    assert a == b and len(a) == 100
    train, test = relational.hash_split(df, ["id"])
    assert train.count() + test.count() == 5000 and 3800 < train.count() < 4200


def test_sample_cut_keeps_the_smallest_hashes(spark):
    df = spark.range(20000)
    cut = {r[0] for r in relational.hash_sample(df, ["id"], 50).collect()}
    hashed = df.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(50)
    assert cut == {r[0] for r in hashed.collect()}


def test_forward_fill_across_ranges(spark):
    rows = [("big", i, f"v{i}" if i % 97 == 0 else None) for i in range(1000)] + [("late", 0, None), ("late", 1, "x"), ("late", 2, None)]
    df = spark.createDataFrame(rows, "src string, row int, cell string").repartition(5)
    got = {(r["src"], r["row"]): r["cell"] for r in relational.forward_fill(df, ["src"], ["row"], ["cell"]).collect()}
    assert all(got[("big", i)] == f"v{i - i % 97}" for i in range(1000))
    assert [got[("late", i)] for i in range(3)] == [None, "x", "x"]


def test_long_texts_count_by_identity(spark):
    df = spark.createDataFrame([("a" * 500,), ("a" * 500,), ("a" * 499 + "b",), ("s",), (None,), (None,)], "t string")
    assert A.distinct_counts(df, ["t"]).first()["distinct"] == 3
    assert A.duplicate_values(df, ["t"]).first()["duplicate_count"] == 2


def test_type_rules_differ_on_zero_one(spark):
    df = spark.createDataFrame([(i % 2, f"{i}.5", f"2024-01-{i + 1:02d}", None, "x") for i in range(10)], "flag int, rate string, day string, empty string, city string")
    upload = {r["column"]: (r["inferred_type"], r["subtype"]) for r in profile.infer_types(df).collect()}
    assert upload == {
        "flag": ("boolean", "binary"), "rate": ("numerical", "percentage"), "day": ("temporal", "date"),
        "empty": ("categorical", "unknown"), "city": ("geolocation", "region"),
    }
    other = {r["column"]: r["inferred_type"] for r in profile.infer_types(df, "profiler").collect()}
    assert other["flag"] == "numerical" and other["day"] == "categorical"
    assert dict(profile.typed(df).dtypes)["day"] == "timestamp"
    assert profile.profile_columns(df).count() == 5


def test_profile_of_sales(sales):
    rows = {r["column"]: r for r in profile.profile_columns(sales).collect()}
    assert rows["revenue"]["mean"] == 1733.3333 and rows["revenue"]["subtype"] == "currency"
    assert rows["order_date"]["range_days"] == 59 and rows["customer_id"]["unique_count"] == 2


def test_times_are_parsed_by_shape(spark):
    texts = [
        "2020-01-05", " 2020-01-05 ", "2020-1-5", "-0005-01-05", "+12345-01-05", "12345-01-05", "2020-02-30", "2020-13-01",
        "2020-01-05 10:11:12", "2020-01-05 24:00:00", "2020-01-05 10:11:12.5", "2020-01-05 10:11:12.1234567", "2020-01-05t10:11:12",
        "2020-01-05T10:11:12.25", "2020/01/05", "01/05/2020", "25/12/2020", "2020-01-05\n", "２０２０-01-05", "x", "", None,
    ]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("t"), F.lit(f)) for f in T.TIME_FORMATS])
    assert df.where(~plain.eqNullSafe(T.parse_timestamp(F.col("t")))).collect() == []
    assert df.where(T.parse_timestamp(F.col("t")).isNotNull()).count() == 10
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "EXCEPTION")  # a failed parse is told; texts of another shape have none
    try:
        assert df.where(F.col("t").isin("2020-1-5", "25/12/2020", "x")).select(T.parse_timestamp(F.col("t"))).distinct().collect() == [(None,)]
    finally:
        spark.conf.unset("spark.sql.legacy.timeParserPolicy")


def test_profile_parses_only_texts_with_a_time_shape(spark):
    df = spark.createDataFrame([("2020-1-5", "25/12/2020", "01/05/2020"), ("7-1-5", None, "12/31/2021")], "a string, b string, c string")
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "EXCEPTION")
    try:
        found = {r["column"]: r for r in profile.profile_columns(df).collect()}
    finally:
        spark.conf.unset("spark.sql.legacy.timeParserPolicy")
    assert [found[c]["inferred_type"] for c in "abc"] == ["categorical", "categorical", "temporal"]
    assert found["c"]["range_days"] == 726


def test_profile_reads_its_table_once(spark, tmp_path):
    path = str(tmp_path / "sales")
    spark.createDataFrame([(i, f"{i}.25", f"2024-01-{i % 28 + 1:02d}") for i in range(60)], "id int, price string, day string").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    out = profile.profile_columns(df)
    cells = profile._staged_cells(df)
    assert len(cells.inputFiles()) >= spark.sparkContext.defaultParallelism  # one file keeps no core idle
    assert not set(out.inputFiles()) & set(df.inputFiles())
    for f in tmp_path.glob("sales/part-*"):
        f.unlink()
    found = {r["column"]: r for r in out.collect()}
    assert (found["price"]["median"], found["day"]["range_days"], found["id"]["unique_count"]) == (29.75, 27, 60)


def test_profile_discards_its_cells(spark, monkeypatch):
    made = []
    monkeypatch.setattr(profile, "_staged_cells", lambda df, make=profile._staged_cells: made.append(make(df)) or made[0])
    kept = ("+12345-01-05", "-0005-01-05", None)
    df = spark.createDataFrame([(x, None, [1], True) for x in kept], "day string, empty string, list array<int>, flag boolean")
    df = df.withColumn("void", F.lit(None)).withColumn("span", F.expr("make_interval(1, 2)"))
    found = {r["column"]: r for r in profile.profile_columns(df).selectExpr("*", "year(first_time) AS first", "year(last_time) AS last").drop("first_time", "last_time").collect()}
    assert (found["day"]["first"], found["day"]["last"]) == (-5, 12345)
    assert [found[c]["inferred_type"] for c in ("empty", "list", "flag", "void", "span")] == ["categorical", "categorical", "boolean", "categorical", "categorical"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        made[0].count()
