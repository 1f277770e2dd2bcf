"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "rfm_rank", "rfm_edges", "describe", "histogram", "value_counts_top", "duplicate_rows", "normalize_table",
    "quality_issues", "cohort_retention", "correlation_matrix", "t_test", "spearman", "linear_forecast", "rolling_mean",
    "timestamp_gaps", "ridge_regression", "csv_scan", "event_windows_stream",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cursor.description], cursor.fetchall())
