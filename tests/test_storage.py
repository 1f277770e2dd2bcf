import datetime as dt
import json

import pytest

from tabulon import errors
from tabulon.plans.stage import stage
from tabulon.sources import readers, tables
from tabulon.streaming import imports, windows


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    path = write(tmp_path / "d.csv", f"a{sep}b\n1{sep}2\n")
    assert readers.detect_delimiter(spark, path) == sep


def test_csv_with_a_bad_line(spark, tmp_path):
    path = write(tmp_path / "s.csv", 'name;note;n\nx;"a; \\"b\\"";1\ny;short\nz;too;many;fields\nw;;3\n')
    rows = [tuple(r) for r in readers.read_any(spark, path).collect()]
    assert rows == [("x", 'a; "b"', "1"), ("y", "short", None), ("w", None, "3")]
    assert [r[0] for r in readers.read_any(spark, path).select("n").collect()] == ["1", None, "3"]
    report = readers.csv_report(spark, path).first()
    assert (report["delimiter"], report["row_count"], report["skipped_rows"]) == (";", 3, 1)


def test_json_shapes(spark, tmp_path):
    nested = [
        {"customer": "a", "revenue": 1, "tags": ["x", "y"], "meta": {"channel": "web"}, "items": [{"q": 1}, {"q": 2}]},
        {"customer": "b", "revenue": 2, "tags": [], "meta": {"channel": "app"}, "items": [{"q": 3}]},
    ]
    flat = readers.read_json(spark, write(tmp_path / "n.json", json.dumps(nested)))
    assert flat.filter("customer = 'a'").first().asDict() == {
        "customer": "a", "revenue": 1, "tags": '["x","y"]', "meta.channel": "web", "items[0].q": 1, "items[1].q": 2,
    }
    kept = readers.read_json(spark, write(tmp_path / "k.json", json.dumps(nested)), flat=False)
    assert kept.first()["tags"] == ["x", "y"] and kept.first()["meta"]["channel"] == "web"
    for key in readers.WRAPPERS:
        assert readers.read_json(spark, write(tmp_path / f"{key}.json", json.dumps({key: nested}))).count() == 2
    scalars = readers.read_json(spark, write(tmp_path / "v.json", "[1, 2, 3]"))
    assert sorted(r["value"] for r in scalars.collect()) == ["1", "2", "3"]


def test_json_path(spark):
    rows = spark.createDataFrame([(1, '{"r":{"rows":[{"k":1},{"k":2}]}}'), (2, '{"r":{"rows":{"k":9}}}'), (3, "{}")], "id int, body string")
    got = readers.extract_path(rows, "body", "r.rows", "k int").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 2), (2, 9)]


def test_unknown_suffix(spark):
    with pytest.raises(errors.UnsupportedFormatError):
        readers.read_any(spark, "/data/file.xlsx")


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:postgresql://h/db", "SELECT 1;", limit=5, user="u")
    assert plain == {"url": "jdbc:postgresql://h/db", "user": "u", "query": "SELECT * FROM (SELECT 1) limited LIMIT 5"}
    split = readers.jdbc_options("jdbc:mysql://h/db", "SELECT id FROM t", partition=("id", 0, 100, 4))
    assert split["dbtable"] == "(SELECT id FROM t) source" and split["numPartitions"] == "4"


def test_append_and_pages(spark, tmp_path):
    df = spark.createDataFrame([(i, {"a": i}, [i]) for i in range(10)], "id int, m map<string,int>, `l st` array<int>")
    tables.append_rows(df, str(tmp_path / "t"))
    tables.append_rows(df.filter("id = 3"), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 11 and back.filter("id = 3").first()["l_st"] == "[3]"
    seen = [r["id"] for p in range(4) for r in tables.table_page(df, ["id"], 3, 3 * p).collect()]
    assert seen == list(range(10))


def test_stage_reads_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert sorted(map(tuple, stage(df).collect())) == [(1, "a"), (2, None)]


EVENTS = "event_id long, ts timestamp, kind string, value double"


def rows(day, n, start=0):
    return [(start + i, dt.datetime(2024, 1, day, i % 24), "click" if i % 3 else "view", float(i)) for i in range(n)]


def test_import_takes_each_file_once(spark, tmp_path):
    folder, target, log, mark = (str(tmp_path / n) for n in ("in", "out", "log", "mark"))
    schema = spark.createDataFrame([], EVENTS).schema
    for k, part in enumerate((rows(1, 10), rows(2, 5, 10))):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(folder)
        imports.import_new_files(imports.file_stream(spark, folder, schema), target, log, mark)
        assert imports.imported_rows(spark, target).count() == (10, 15)[k]
    runs = imports.import_log(spark, log).orderBy("batch_id").collect()
    assert [(r["status"], r["rows_processed"]) for r in runs] == [("success", 10), ("success", 5)]


def test_failed_import_is_logged(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame(rows(1, 4), EVENTS).write.parquet(folder)
    (tmp_path / "blocked").write_text("a file where the target folder should be")
    stream = imports.file_stream(spark, folder, spark.createDataFrame([], EVENTS).schema)
    with pytest.raises(Exception):
        imports.import_new_files(stream, str(tmp_path / "blocked"), log, str(tmp_path / "mark"))
    row = imports.import_log(spark, log).first()
    assert row["status"] == "failed" and row["error"]


def test_stream_counts_equal_batch(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = spark.createDataFrame(rows(1, 30), EVENTS)
    batch.repartition(3).write.parquet(folder)
    stream = imports.file_stream(spark, folder, batch.schema, files=1)
    imports.stream_event_counts(stream, "ts", "kind", "value", target, str(tmp_path / "mark"))
    want = windows.event_counts(batch, "ts", "kind", "value")
    assert sorted(map(tuple, spark.read.parquet(target).collect())) == sorted(map(tuple, want.collect()))
