"""Sources, sinks and streams. Files are derived from the test tables and written below the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.base import query
from tabulon.plans.stage import stage_root
from tabulon.sources import readers, tables
from tabulon.streaming import imports


def fresh(t, name: str) -> str:
    return f"{stage_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_scan", """
SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority || '; "q"' AS note, o_orderstatus FROM orders""")
def _(t):
    path = fresh(t, "orders.csv")
    rows = t.orders.select("o_orderkey", F.concat("o_orderpriority", F.lit('; "q"')).alias("note"), "o_orderstatus")
    rows.write.csv(path, sep=";", header=True, quote='"', escape="\\")
    return readers.read_csv(t.spark, path)


@query("csv_bad_lines", """
SELECT ';' AS delimiter, (SELECT count(*) FROM customer) AS row_count, (SELECT count(*) FROM nation) AS skipped_rows,
  (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS first_column_filled""")
def _(t):
    path = fresh(t, "customers.csv")
    good = t.customer.select(F.concat_ws(";", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    bad = t.nation.select(F.concat_ws(";", F.lit("x"), "n_name", F.lit("1"), F.lit("2"), F.lit("3")).alias("value"))
    header = t.region.limit(1).select(F.lit("key;name;segment").alias("value"))
    header.unionByName(good).unionByName(bad).coalesce(1).write.text(path)
    return readers.csv_report(t.spark, path)


@query("json_scan_flatten", """
SELECT n_nationkey::BIGINT AS id, n_name AS "place.name", n_regionkey::BIGINT AS "place.region", '[' || n_nationkey || ',7]' AS tags,
  n_name || 'a' AS "parts[0].p", n_name || 'b' AS "parts[1].p" FROM nation""")
def _(t):
    path = fresh(t, "nations.json")
    part = lambda s: F.struct(F.concat("n_name", F.lit(s)).alias("p"))
    rows = t.nation.select(
        F.col("n_nationkey").alias("id"),
        F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place"),
        F.array(F.col("n_nationkey"), F.lit(7)).alias("tags"),
        F.array(part("a"), part("b")).alias("parts"),
    )
    wrapped = rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("records"))).alias("value"))
    wrapped.coalesce(1).write.text(path)
    return readers.read_json(t.spark, path)


@query("json_path", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, 0 AS i FROM events UNION ALL
SELECT event_id, CAST(props->>'k' AS BIGINT) + 1, 1 FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    pages = t.events.select(
        "event_id",
        F.to_json(F.struct(F.struct(F.array(
            F.struct(k.alias("k"), F.lit(0).alias("i")), F.struct((k + 1).alias("k"), F.lit(1).alias("i"))
        ).alias("rows")).alias("result"))).alias("body"),
    )
    return readers.extract_path(pages, "body", "result.rows", "k bigint, i int")


@query("flatten_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS \"props.k\" FROM events")
def _(t):
    rows = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return readers.flatten(rows)


@query("parquet_scan", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return readers.read_any(t.spark, t.path("orders"), tokens=("F",)).select("o_orderkey", "o_orderstatus")


@query("table_append", """
SELECT doc_id, '{"quality":' || quality || ',"toxic":' || toxic || '}' AS flags FROM labels UNION ALL
SELECT doc_id, '{"quality":' || quality || ',"toxic":' || toxic || '}' FROM labels WHERE quality = 1""")
def _(t):
    path = fresh(t, "dataset")
    rows = t.labels.select("doc_id", F.struct("quality", "toxic").alias("flags"))
    tables.append_rows(rows, path)
    tables.append_rows(rows.filter("flags.quality = 1"), path)
    return t.spark.read.parquet(path)


@query("table_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
def _(t):
    return tables.table_page(t.orders, ["o_orderkey"], 100, 250)


@query("schema_rows", """
SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint'), (1, 'o_custkey', 'bigint'), (2, 'o_orderstatus', 'string'), (3, 'o_totalprice', 'double'),
  (4, 'o_orderdate', 'timestamp_ntz'), (5, 'o_orderpriority', 'string')) v(position, name, type)""")
def _(t):
    return tables.schema_rows(t.orders)


@query("row_count", "SELECT count(*) AS row_count FROM lineitem")
def _(t):
    return tables.row_count(t.lineitem)


@query("event_append", """
SELECT event_id, ts, event_type AS event_name, 'web' AS source, '{"user_id":' || user_id || '}' AS payload FROM events""")
def _(t):
    path = fresh(t, "event-log")
    rows = t.events.select("event_id", "ts", "event_type", "user_id")
    tables.append_rows(tables.event_rows(rows, "event_type", "web", ["user_id"]), path)
    return t.spark.read.parquet(path)


def imported(t):
    target, log, mark = fresh(t, "imported"), fresh(t, "import-log"), fresh(t, "import-checkpoint")
    for _ in range(2):  # the second run finds nothing new
        rows = imports.file_stream(t.spark, t.folder, t.events.schema, pattern="events.parquet")
        imports.import_new_files(rows, target, log, mark)
    return target, log


@query("scheduled_import", "SELECT * FROM events")
def _(t):
    return imports.imported_rows(t.spark, imported(t)[0])


@query("import_log", "SELECT 0::BIGINT AS batch_id, 'success' AS status, count(*) AS rows_processed, 0::BIGINT AS rows_failed FROM events")
def _(t):
    return imports.import_log(t.spark, imported(t)[1]).select("batch_id", "status", "rows_processed", "rows_failed")


@query("event_windows_stream", """
SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS window_end,
  event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2, 3""")
def _(t):
    target = fresh(t, "event-counts")
    rows = imports.file_stream(t.spark, t.folder, t.events.schema, pattern="events.parquet")
    imports.stream_event_counts(rows, "ts", "event_type", "value", target, fresh(t, "event-counts-checkpoint"))
    return t.spark.read.parquet(target)
