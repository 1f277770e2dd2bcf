"""Repeated import of new files with a run log, and streaming counts.

Each run takes the files that arrived since the last one and stops (trigger availableNow). A batch
writes to a folder of its own number with overwrite, so a batch that is run again after a failure
leaves its rows once.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabulon.streaming.windows import event_counts

LOG = "batch_id long, status string, rows_processed long, rows_failed long, seconds double, error string"
BAD = "_bad_line"
BATCH = "import_batch"


def file_stream(
    spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None, files: int = 1000
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.format(fmt).load(folder)


def import_new_files(rows: DataFrame, target: str, log: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of files not seen before to target, one log row per batch. Blocks until done."""

    def load(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start, error = time.time(), None
        good = failed = 0
        try:
            batch = batch.persist()
            bad = F.count_if(F.col(BAD).isNotNull()) if BAD in batch.columns else F.lit(0).cast("long")
            counts = batch.agg(F.count(F.lit(1)).alias("n"), bad.alias("bad")).first()
            good, failed = counts["n"] - counts["bad"], counts["bad"]
            kept = batch.filter(F.col(BAD).isNull()).drop(BAD) if BAD in batch.columns else batch
            kept.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
            raise
        finally:
            batch.unpersist()
            status = "failed" if error else "success"
            row = [(batch_id, status, good, failed, round(time.time() - start, 3), error)]
            spark.createDataFrame(row, LOG).coalesce(1).write.mode("overwrite").parquet(f"{log}/run={batch_id}-{status}")

    query = (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def imported_rows(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("basePath", target).parquet(target).drop(BATCH)


def import_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.option("basePath", log).schema(LOG).parquet(log)


def stream_event_counts(events: DataFrame, ts: str, kind: str, value: str, target: str, checkpoint: str, width: str = "1 hour") -> StreamingQuery:
    """Window counts of a stream, each run replacing the full result in target."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = (
        event_counts(events, ts, kind, value, width)
        .writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
