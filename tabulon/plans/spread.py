"""Use all cores on an input that comes in few files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over the cores when the scan has fewer files than cores; else unchanged.

    Meant for work that costs far more than one shuffle of the needed columns: iterative training
    and scoring in Python workers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
