"""Parquet table source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """The table ``name`` of a folder of parquet tables (a file or a folder of parts).

    ``spread``: a scan of fewer tasks than the cluster has cores (a small table in one row group) is
    dealt out to all cores first, for work that costs more than moving its rows. Larger scans are
    left as they are; columns and filters still reach the scan.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if spread and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows
