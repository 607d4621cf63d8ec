"""Access to the Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``: one Parquet file, or a folder of them."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, a scan or what is made from one row by row, over as many tasks as there are cores, by a hash of ``key``.

    Only where the scan has fewer partitions than that, which bounds what is moved by a partition's size for each core; a table
    of more is left as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.rdd().getNumPartitions() < cores else df
