"""Intermediate tables in the folder all executors share, and null-safe helpers for any input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verispark.session import fresh_path

_STORED: list[str] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors.

    The files stay until `release`, since results that read them are lazy.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables of `store`, once their results are written; returns how many there were."""
    n = len(_STORED)
    while _STORED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


TEXT_BATCH = 2000  # rows of whole texts that a Python worker holds at once


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for columns of whole texts, unless the session names a size of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, TEXT_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
