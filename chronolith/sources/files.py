"""Listings, traffic readings and diff texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRAFFIC


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, bytes`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("bytes"))


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAFFIC).option("multiLine", True).json(path)


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """``key, body`` of ``<key>.diff`` files, each read whole.

    A file is a row, and small files are packed into tasks by Spark; compact once with :func:`compact_diffs`.
    """
    texts = spark.read.option("pathGlobFilter", "*.diff").text(path, wholetext=True)
    return texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.diff$", 1).alias("key"), F.col("value").alias("body"))


def compact_diffs(spark: SparkSession, path: str, out: str, partitions: int = 8) -> DataFrame:
    """Many small diff files as one Parquet table."""
    read_diffs(spark, path).repartition(partitions, "key").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)
