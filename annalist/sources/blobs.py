"""Files by content: each is stored under its digest, with the scopes that may read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blobs(spark: SparkSession, path: str, scope: str) -> DataFrame:
    """The files under path: digest (SHA-256), scope, length, content, where it lay."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.sha2("content", 256).alias("digest"), F.lit(scope).alias("scope"), "length", "content", F.col("path").alias("source"))


def store(found: DataFrame, target: str) -> None:
    """Adds what the store doesn't have yet; equal content is stored once, its scopes beside it."""
    spark = found.sparkSession
    once = found.groupBy("digest").agg(F.first("content").alias("content"), F.first("length").alias("length"))
    try:
        once = once.join(spark.read.parquet(f"{target}/blobs").select("digest"), "digest", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    once.write.mode("append").parquet(f"{target}/blobs")
    found.select("digest", "scope").distinct().write.mode("append").parquet(f"{target}/scopes")


def fetch(spark: SparkSession, target: str, scope: str) -> DataFrame:
    """What a scope may read: digest, length, content."""
    may = spark.read.parquet(f"{target}/scopes").filter(F.col("scope") == scope).select("digest").distinct()
    return spark.read.parquet(f"{target}/blobs").join(may, "digest", "left_semi")
