"""Sinks: whole results, results that an empty source must not replace, chunks by notice, and an archive that only grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.state import merge_archive, retained


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _file_system(spark, path)
    return fs.exists(hadoop.Path(path))


def publish(df: DataFrame, path: str) -> int:
    """Write the whole result beside the published one and put it in its place; the number of rows. A run that fails leaves the published one as it was."""
    spark, staged = df.sparkSession, f"{path.rstrip('/')}.staged"
    df.write.mode("overwrite").json(staged)
    n = spark.read.schema(df.schema).json(staged).count()
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop.Path(path), True)
    fs.rename(hadoop.Path(staged), hadoop.Path(path))
    return n


def publish_guarded(df: DataFrame, path: str) -> bool:
    """publish, but a result without rows keeps what was published: a source that gives nothing is broken, not empty."""
    if df.isEmpty() and exists(df.sparkSession, path):
        return False
    publish(df, path)
    return True


def write_chunks(chunks: DataFrame, path: str, key: str = "nid") -> None:
    """Chunks in one folder a notice, in reading order; notices of this run replace their folders, others stay."""
    rows = chunks.repartition(F.col(key)).sortWithinPartitions(key, "pos")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def archive(fresh: DataFrame, path: str, key: str, closes: str, noticed: str, today: Column, keep_days: int = 365) -> int:
    """Merge a run's rows into the archive: locked rows stay as they are, rows that closed before today are locked with the day, rows out of the window go."""
    spark = fresh.sparkSession
    locked_at = F.when(F.col(closes) < today, today)
    rows = fresh.withColumn("locked_at", locked_at)
    if exists(spark, path):
        before = spark.read.schema(rows.schema).parquet(path)
        merged = merge_archive(before.withColumn("locked", F.col("locked_at").isNotNull()), rows.withColumn("locked", F.lit(False)), key).drop("locked")
        rows = merged.withColumn("locked_at", F.coalesce("locked_at", locked_at)).select(*rows.columns)
    rows = retained(rows, closes, noticed, F.date_sub(today, keep_days))
    staged = f"{path.rstrip('/')}.staged"
    rows.write.mode("overwrite").parquet(staged)
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop.Path(path), True)
    fs.rename(hadoop.Path(staged), hadoop.Path(path))
    return spark.read.parquet(path).count()
