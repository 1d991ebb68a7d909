"""The test tables in the roles of the domain: parts are listings, order lines are trades, brands are districts, suppliers are complexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A fixed day, never the clock's.
TODAY = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("district"), F.col("p_size").cast("double").alias("area"), (F.col("p_retailprice") / 100).alias("price"),
        F.col("p_type").alias("kind"), F.col("p_name").alias("name"), (F.col("p_size") >= 45).alias("large"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole cents, so that quantiles have few decimals and rounding them for comparison meets no ties
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("complex"), F.col("p_brand").alias("district"), F.col("p_size").cast("double").alias("area"),
        (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 10_000).alias("amount"), F.to_date("l_shipdate").alias("date"), (F.col("l_returnflag") == "R").alias("direct"),
        (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")).alias("new_build"), (F.col("p_size") >= 45).alias("large"),
    )


#: The same roles in SQL.
LISTINGS_SQL = """listings AS (SELECT p_partkey AS id, p_brand AS district, CAST(p_size AS DOUBLE) AS area, p_retailprice / 100 AS price, p_type AS kind,
    p_name AS name, p_size >= 45 AS large FROM part)"""
TRADES_SQL = """trades AS (SELECT l_orderkey, l_linenumber, l_suppkey AS complex, p_brand AS district, CAST(p_size AS DOUBLE) AS area,
    floor(l_extendedprice * 100 / l_quantity) / 10000 AS amount, CAST(l_shipdate AS DATE) AS date, l_returnflag = 'R' AS direct,
    l_shipdate >= TIMESTAMP '1995-01-01' AS new_build, p_size >= 45 AS large FROM lineitem JOIN part ON l_partkey = p_partkey)"""
