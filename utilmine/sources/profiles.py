"""Transaction databases from the driver's tables: entries (tid, item, u, tu) and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.model import entries_from


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, part brands as items, quantities as utilities (dense)."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.expr("cast(substr(p_brand, 7) AS int)").alias("item"))
    return entries_from(line.join(part, "l_partkey").select(F.col("l_orderkey").alias("tid"), "item", F.col("l_quantity").cast("bigint").alias("utility")))


def supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, suppliers as items."""
    line = _read(spark, sf_dir, "lineitem")
    return entries_from(line.select(F.col("l_orderkey").alias("tid"), F.col("l_suppkey").alias("item"), F.col("l_quantity").cast("bigint").alias("utility")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as transaction, the event's key as item, its value in hundredths as utility (sparse)."""
    table = _read(spark, sf_dir, "events")
    return entries_from(table.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("tid"), F.get_json_object("props", "$.k").cast("bigint").alias("item"), F.round(F.col("value") * 100).cast("bigint").alias("utility")))


PROFILES = {"brand": brand, "supp": supp, "events": events}

SQL = {
    "brand": "SELECT l_orderkey AS tid, CAST(substr(p_brand, 7) AS INT) AS item, CAST(l_quantity AS BIGINT) AS u FROM lineitem JOIN part ON l_partkey = p_partkey",
    "supp": "SELECT l_orderkey AS tid, l_suppkey AS item, CAST(l_quantity AS BIGINT) AS u FROM lineitem",
    "events": "SELECT user_id * 100 + day(ts) AS tid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, CAST(round(value * 100) AS BIGINT) AS u FROM events",
}
