"""Seeded synthetic transactions with skewed items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.model import entries_from


def generate(spark: SparkSession, transactions: int, items: int, max_length: int, seed: int = 42, low: int = 1, high: int = 20) -> DataFrame:
    """Entries; item numbers follow floor(r * r * items) + 1 with r uniform, so small numbers are frequent."""
    rows = spark.range(transactions).select(F.col("id").alias("tid"), F.explode(F.sequence(F.lit(1), (F.floor(F.rand(seed) * max_length) + 1).cast("int"))).alias("k"))
    drawn = rows.select("tid", (F.floor(F.pow(F.rand(seed + 1), 2) * items) + 1).alias("item"), (F.floor(F.rand(seed + 2) * (high - low + 1)) + low).cast("long").alias("utility"))
    return entries_from(drawn.dropDuplicates(["tid", "item"]))
