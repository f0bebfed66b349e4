"""Conversions of transaction databases: plain baskets, enlarged copies, cleaned ones, and the text format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.model import entries_from, mismatches, to_transactions


def from_baskets(lines: DataFrame, separator: str = r"[\s,]+", utility: int = 1) -> DataFrame:
    """Entries of a ``value`` column of lines that list item ids; every mention of an item is worth ``utility``. What is no number is left out."""
    rows = lines.withColumn("tid", F.monotonically_increasing_id()).select("tid", F.explode(F.split(F.trim("value"), separator)).alias("word"))
    return entries_from(rows.select("tid", F.col("word").try_cast("bigint").alias("item"), F.lit(utility).alias("utility")))


def replicate(entries: DataFrame, times: int) -> DataFrame:
    """The database ``times`` over, each copy with transaction ids of its own: utilities and supports grow by that factor."""
    span = (entries.agg(F.max("tid")).first()[0] or 0) + 1
    return entries.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("tid", F.col("tid") + F.col("copy") * span).drop("copy")


def cleaned(entries: DataFrame) -> DataFrame:
    """Without entries of no utility and transactions left empty; the declared utility of each transaction is the sum of what stays."""
    return entries_from(entries.where("u > 0").select("tid", "item", F.col("u").alias("utility")))


def cleaning_report(entries: DataFrame) -> DataFrame:
    """One row: transactions whose declared utility differs from their sum, entries without utility, entries below zero."""
    wrong = mismatches(entries).agg(F.count("*").alias("mismatched"))
    rows = entries.agg(F.count_if(F.col("u") == 0).alias("zero"), F.count_if(F.col("u") < 0).alias("negative"))
    return wrong.join(F.broadcast(rows))  # one row each


def write_utility_text(entries: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``items:TU:utilities`` lines, items in ascending order; one line per transaction."""
    rows = to_transactions(entries)
    part = lambda name: F.array_join(F.transform("items", lambda x: x[name].cast("string")), " ")
    rows.select(F.concat_ws(":", part("item"), F.col("tu").cast("string"), part("utility")).alias("value")).write.mode(mode).text(path)
