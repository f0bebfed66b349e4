"""Schemas and builders of transaction databases with item utilities.

Canonical forms
---------------
transactions : tid LONG, tu LONG, items ARRAY<STRUCT<item LONG, utility LONG>>
entries      : tid LONG, item LONG, u LONG, tu LONG          (one row per item of a transaction)
result       : itemset ARRAY<LONG>, length INT, utility LONG, support LONG
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRANSACTIONS = "tid long, tu long, items array<struct<item:long,utility:long>>"
RESULT = "itemset array<long>, length int, utility long, support long"
#: Largest item id of the text format (unsigned 32 bits).
MAX_ITEM = 4294967295


def entries_from(df: DataFrame, tid: str = "tid", item: str = "item", utility: str = "utility", tu: str | None = None) -> DataFrame:
    """Entries of any (tid, item, utility) table; an item that occurs twice in a transaction has its utilities summed.

    The declared transaction utility is ``tu`` where given, else the sum of the item utilities.
    """
    chosen = df.select(F.col(tid).cast("long").alias("tid"), F.col(item).cast("long").alias("item"), F.col(utility).cast("long").alias("u"), *([F.col(tu).cast("long").alias("tu")] if tu else []))
    # one exchange by transaction serves both sums
    dealt = chosen.where("tid IS NOT NULL AND item IS NOT NULL").repartition("tid")
    once = dealt.groupBy("tid", "item").agg(F.sum("u").alias("u"), *([F.max("tu").alias("tu")] if tu else []))
    return once if tu else once.withColumn("tu", F.sum("u").over(Window.partitionBy("tid")))


def to_transactions(entries: DataFrame) -> DataFrame:
    """Horizontal form, items in ascending order."""
    return entries.groupBy("tid").agg(F.max("tu").alias("tu"), F.array_sort(F.collect_list(F.struct("item", F.col("u").alias("utility")))).alias("items"))


def to_entries(transactions: DataFrame, recompute_tu: bool = False) -> DataFrame:
    """Vertical form of horizontal transactions; empty item lists vanish."""
    rows = transactions.select("tid", "tu", F.explode("items").alias("e")).select("tid", F.col("e.item").alias("item"), F.col("e.utility").alias("utility"), "tu")
    return entries_from(rows, tu=None if recompute_tu else "tu")


def checked(entries: DataFrame) -> DataFrame:
    """``entries`` that fail when they are read if a utility is negative, at no cost of a job of its own."""
    wrong = F.raise_error(F.lit("negative utilities are not supported")).cast("long")
    return entries.withColumn("u", F.when(F.col("u") < 0, wrong).otherwise(F.col("u")))


def check(entries: DataFrame) -> None:
    """Refuse what the bounds cannot handle: negative utilities and ids out of range."""
    bad = entries.agg(F.min("u").alias("u"), F.min("item").alias("low"), F.max("item").alias("high")).first()
    if bad["u"] is not None and bad["u"] < 0:
        raise ValueError("negative utilities are not supported")
    if bad["low"] is not None and (bad["low"] < 0 or bad["high"] > MAX_ITEM):
        raise ValueError(f"item ids must be from 0 to {MAX_ITEM}")


def mismatches(entries: DataFrame) -> DataFrame:
    """Transactions whose declared utility differs from the sum of their items."""
    sums = entries.groupBy("tid").agg(F.sum("u").alias("item_sum"), F.max("tu").alias("tu"))
    return sums.where("item_sum != tu")
