"""Item dimension, ranking, pair table and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilmine.plans import cut

#: Tables of at most so many bytes, as Spark holds them, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20


def item_dim(entries: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(item, twu, utility, support): one shuffle, combined before it."""
    keys = [*(groups or []), "item"]
    return entries.groupBy(*keys).agg(F.sum("tu").alias("twu"), F.sum("u").alias("utility"), F.count("*").alias("support"))


def hinted(df: DataFrame, rows: int, numbers: int = 3) -> DataFrame:
    """Broadcast a table of counted ``rows`` with about so many ``numbers`` in each (array elements included) while it is within the bound."""
    return F.broadcast(df) if rows * (32 + 8 * numbers) <= BROADCAST_BYTES else df


#: Shares into which the entries of an item are dealt where the item table is too large to be sent.
SALTS = 16


def with_items(entries: DataFrame, items: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Entries of the items of a kept table, with its columns. The table is sent to the entries while it is within the bound; beyond it both meet by (item, share of the transactions), so no task gets all entries of one item."""
    on = [*(groups or []), "item"]
    if (sent := hinted(items, items.count(), 1 + len(items.columns))) is not items:
        return entries.join(sent, on)
    shares = items.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return entries.withColumn("salt", F.pmod(F.xxhash64("tid"), F.lit(SALTS)).cast("int")).join(shares, [*on, "salt"]).drop("salt")


def ranked_entries(entries: DataFrame, items: DataFrame | None, order: list[Column], groups: list[str] | None = None) -> DataFrame:
    """Entries of the kept items with ``rank`` (processing order) and ``ru`` (utility of later items of the transaction).

    ``order`` is a total order of the item table. Ranks are comparable within a transaction, which is all that extension needs,
    so no global sort is made: a window over each transaction numbers its items by that order. The result is hashed by transaction, for all that follows. Without ``items`` all entries are ranked, where they lie if they are hashed by transaction.
    """
    keys = [*(groups or []), "tid"]
    if items is not None:
        entries = with_items(entries, items, groups)
        entries = entries.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    back = Window.partitionBy(*keys).orderBy(*order)
    rest = back.rowsBetween(1, Window.unboundedFollowing)
    return entries.select(*keys, "item", F.row_number().over(back).alias("rank"), "u", F.coalesce(F.sum("u").over(rest), F.lit(0)).cast("long").alias("ru"), F.max("u").over(Window.partitionBy(*keys)).alias("mu"), "tu")


#: Items of a transaction that are paired with each other in one task.
PAIR_BLOCK = 256


def pair_rows(entries: DataFrame, groups: list[str] | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """(groups, tid, item, j, u, u_j, tu) of every two items of a transaction, item before j by rank.

    Transactions of up to ``block`` items are paired where they lie. The items of longer ones are cut into blocks, and each pair of blocks is a group of its own, so one long
    transaction is dealt over many tasks: an item is sent once per block of its transaction, and no group makes more than ``block`` squared rows.
    """
    keys = [*(groups or []), "tid"]

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        later = right.select(*on, F.col("item").alias("j"), F.col("rank").alias("rank_j"), F.col("u").alias("u_j"))
        return left.join(later, on).where("rank < rank_j").select(*keys, "item", "j", "u", "u_j", "tu")

    long_ = cut(entries.where(F.col("rank") > block).groupBy(*keys).agg(F.ceil(F.max("rank") / block).cast("int").alias("blocks")))
    n = long_.count()
    if not n:
        return joined(entries, entries, keys)
    within = entries.join(hinted(long_, n), keys).withColumn("b", F.floor((F.col("rank") - 1) / block).cast("int"))
    short = entries.join(hinted(long_, n), keys, "left_anti")
    # the number of groups says how much there is to do, the size of the rows does not: they are dealt to a fixed number of partitions
    parts, on = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*keys, "b1", "b2"]
    left = within.withColumn("b1", F.col("b")).withColumn("b2", F.explode(F.sequence("b", F.col("blocks") - 1))).repartition(parts, *on)
    right = within.withColumn("b2", F.col("b")).withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("b")))).repartition(parts, *on)
    return joined(short, short, keys).unionByName(joined(left, right, on))


def pairs(entries: DataFrame, groups: list[str] | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """(i, j, twu, utility, support) of every pair of items that occur together, i before j by rank of the transaction."""
    both = pair_rows(entries, groups, block)
    return both.groupBy(*(groups or []), F.col("item").alias("i"), "j").agg(F.sum("tu").alias("twu"), F.sum(F.col("u") + F.col("u_j")).alias("utility"), F.count("*").alias("support"))


def dataset_stats(entries: DataFrame) -> DataFrame:
    """One row: transactions, distinct items, average and largest length, total utility, density."""
    per = entries.groupBy("tid").agg(F.count("*").alias("n"), F.max("tu").alias("tu"))
    a = per.agg(F.count("*").alias("n_tx"), F.avg("n").alias("avg_length"), F.max("n").alias("max_length"), F.sum("tu").alias("total_utility"))
    b = entries.agg(F.countDistinct("item").alias("n_items"))
    return a.join(F.broadcast(b)).select("n_tx", "n_items", "avg_length", "max_length", "total_utility", (F.col("avg_length") / F.col("n_items")).alias("density"))


def total_utility(entries: DataFrame) -> int:
    return entries.groupBy("tid").agg(F.max("tu").alias("tu")).agg(F.sum("tu")).first()[0] or 0
