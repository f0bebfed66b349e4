"""Incremental mining with kept state: what a batch does not touch is not read again.

The state is the search tree so far. Every itemset that was reached has its sums (utility, support, bound); one whose bound reached the threshold is *open*, and its
conditional transactions have gone on to its extensions. One that is still closed keeps its conditional transactions as a list. A batch sends its transactions down
the tree: they add to the sums of the itemsets that they touch, go on where these are open, and join the list where they are closed. When a bound
rises to the threshold, the itemset is opened: its list goes on together with the batch's rows, once and for all. So old transactions are read only
where an itemset is opened, and every step down the tree takes one exchange of what the batch touched.

Items are processed in the order of their ids, which no batch changes, and none is left out of the lists, as a weak item may become strong later.

Tables are folders by batch, which are replaced if a batch is run again: ``nodes`` (itemset, utility, support, bound, opened: what the batch added) and ``lists``
(itemset, items, us, base, n, w), ordered by a hash of the itemset so that reads of a few lists skip the rest. ``compact`` adds up the batches so far.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.operators.prep import hinted
from utilmine.operators.shards import _project, _schema
from utilmine.plans import cut
from utilmine.shipping import ship

NODES = "itemset array<long>, utility long, support long, bound long, opened boolean"
LISTS = "bucket int, " + _schema("exact", False)
BUCKETS = 1024


def _bucket() -> "F.Column":
    return F.pmod(F.xxhash64("itemset"), F.lit(BUCKETS)).cast("int")


def by_item(entries: DataFrame) -> DataFrame:
    """Transactions as rows of the tree's top: all items, in the order of their ids."""
    rows = entries.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("item", "u"))).alias("x"))
    us = F.transform("x", lambda a: a["u"])
    total = F.aggregate(us, F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select(F.array().cast("array<bigint>").alias("itemset"), F.transform("x", lambda a: a["item"]).alias("items"), us.alias("us"), F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("n"), total.alias("w"))


class MiningState:
    """The tree of one threshold, kept in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str, min_utility: int):
        ship(spark)
        self.spark, self.path, self.m = spark, path.rstrip("/"), min_utility
        for name, schema in (("nodes", NODES), ("lists", LISTS)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{self.path}/{name}/batch=-1")

    def _read(self, name: str, schema: str, before: int) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.path}/{name}").where(F.col("batch") < before).drop("batch")

    def nodes(self, before: int) -> DataFrame:
        """Sums of all itemsets that the batches before that one reached."""
        rows = self._read("nodes", NODES, before)
        return rows.groupBy("itemset").agg(F.sum("utility").alias("utility"), F.sum("support").alias("support"), F.sum("bound").alias("bound"), F.max("opened").alias("opened"))

    def apply(self, entries: DataFrame, batch: int) -> tuple[DataFrame, dict]:
        """Add the transactions of a batch. Returns ((itemset, length, utility, support) of touched itemsets that have a utility of the threshold or more by now, row counts).

        Transactions must not span batches. The same batch applied again gives the same state.
        """
        rows = cut(by_item(entries).mapInArrow(_project("exact", False), _schema("exact", False)))
        counts = {"new": entries.select("tid").distinct().count(), "read_again": 0}
        added, kept, reports = [], [], []
        old = self.nodes(batch)
        while True:
            more = cut(rows.groupBy("itemset").agg(F.sum("base").alias("d_utility"), F.sum("n").alias("d_support"), F.sum("w").alias("d_bound")))
            n = more.count()
            if not n:
                break
            known = old.join(hinted(more.select("itemset"), n, 8), "itemset", "left_semi")
            zero = F.lit(0).cast("long")
            sums = more.join(known, "itemset", "left").select(
                "itemset", *(f"d_{c}" for c in ("utility", "support", "bound")), *((F.coalesce(c, zero) + F.col(f"d_{c}")).alias(c) for c in ("utility", "support", "bound")), F.coalesce("opened", F.lit(False)).alias("was_open"), F.col("opened").isNotNull().alias("had_list")
            )
            sums = cut(sums.withColumn("open", F.col("was_open") | (F.col("bound") >= self.m)))
            added.append(sums.select("itemset", *(F.col(f"d_{c}").alias(c) for c in ("utility", "support", "bound")), F.col("open").alias("opened")))
            reports.append(sums.where(F.col("utility") >= self.m))
            opened = sums.where("open").select("itemset")
            risen = F.col("open") & ~F.col("was_open") & F.col("had_list")
            did = sums.agg(F.count_if("open").alias("open"), F.count_if(risen).alias("risen"), F.collect_set(F.when(risen, _bucket())).alias("buckets")).first()  # at most BUCKETS numbers
            n_open, buckets = did["open"], did["buckets"]
            kept.append(rows.join(hinted(opened, n_open, 8), "itemset", "left_anti"))
            if not n_open:
                break
            on = rows.join(hinted(opened, n_open, 8), "itemset", "left_semi")
            if buckets:
                fresh = hinted(sums.where(risen).select("itemset"), did["risen"], 8)
                lists = self._read("lists", LISTS, batch).where(F.col("bucket").isin(buckets)).drop("bucket")
                lists = cut(lists.join(fresh, "itemset", "left_semi"))
                counts["read_again"] += lists.agg(F.sum("n")).first()[0] or 0
                on = on.unionByName(lists)
            rows = cut(on.where(F.size("items") > 0).mapInArrow(_project("exact", False), _schema("exact", False)))
        self._write("nodes", added, NODES, batch)
        self._write("lists", [k.withColumn("bucket", _bucket()) for k in kept], LISTS, batch)
        empty = self.spark.createDataFrame([], "itemset array<long>, length int, utility long, support long")
        out = [r.select("itemset", F.size("itemset").alias("length"), "utility", "support") for r in reports]
        return reduce(DataFrame.unionByName, out, empty), counts

    def _write(self, name: str, parts: list[DataFrame], schema: str, batch: int) -> None:
        whole = reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], schema))
        if name == "lists":
            whole = whole.repartitionByRange("bucket").sortWithinPartitions("bucket")
        whole.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def result(self, before: int = 1 << 30) -> DataFrame:
        """(itemset, length, utility, support) of all high-utility itemsets of the batches before that one."""
        return self.nodes(before).where(F.col("utility") >= self.m).select("itemset", F.size("itemset").alias("length"), "utility", "support")

    def compact(self, target: str, before: int) -> "MiningState":
        """The same state in a new folder, one row per itemset and without the lists of opened ones; for use between runs."""
        out = MiningState(self.spark, target, self.m)
        nodes = cut(self.nodes(before))
        nodes.write.mode("overwrite").parquet(f"{out.path}/nodes/batch=0")
        closed = nodes.where("NOT opened").select("itemset")
        lists = self._read("lists", LISTS, before).join(closed, "itemset", "left_semi")
        out._write("lists", [lists], LISTS, 0)
        return out
