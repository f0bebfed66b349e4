"""Exact utilities of candidate itemsets along their prefix trie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.operators.prep import hinted
from utilmine.plans import cut


def verify_trie(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """Exact (itemset, utility, support) by walking the candidates' prefix trie level by level over the transactions."""
    sorted_ = cut(candidates.select(F.array_sort("itemset").alias("itemset")).distinct())
    depth = sorted_.agg(F.max(F.size("itemset"))).first()[0] or 0
    edges = sorted_.select("itemset", F.explode(F.sequence(F.lit(1), F.size("itemset"))).alias("k")).select(F.slice("itemset", 1, F.col("k") - 1).alias("node"), F.get("itemset", F.col("k") - 1).alias("item")).distinct()
    edges = cut(edges)
    at = entries.select("tid", F.array().cast("array<bigint>").alias("node"), F.lit(0).cast("long").alias("total")).distinct()
    found = None
    for k in range(depth):
        wanted = edges.where(F.size("node") == k)
        n = wanted.count()
        step = at.join(entries.select("tid", "item", "u"), "tid").join(hinted(wanted, n, 8), ["node", "item"])
        at = cut(step.select("tid", F.concat("node", F.array("item")).alias("node"), (F.col("total") + F.col("u")).alias("total")))
        sums = at.groupBy(F.col("node").alias("itemset")).agg(F.sum("total").alias("utility"), F.count("*").alias("support"))
        found = sums if found is None else found.unionByName(sums)
    if found is None:
        return sorted_.select("itemset", F.lit(0).cast("long").alias("utility"), F.lit(0).cast("long").alias("support"))
    return found.join(sorted_, "itemset", "left_semi")
