"""Vertical level loop: itemsets grow by one item per level, joined on the transaction.

L(k+1) = Lk joined with the entries on (tid, later rank); the utility of P and y in a transaction is u(P) + u(y), so
a two-way join is enough. Both sides are kept hashed by transaction, level after level, so only the per-itemset sums
change partitioning. What is kept can be computed again from the entries if an executor is lost; sums are checkpoints. Prefixes that cannot lead to a result are dropped before the join; items
never are, since a weak item can still extend a strong prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utilmine.operators.prep import hinted
from utilmine.plans import cut


@dataclass
class Rule:
    """What a strategy emits and what it extends, over the sums (utility, rem, twu, mu, support) of an itemset."""

    emit: Column
    extend: Column
    pair_filter: Callable[[DataFrame], DataFrame] | None = None
    max_length: int | None = None
    groups: list[str] = field(default_factory=list)
    border: Callable[[DataFrame], tuple[Column, Column]] | None = None
    before_join: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def mine_levels(entries: DataFrame, rule: Rule) -> DataFrame:
    """(groups, itemset in processing order, utility, support) of all emitted itemsets; ``entries`` are ranked ones, hashed by transaction.

    ``pair_filter`` makes the table of pairs (i, j) that may follow each other from the entries as they are kept here.
    """
    g = rule.groups
    keys = [*g, "tid"]
    base = entries.select(*keys, "item", "rank", "u", "ru", "mu", "tu", *(["threshold"] if "threshold" in entries.columns else []))
    base = base.persist()
    kept = [base]
    threshold = "threshold" in entries.columns
    extra = ["threshold"] if threshold else []
    level = base.select(*keys, F.array("item").alias("itemset"), F.col("item").alias("last"), F.col("rank").alias("last_rank"), F.col("u").alias("iu"), "ru", "mu", "tu", *extra)
    right = base.select(*keys, F.col("item").alias("next"), F.col("rank").alias("next_rank"), F.col("u").alias("next_u"), F.col("ru").alias("next_ru"))
    pair_table, found, length = None, None, 1
    emit, extend = rule.emit, rule.extend
    while True:
        sums = level.groupBy(*g, "itemset").agg(
            F.sum("iu").alias("utility"), F.sum("ru").alias("rem"), F.sum("tu").alias("twu"), F.sum("mu").alias("mu"), F.count("*").alias("support"), *(F.min(c).alias(c) for c in extra)
        )
        sums = cut(sums.withColumn("length", F.lit(length)))
        for old in kept[1:-1]:
            old.unpersist()
        kept[1:-1] = []
        if rule.border:
            emit, extend = rule.border(sums)
        out = sums.where(emit).select(*g, "itemset", "utility", "support")
        found = out if found is None else found.unionByName(out)
        if rule.max_length is not None and length >= rule.max_length:
            break
        alive = sums.where(extend).select(*g, "itemset")
        n = alive.count()
        if not n:
            break
        grown = level.join(hinted(alive, n, length + 2), [*g, "itemset"], "left_semi")
        joined = grown.join(right, keys).where("next_rank > last_rank")
        if rule.pair_filter:
            if pair_table is None:
                pair_table = cut(rule.pair_filter(base))
                pair_rows = pair_table.count()
            joined = joined.join(hinted(pair_table.select(*g, F.col("i").alias("last"), F.col("j").alias("next")), pair_rows), [*g, "last", "next"], "left_semi")
        if rule.before_join:
            joined = rule.before_join(joined, grown)
        level = (
            joined.select(*keys, F.concat("itemset", F.array("next")).alias("itemset"), F.col("next").alias("last"), F.col("next_rank").alias("last_rank"), (F.col("iu") + F.col("next_u")).alias("iu"), F.col("next_ru").alias("ru"), "mu", "tu", *extra)
        ).persist()
        kept.append(level)
        length += 1
    for old in kept:
        old.unpersist()
    return found
