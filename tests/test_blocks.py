"""Intersection of transaction lists, pairs of long transactions and recall of the heuristics."""

import random

import pytest
from pyspark.sql import functions as F

from test_mining import as_dict, database, entries, enumerate_all
from utilmine.operators import blocks
from utilmine.operators.prep import pair_rows, pairs, ranked_entries
from utilmine.queries import mine, numbered_rows


@pytest.mark.parametrize("size", [8, 1024, 1 << 16])
def test_intersections_are_exact(spark, size):
    """Sparse and dense lists, in one block and in many; what occurs nowhere has no row."""
    rows = [x | {77: 1} for x in database(4, 90, 9, 6)]
    every, e = enumerate_all(rows), entries(spark, rows)
    table = blocks.tid_blocks(e, numbered_rows(e)[0], size).cache()
    assert {r["bits"] is None for r in table.collect()} == {8: {False}, 1024: {True, False}}.get(size, {True})
    asked = [*list(every)[::3], (1, 12345), (5, 3, 1)]
    got = blocks.score(spark.createDataFrame([(list(x),) for x in asked], "itemset array<long>"), table)
    assert as_dict(got) == {tuple(sorted(x)): every[tuple(sorted(x))] for x in asked if tuple(sorted(x)) in every}
    assert blocks.score(spark.createDataFrame([], "itemset array<long>"), table).count() == 0


@pytest.mark.parametrize("name", ["huim-ga", "huim-bpso", "mhui-aco"])
def test_recall_over_many_islands(spark, name):
    """Islands of a few transactions each see little of the database, but all of it scores their proposals and the neighbours."""
    rows = database(13, 150, 14, 6)
    every, e = enumerate_all(rows), entries(spark, rows)
    m = 120
    want = {c: v for c, v in every.items() if v[0] >= m}
    found = as_dict(mine(e, name, m, iterations=40, shard_rows=100))
    assert set(found.items()) <= set(want.items()) and len(found) >= 0.9 * len(want) > 20


def test_long_transaction_is_paired_in_blocks(spark):
    """5,000 items of one transaction: no group of block pairs makes more than its share, and the pairs are all there."""
    one = spark.range(5000).select(F.lit(1).cast("long").alias("tid"), F.col("id").alias("item"), F.lit(2).cast("long").alias("u"), F.lit(10_000).cast("long").alias("tu"))
    both = pair_rows(ranked_entries(one, None, [F.col("item")]))
    tasks = [r["n"] for r in both.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(tasks) == 5000 * 4999 // 2 and max(tasks) < 0.75 * sum(tasks)
    sums = both.agg(F.sum(F.col("item") * 5000 + F.col("j")).alias("s"), F.max(F.col("j") - F.col("item")).alias("d"), F.min(F.col("j") - F.col("item")).alias("least")).first()
    assert (sums["s"], sums["d"], sums["least"]) == (sum(i * 5000 * (4999 - i) + i * j0 for i, j0 in [(0, 0)]) + sum(i * 5000 * (4999 - i) + sum(range(i + 1, 5000)) for i in range(5000)), 4999, 1)


def test_large_item_tables_meet_hot_items_in_shares(spark, monkeypatch):
    """Beyond the bound nothing is broadcast, and the entries of an item that is in every transaction go to many groups."""
    from utilmine.operators import prep

    rows = [x | {77: 1} for x in database(6, 80, 9, 6)]
    e = entries(spark, rows)
    items = prep.item_dim(e).where("item > 1").cache()
    want = sorted(map(tuple, prep.with_items(e, items).select("tid", "item", "u", "twu").collect()))
    monkeypatch.setattr(prep, "BROADCAST_BYTES", 0)
    joined = prep.with_items(e, items)
    assert sorted(map(tuple, joined.select("tid", "item", "u", "twu").collect())) == want
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan and "strategy=broadcast" not in plan
    every = enumerate_all(rows)
    assert as_dict(mine(e, "efim", 100)) == {c: v for c, v in every.items() if v[0] >= 100} == as_dict(mine(e, "hui-miner", 100))


@pytest.mark.parametrize("block", [2, 3, 256])
def test_pairs_of_mixed_lengths(spark, block):
    r = random.Random(3)
    rows = [{i: r.randint(1, 9) for i in r.sample(range(20), n)} for n in (1, 2, 3, 9, 15)]
    got = {(x["i"], x["j"]): (x["utility"], x["support"]) for x in pairs(ranked_entries(entries(spark, rows), None, [F.col("item")]), block=block).collect()}
    assert got == {c: v for c, v in enumerate_all(rows).items() if len(c) == 2}
