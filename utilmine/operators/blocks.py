"""Itemsets against all transactions by intersecting compressed lists of transactions, block by block.

Transactions are numbered and cut into blocks of 65,536. An item's part of a block is the sorted list of its rows (16 bits each), with a bitmap beside it
where the item is frequent there, and its utilities. An itemset goes to the blocks in which its rarest item occurs; there the lists
of its items are intersected, the shortest first, and the utilities of the common rows are added up. A block is one group of bounded size, whatever the data; itemsets and
blocks meet in one exchange, and only (itemset, utility, support) rows leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.operators.prep import hinted
from utilmine.plans import cut

BLOCK = 1 << 16
#: An item in more than one row of so many gets a bitmap.
_DENSE = 32


def _lists(size: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """(block, item, rows, us, bits) of the entries of one block."""
        frame = frame.sort_values(["item", "row"])
        items, first = np.unique(frame["item"].to_numpy(), return_index=True)
        rows, us = frame["row"].to_numpy().astype(np.uint16), frame["u"].to_numpy().astype(np.int64)
        ends = np.append(first[1:], len(rows))
        bits = []
        for a, b in zip(first, ends):
            marks = None
            if (b - a) * _DENSE > size:
                marks = np.zeros(size, dtype=np.uint8)
                marks[rows[a:b]] = 1
            bits.append(None if marks is None else np.packbits(marks).tobytes())
        return pd.DataFrame({"block": frame["block"].iloc[0], "item": items, "rows": [rows[a:b].tobytes() for a, b in zip(first, ends)], "us": [us[a:b].tobytes() for a, b in zip(first, ends)], "bits": bits})

    return run


def tid_blocks(entries: DataFrame, numbers: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, item, rows, us, bits); ``numbers`` (tid, row) numbers the transactions from 0 without large gaps."""
    dealt = entries.select("tid", "item", "u").join(numbers, "tid").select(F.floor(F.col("row") / size).alias("block"), (F.col("row") % size).cast("int").alias("row"), "item", "u")
    return dealt.groupBy("block").applyInPandas(_lists(size), "block long, item long, rows binary, us binary, bits binary")


class _Block:
    def __init__(self, lists: pd.DataFrame):
        self.of = {i: (np.frombuffer(r, np.uint16), np.frombuffer(u, np.int64), None if b is None else np.frombuffer(b, np.uint8)) for i, r, u, b in zip(lists["item"].tolist(), lists["rows"], lists["us"], lists["bits"])}

    def score(self, itemset: list[int]) -> tuple[int, int]:
        """(utility, support) in the block."""
        if any(i not in self.of for i in itemset):
            return 0, 0
        lists = sorted((self.of[i] for i in itemset), key=lambda x: len(x[0]))
        common = lists[0][0]
        for rows, _, bits in lists[1:]:
            if bits is not None:
                common = common[(bits[common >> 3] >> (7 - (common & 7))) & 1 == 1]
            else:
                at = np.searchsorted(rows, common)
                at[at == len(rows)] = 0
                common = common[rows[at] == common]
            if not len(common):
                return 0, 0
        return int(sum(us[np.searchsorted(rows, common)].sum() for rows, us, _ in lists)), len(common)


def _met(lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    block = _Block(lists) if len(asked) else None
    found = [(x, *block.score(list(x))) for x in asked["itemset"]] if block else []
    return pd.DataFrame([f for f in found if f[2]], columns=["itemset", "utility", "support"])


def score(itemsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """Exact (itemset, utility, support) of the distinct ``itemsets`` that occur; ``blocks`` is a kept table of ``tid_blocks``."""
    # rows of an item, from the lengths of its lists
    support = blocks.groupBy("item").agg(F.sum(F.octet_length("rows") / 2).cast("long").alias("n"))
    named = cut(itemsets.select(F.array_sort("itemset").alias("itemset")).distinct())
    rarest = named.select("itemset", F.explode("itemset").alias("item")).join(support, "item", "left").groupBy("itemset").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "item")).alias("r"))
    rarest = cut(rarest.select("itemset", F.col("r.item").alias("item")))
    asked = blocks.select(F.col("block").alias("of"), "item").join(hinted(rarest, rarest.count(), 10), "item").select("of", "itemset")
    met = blocks.groupBy("block").cogroup(asked.groupBy("of")).applyInPandas(_met, "itemset array<long>, utility long, support long")
    return met.groupBy("itemset").agg(F.sum("utility").alias("utility"), F.sum("support").alias("support"))
