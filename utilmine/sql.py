"""``mine_utility``: a table function for SQL callers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf



@udtf(returnType="itemset array<bigint>, length int, utility bigint, support bigint")
class MineUtility:
    """``SELECT * FROM mine_utility(TABLE(t) PARTITION BY (g), m)`` (or ``WITH SINGLE PARTITION``): exact high-utility itemsets of each group of (tid, item, u) rows.

    A group is mined in one task, so this is for many small groups (a store's day); use ``mine`` for one large database.
    """

    def __init__(self):
        self.lists: dict[int, dict[int, int]] = {}
        self.m = 1

    def eval(self, row, m: int):
        self.m = m
        of = self.lists.setdefault(row["item"], {})
        of[row["tid"]] = of.get(row["tid"], 0) + row["u"]

    def terminate(self):
        total: dict[int, int] = {}
        for of in self.lists.values():
            for t, u in of.items():
                total[t] = total.get(t, 0) + u
        bound = {i: sum(total[t] for t in of) for i, of in self.lists.items()}
        order = sorted((i for i in self.lists if bound[i] >= self.m), key=lambda i: (bound[i], i))
        stack = [((i,), self.lists[i], k) for k, i in enumerate(order)]
        while stack:
            itemset, rows, at = stack.pop()
            utility = sum(rows.values())
            if utility >= self.m:
                yield sorted(itemset), len(itemset), utility, len(rows)
            if sum(total[t] for t in rows) >= self.m:
                for k in range(at + 1, len(order)):
                    of = self.lists[order[k]]
                    both = {t: u + of[t] for t, u in rows.items() if t in of}
                    if both:
                        stack.append(((*itemset, order[k]), both, k))


def register(spark: SparkSession) -> None:
    spark.udtf.register("mine_utility", MineUtility)
