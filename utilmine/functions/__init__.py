"""Column functions on itemsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def itemset_text(itemset: Column | str) -> Column:
    """Item ids separated by spaces, in ascending order."""
    return F.array_join(F.transform(F.array_sort(itemset), lambda x: x.cast("string")), " ")


def one_removed(itemset: Column | str) -> Column:
    """All subsets of one item less, in the same order."""
    size = F.size(itemset)
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.slice(itemset, 1, i - 1), F.slice(itemset, i + 1, size)))
