"""Runs of several strategies over one database, with counts, times and a comparison of results."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from utilmine.plans import cut
from utilmine.queries import mine
from utilmine.sources.utility_text import diff

METRICS = "algorithm string, min_utility long, seconds double, itemsets long, mismatches long, exact boolean"


def run(entries: DataFrame, algorithms: list[str], min_utility: int, reference: DataFrame | None = None, **options) -> DataFrame:
    """One row per strategy. ``exact`` is null where there is no reference to compare with."""
    entries = cut(entries)
    rows = []
    for name in algorithms:
        began = time.time()
        found = cut(mine(entries, name, min_utility, **options))
        count = found.count()
        took = time.time() - began
        wrong = diff(reference, found).count() if reference is not None else None
        rows.append((name, min_utility, took, count, wrong, None if wrong is None else wrong == 0))
    return entries.sparkSession.createDataFrame(rows, METRICS)


#: Kinds of report.
FORMATS = ("json", "csv", "console")


def report(metrics: DataFrame, path: str, kind: str = "json") -> None:
    """Write ``run``'s rows as JSON lines or CSV with a head, or show them."""
    if kind not in FORMATS:
        raise ValueError(f"unknown report format {kind!r}")
    if kind == "console":
        metrics.show(truncate=False)
    elif kind == "csv":
        metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)  # a row per strategy
    else:
        metrics.coalesce(1).write.mode("overwrite").json(path)


def sweep(entries: DataFrame, algorithm: str, thresholds: list[int], partitions: list[int], **options) -> DataFrame:
    """``run`` for each threshold and each number of shuffle partitions (the last column); all results of a threshold are held against its first."""
    from pyspark.sql import functions as F

    spark, out = entries.sparkSession, None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for m in thresholds:
            first = None
            for n in partitions:
                spark.conf.set("spark.sql.shuffle.partitions", str(n))
                first = cut(mine(entries, algorithm, m, **options)) if first is None else first
                rows = run(entries, [algorithm], m, first, **options).withColumn("partitions", F.lit(n))
                out = rows if out is None else out.unionByName(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return out
