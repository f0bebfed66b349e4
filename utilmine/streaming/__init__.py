"""Streams of (tid, item, utility) rows or text lines: incremental mining, count windows, and event-time windows mined as they close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from utilmine.model import checked, entries_from, to_entries
from utilmine.plans import cut
from utilmine.queries import full_windows, mine_windows, numbered_rows, window_ids
from utilmine.sources.utility_text import batch_transactions
from utilmine.streaming.state import MiningState


def incremental(stream: DataFrame, state_path: str, result_path: str, min_utility: int, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the high-utility itemsets of all rows so far up to date, a batch at a time, from kept state (``state.MiningState``).

    A batch reads the sums of the itemsets that it touches, and old transactions only where an itemset reaches the threshold for the first time. A batch that
    is run again replaces its own folders, so results do not depend on retries. ``result_path/batch=N`` holds what batch N touched; the newest report of an
    itemset counts. Transactions must not span batches.
    """

    def step(batch: DataFrame, number: int) -> None:
        report, _counts = MiningState(batch.sparkSession, state_path, min_utility).apply(batch_entries(batch), number)
        report.write.mode("overwrite").parquet(f"{result_path}/batch={number}")

    return _started(stream, step, checkpoint, available_now)


def batch_entries(batch: DataFrame) -> DataFrame:
    """Entries of a batch of (tid, item, utility) rows, or of lines with the file they come from."""
    rows = to_entries(batch_transactions(batch)) if "value" in batch.columns else entries_from(batch)
    return cut(checked(rows))


def _started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


_TAIL = "row long, tid long, item long, u long, tu long"
_COUNTS = "total long"


def _kept_tail(spark, state_path: str, before: int) -> tuple[DataFrame, int]:
    """((row, tid, item, u, tu) of the transactions that later windows need, how many transactions there were) when batch ``before`` begins."""
    if before == 0:
        return spark.createDataFrame([], _TAIL), 0
    at = f"batch={before - 1}"
    total = spark.read.schema(_COUNTS).parquet(f"{state_path}/counts/{at}").first()[0]
    return spark.read.schema(_TAIL).parquet(f"{state_path}/tail/{at}"), total


def count_windows(stream: DataFrame, state_path: str, result_path: str, min_utility: int, window: int, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Sliding windows of ``window`` transactions, half a window apart, mined as soon as they are full: the blocks of ``shuim`` on the same rows.

    Transactions are numbered over all batches in the order of their ids. The state of a batch is a folder: how many transactions there were, and those that the next windows
    need, at most ``window`` of them. A batch reads the state of the one before and replaces its own, so a query that is started again, or a batch that is
    run again, gives the same windows. All windows that a batch fills are mined in one pass.
    """
    window = max(2, window)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch_entries(batch)
        tail, before = _kept_tail(spark, state_path, number)
        numbers, more = numbered_rows(new)
        rows = new.join(numbers, "tid").select((F.col("row") + before).alias("row"), "tid", "item", "u", "tu")
        rows = cut(tail.unionByName(rows))
        done, full = full_windows(before, window), full_windows(before + more, window)
        # transactions of different batches may share an id: within windows they go by their numbers
        dealt = rows.select("*", F.explode(window_ids("row", window, done, full - 1)).alias("window_id")).drop("tid").withColumnRenamed("row", "tid")
        _shown(mine_windows(cut(dealt), min_utility)).write.mode("overwrite").parquet(f"{result_path}/batch={number}")
        rows.where(F.col("row") >= full * (window // 2)).write.mode("overwrite").parquet(f"{state_path}/tail/batch={number}")
        spark.createDataFrame([(before + more,)], _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/counts/batch={number}")

    return _started(stream, step, checkpoint, available_now)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("window_id", F.array_sort("itemset").alias("itemset"), F.size("itemset").alias("length"), "utility", "support")


def last_window(spark, state_path: str, batches: int, min_utility: int, window: int) -> DataFrame:
    """The tail that is left when a stream of so many batches has ended, mined as a window of its own."""
    tail, total = _kept_tail(spark, state_path, batches)
    rows = tail.drop("tid").withColumnRenamed("row", "tid").withColumn("window_id", F.lit(full_windows(total, max(2, window))).cast("long"))
    return _shown(mine_windows(cut(rows), min_utility))


def mine_stream(stream: DataFrame, algorithm: str, min_utility: int, state: str, result: str, checkpoint: str, window: int = 1000, available_now: bool = False) -> StreamingQuery:
    """The strategies that are defined on streams: ``incfhm`` keeps the result of all rows so far up to date, ``shuim`` mines sliding windows."""
    if algorithm == "incfhm":
        return incremental(stream, state, result, min_utility, checkpoint, available_now)
    if algorithm == "shuim":
        return count_windows(stream, state, result, min_utility, window, checkpoint, available_now)
    raise ValueError(f"{algorithm} needs all transactions at once; on streams there are incfhm and shuim")


def current(spark, result_path: str) -> DataFrame:
    """The newest report of each itemset."""
    rows = spark.read.parquet(result_path)
    newest = F.max_by(F.struct("length", "utility", "support"), "batch").alias("x")
    return rows.groupBy("itemset").agg(newest).select("itemset", "x.length", "x.utility", "x.support")


def closed_windows(stream: DataFrame, time: str, key: str, item: str, utility: str, window: str, delay: str, sink: Callable[[DataFrame, int], None], checkpoint: str, min_utility: int = 1) -> StreamingQuery:
    """Baskets of (window, key) on event time; all windows that the watermark closes in a batch are mined in one pass."""
    baskets = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), F.col(key).alias("key"), F.col(item).alias("item")).agg(F.sum(utility).alias("utility"))

    def step(batch: DataFrame, number: int) -> None:
        sink(mine_event_windows(batch, min_utility), number)

    return baskets.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).start()


def mine_event_windows(baskets: DataFrame, min_utility: int) -> DataFrame:
    """High-utility itemsets (window_start, itemset, length, utility, support) of rows (w, key, item, utility), for each window by itself."""
    rows = cut(baskets.select(F.unix_micros(F.col("w.start").cast("timestamp_ltz")).alias("window_id"), F.xxhash64("w", "key").alias("tid"), "item", "utility"))
    owner = rows.select("tid", "window_id").distinct()
    found = mine_windows(checked(cut(entries_from(rows).join(owner, "tid"))), min_utility)
    return found.select(F.timestamp_micros("window_id").alias("window_start"), F.array_sort("itemset").alias("itemset"), F.size("itemset").alias("length"), "utility", "support")
