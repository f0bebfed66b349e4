"""Shared helpers of the training-data operators: tables, shared storage, lineage cuts.

Nothing here is kept on a local disk of one machine: what outlives a job goes to the folder
that ``spark.checkpoint.dir`` names, which the driver and every executor can reach.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader (the store need not be a local disk)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only a session on one machine (tests) may leave it unset, and gets a temporary one."""
    where = spark.conf.get(_UNSET, None) or spark.conf.get("utilmine.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_UNSET} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="utilmine-")
        spark.conf.set("utilmine.shared.dir", where)
    return where.rstrip("/") if "://" in where or not where.startswith("/") else "file://" + where.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, not a recomputation, and no copy
    lives on one machine only.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._utilmine_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these tables, once nothing that is still to run reads them."""
    for df in tables:
        remove_path(df.sparkSession, df._utilmine_path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results through the file system that Spark itself uses."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Deal rows out evenly where the cluster's cores would not have even shares of them.

    A split can be empty (a file's only row group lies in one of its splits), so where splits are few their rows are counted, which
    reads no column. Large inputs keep their splits, so nothing is counted or shuffled there. Counting plans ``df``: call it on scans, not above joins.
    """
    least = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 4 * least:
        return df
    if splits >= least:
        rows = [r[0] for r in df.groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]  # fewer than 4 * least numbers
        if max(rows, default=0) * least <= 2 * sum(rows):
            return df
    return df.repartition(least)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, which at its end returns to the system the memory that it has freed.

    Spark keeps Python workers for later tasks. What their allocators hold back meanwhile counts against the executor, beside the JVM of the stages that come next.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return whole


def portions(batches: Iterator[pa.RecordBatch], at: int, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in portions of about ``most_bytes`` in column ``at`` (text), or of one row; a batch can hold very many more, and what is made of texts is larger than they are."""
    for b in batches:
        size = pc.cast(pc.fill_null(pc.binary_length(b.column(at)), 0), pa.int64()).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most_bytes)) + 1).tolist(), b.num_rows]
        yield from (b.slice(x, y - x) for x, y in zip(edges, edges[1:]))


def as_text(column) -> "F.Column":
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Most bytes of a table that is broadcast, as Spark holds it, whatever the corpus size.
BROADCAST_BYTES = 64 << 20


def small_side(df: DataFrame, rows: int, numbers: int = 2) -> DataFrame:
    """Broadcast a side of counted ``rows`` with so many ``numbers`` in each while it is within the bound; beyond it Spark shuffles."""
    return F.broadcast(df) if rows * (24 + 8 * numbers) <= BROADCAST_BYTES else df


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken or f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node in a link.

    Minimum labels travel over the links and then jump to the label of their label, so the number of rounds
    grows with the logarithm of the longest path. Each round is a written table; only the
    number of changed labels comes to the driver.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    held = label
    while True:
        spread_labels = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        lower = label.join(spread_labels, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("seen", "component")).alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = lower.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("further", "component")).alias("component"))
        step = materialise(step, "labels")
        changed = step.where("old != component").limit(1).count()
        release(held)
        label, held = step.select("node", "component"), step
        if not changed:
            release(both)
            label._utilmine_path = held._utilmine_path
            return label


def with_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """((key, id, text), whether keys are unique): ``key`` orders documents and is the id itself where ids are distinct and not null.

    Otherwise documents are numbered in the order of (id, digest of the text), nulls first; rows that agree
    in both share a key.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), as_text(text_col).alias("text"))
    per_id = rows.groupBy("id").count()
    if not per_id.where("id IS NULL OR count > 1").limit(1).count():
        return rows.select(F.col("id").alias("key"), "id", "text"), True
    digest = F.md5("text")
    order = materialise(rows.select("id", digest.alias("digest")).distinct().sort("id", "digest").withColumn("key", F.monotonically_increasing_id()), "order")
    return _number(rows, order), False


def _number(rows: DataFrame, order: DataFrame) -> DataFrame:
    named = order.select(F.col("id").alias("order_id"), F.col("digest").alias("order_digest"), "key")
    same = F.col("id").eqNullSafe(F.col("order_id")) & (F.md5("text") == F.col("order_digest"))
    return rows.join(named, same).select("key", "id", "text")
