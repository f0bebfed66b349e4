"""The utility text format (``items:TU:utilities`` a line) and result files (``items #UTIL: utility``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.functions import itemset_text
from utilmine.model import MAX_ITEM

# Fixed values of the two formats.
COMMENT_MARKS = ("#", "@", "%")
RESULT_MARK = " #UTIL: "


def parse_lines(lines: DataFrame, mode: str = "DROPMALFORMED", keep: tuple[str, ...] = ()) -> DataFrame:
    """(tid, tu, items, columns to ``keep``) of a ``value`` column of lines; comments and blank lines get no tid.

    ``tid`` follows the order of the lines. Malformed lines (wrong numbers, unequal counts, ids out of range) are dropped,
    or raise an error with ``mode='FAILFAST'``. Duplicate items are summed in the place of the first.
    """
    text = F.trim("value")
    kept = lines.where((text != "") & ~F.substring("value", 1, 1).isin(*COMMENT_MARKS))
    # ids rise in the order of the lines without a global sort, and are then made dense by offsets of the partitions
    marked = kept.withColumn("at", F.monotonically_increasing_id())
    parts = F.split("value", ":")

    def numbers(part) -> "F.Column":
        words = F.filter(F.split(F.trim(part), r"[ \t]+"), lambda x: x != "")
        return F.transform(words, lambda x: x.try_cast("bigint"))

    fields = marked.select("at", *keep, F.size(parts).alias("fields"), numbers(F.get(parts, F.lit(0))).alias("ids"), F.trim(F.get(parts, F.lit(1))).try_cast("bigint").alias("tu"), numbers(F.get(parts, F.lit(2))).alias("us"))
    good = (F.col("fields") == 3) & F.col("tu").isNotNull() & (F.size("ids") == F.size("us")) & F.forall("ids", lambda x: x.isNotNull() & (x >= 0) & (x <= MAX_ITEM)) & F.forall("us", lambda x: x.isNotNull())
    good = F.coalesce(good, F.lit(False))
    if mode == "FAILFAST":
        rows = fields.where(F.when(good, True).otherwise(F.raise_error(F.lit("malformed transaction line"))).cast("boolean"))
    elif mode == "DROPMALFORMED":
        rows = fields.where(good)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    distinct = F.array_distinct("ids")
    pairs = F.arrays_zip("ids", "us")
    items = F.transform(distinct, lambda d: F.struct(d.alias("item"), F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + F.when(x["ids"] == d, x["us"]).otherwise(0)).alias("utility")))
    return rows.select(F.col("at").alias("tid"), "tu", items.alias("items"), *keep)


def dense_tids(transactions: DataFrame) -> DataFrame:
    """Replace ``tid`` by 0, 1, 2 ... in the same order."""
    part = F.shiftright("tid", 33)
    offsets, total = {}, 0
    for p, n in sorted((r[0], r[1]) for r in transactions.groupBy(part.alias("p")).agg((F.max(F.col("tid").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))) + 1).alias("n")).collect()):
        offsets[p] = total
        total += n
    first = F.lit(0).cast("long")
    if offsets:
        table = [offsets.get(p, 0) for p in range(max(offsets) + 1)]
        first = F.get(F.lit(table).cast("array<bigint>"), part.cast("int"))
    return transactions.withColumn("tid", first + F.col("tid").bitwiseAND(F.lit((1 << 33) - 1).cast("long")))


def read_utility_text(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    return dense_tids(parse_lines(spark.read.text(path), mode))


def stream_utility_text(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines (value, file) of the files that come into a folder; ``batch_transactions`` numbers them."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else spark.readStream
    return reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def batch_transactions(lines: DataFrame, mode: str = "DROPMALFORMED") -> DataFrame:
    """Transactions of a batch of (value, file), numbered from 0 by file name and line: the same numbers whenever the batch is read, however its files are split."""
    parsed = parse_lines(lines, mode, keep=("file",))
    return dense_tids(parsed.sort("file", "tid").withColumn("tid", F.monotonically_increasing_id()).drop("file"))


def write_results(result: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line per itemset; ``mode='append'`` adds to earlier results."""
    line = F.concat(itemset_text("itemset"), F.lit(RESULT_MARK), F.col("utility").cast("string"))
    result.select(line.alias("value")).write.mode(mode).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(F.col("value").contains(RESULT_MARK.strip()))
    items = F.split(F.trim(F.regexp_extract("value", r"^([0-9 ]*)#UTIL:", 1)), " +")
    return lines.select(F.array_sort(items.cast("array<bigint>")).alias("itemset"), F.trim(F.regexp_extract("value", r"#UTIL:\s*(-?\d+)", 1)).cast("bigint").alias("utility"))


def diff(reference: DataFrame, result: DataFrame) -> DataFrame:
    """(itemset, status, expected, found) of itemsets that are missing, extra or have another utility."""
    a = reference.select("itemset", F.col("utility").alias("expected"))
    b = result.select("itemset", F.col("utility").alias("found"))
    both = a.join(b, "itemset", "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("found"), "utility")
    return both.withColumn("status", status).where("status IS NOT NULL").select("itemset", "status", "expected", "found")
