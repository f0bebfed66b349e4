"""URL filter with dated lists: every capture is judged by the entries in force when it was fetched.

Dated entries of a list (a domain is added or removed from a day on) become validity intervals: an entry holds until the
next one of the same domain. A capture is matched with its host and all parent domains of it; of the entries
in force at fetch time the one of the longest domain decides.

The as-of join is an equi-join on (domain, time slice): intervals are dealt to the slices they overlap and
captures to their own, so a domain with a long history or very many captures spreads over slices, and a capture
meets only the few intervals of its slice. Spark splits slices that are still skewed. Nothing is collected.

Edge cases: a null or malformed url has a null host and matches nothing; a null fetch time matches nothing; of entries
of one domain and day the action that sorts first decides ("add" before "remove"); a capture before
the first entry of a domain is not matched by it; rows repeated in full are judged once per row. Empty lists leave every capture unlisted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilmine.llm.common import materialise, small_side


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute url, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(host != "", host)


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first, down to two labels."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, day, until): each entry (domain, day, action) with the day of the next one, null if none."""
    one = entries.where("domain IS NOT NULL AND day IS NOT NULL").groupBy("domain", "day").agg(F.min("action").alias("action"))
    return one.withColumn("until", F.lead("day").over(Window.partitionBy("domain").orderBy("day")))


def as_of(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", slice_days: int = 32) -> DataFrame:
    """(row id, host, day, listed, domain, entry_day) for every capture."""
    rows = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("long").alias("fetched"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "captures")  # row numbers that a retry cannot change
    span = rows.agg(F.min("fetched").alias("low"), F.max("fetched").alias("high")).first()
    low, high = span["low"] or 0, span["high"] or 0
    held = intervals(entries).where((F.col("day") <= high) & (F.coalesce(F.col("until"), F.lit(high + 1)) > low))
    first, last = F.greatest(F.col("day"), F.lit(low)), F.least(F.coalesce(F.col("until") - 1, F.lit(high)), F.lit(high))
    sliced = held.withColumn("slice", F.explode(F.sequence(F.floor(first / slice_days), F.floor(last / slice_days))))
    asked = rows.where("host IS NOT NULL AND fetched IS NOT NULL").select("id", "row", "fetched", F.floor(F.col("fetched") / slice_days).alias("slice"), F.posexplode(domains_of(F.col("host"))).alias("depth", "domain"))
    match = asked.join(small_side(sliced, sliced.count()), ["domain", "slice"]).where((F.col("day") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = match.groupBy("row").agg(F.min(F.struct("depth", "domain", "action", "day")).alias("best"))
    return rows.join(best, "row", "left").select(
        F.col("id").alias(id_col), "host", F.col("fetched").alias("fetch_day"), F.coalesce(F.col("best.action") == "add", F.lit(False)).alias("listed"), F.col("best.domain").alias("entry_domain"), F.col("best.day").alias("entry_day")
    )
