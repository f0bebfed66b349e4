"""Document fingerprints by winnowing, in DataFrame operations only.

The hashes of all k-word grams roll over a text; of each window of ``window`` consecutive grams the smallest hash is
selected, the rightmost of equal ones, together with its position. So two texts that share ``k + window - 1``
consecutive words share a selected hash, and positions tell where. Grams and windows cover whole texts.

Rolling hashes are cyclic polynomials (each word's hash rotated by its distance from the end of the gram, all combined by exclusive or). Those of twice
as many words, or of one word more, follow from two shorter ones, so no gram is hashed from its words anew. Sliding minima come from doubling as well.

A selected gram is one number: 32 bits of its hash above 31 bits that fall as the position rises, so the smallest
number of a window is the smallest hash at its rightmost position. An array cannot hold more words than 31 bits can number.

Words are what stands between white space; characters of scripts that are written without spaces are words of their own.

Edge cases: null text is empty, with an empty fingerprint; texts with fewer than k words have the whole sequence as their
only gram; texts with fewer grams than a window are one window. The likeness of two empty fingerprints is 1, of an empty and
another one 0. The next document follows in the order of (id, digest of the text), nulls first, and the last is
followed by the first; a single document follows itself. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utilmine.llm.common import as_text

POSITION_BITS = 31
HASH_BITS = 32

#: Scripts without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han and its extensions.
SPACELESS = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"


def selected_grams(text: Column, k: int = 5, window: int = 8) -> Column:
    """Array of the selected (hash, position) numbers of a text, in order of position."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spaced = F.when(text.rlike(SPACELESS), F.regexp_replace(text, f"({SPACELESS})", " $1 ")).otherwise(text)
    words = F.array_remove(F.split(spaced, r"\s+"), "")
    hashes = F.transform(words, lambda x: F.xxhash64(x))
    low = F.lit((1 << HASH_BITS) - 1).cast("long")
    last = F.lit((1 << POSITION_BITS) - 1).cast("long")

    def grams(h: Column) -> Column:
        # texts with fewer words than a gram have one gram of all their words
        whole = F.aggregate(h, F.lit(0).cast("long"), lambda r, x: _rotated(r, 1).bitwiseXOR(x))
        rolled = F.when(F.size(h) >= k, rolling(h, k)).when(F.size(h) > 0, F.array(whole)).otherwise(h)
        return F.transform(rolled, lambda r, i: F.shiftleft(F.xxhash64(r).bitwiseAND(low), POSITION_BITS).bitwiseOR(last - i))

    def minima(numbers: Column) -> Column:
        out, step = numbers, 1
        while step < window:
            out = _let(out, _least_with(step))
            step *= 2
        return F.array_distinct(F.slice(out, 1, F.greatest(F.size(numbers) - (window - 1), F.lit(1))))

    return _let(_let(hashes, grams), minima)


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by % 64 else x


def rolling(hashes: Column, k: int) -> Column:
    """The rolling hash of each run of k numbers: of 2 j numbers from two runs of j, of j + 1 from a run of j and the number after it."""

    def joined(run: int, more: int):
        """Runs of ``run`` numbers (array ``a``) with those of ``more`` numbers that follow them (array ``b``)."""

        def of(both: Column) -> Column:
            size = F.greatest(F.size(both["b"]) - run, F.lit(0))
            return F.zip_with(F.slice(both["a"], 1, size), F.slice(both["b"], run + 1, size), lambda x, y: _rotated(x, more).bitwiseXOR(y))

        return of

    out, length = hashes, 1
    for bit in f"{k:b}"[1:]:
        out = _let(F.struct(out.alias("a"), out.alias("b")), joined(length, length))
        length *= 2
        if bit == "1":
            out = _let(F.struct(out.alias("a"), hashes.alias("b")), joined(length, 1))
            length += 1
    return out


def _least_with(step: int):
    """Each number or the one ``step`` places on, whichever is smaller; past the end there is none."""
    return lambda x: F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x), F.lit(1))), lambda a, b: F.least(a, b))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_set(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, POSITION_BITS)))


def as_string(selected: Column) -> Column:
    """hash:position pairs in hexadecimal, in order of position."""
    last = F.lit((1 << POSITION_BITS) - 1).cast("long")
    return F.array_join(F.transform(selected, lambda x: F.concat(F.hex(F.shiftright(x, POSITION_BITS)), F.lit(":"), F.hex(last - x.bitwiseAND(last)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the selected hashes of two fingerprints."""

    def of(sets: Column) -> Column:
        x, y = sets["x"], sets["y"]
        common = F.size(F.array_intersect(x, y))
        union = F.size(x) + F.size(y) - common
        return F.when(union == 0, F.lit(1.0)).otherwise(common.cast("double") / F.greatest(union, F.lit(1)))

    return _let(F.struct(hash_set(a).alias("x"), hash_set(b).alias("y")), of)


def with_next(rows: DataFrame, carried: list[str], rows_per_bucket: int = 1_500, max_buckets: int = 50_000) -> DataFrame:
    """Add ``next_<c>`` for each carried column: its value in the next row by (key, tie), cyclically.

    Keys are cut into ranges at keys that occur. The first rows of a range go to the range before as well, so
    each range knows what follows it, and no range depends on another. One shuffle moves each row once.
    """
    total = rows.count()
    if not total:
        return rows.withColumns({f"next_{c}": F.col(c) for c in carried})
    buckets = max(1, min(max_buckets, total // rows_per_bucket))
    shares = [i / buckets for i in range(buckets)]
    cuts = rows.agg(F.min("key").alias("low"), F.percentile_approx("key", shares, 20 * buckets).alias("cuts")).first()
    bounds = sorted({cuts["low"], *cuts["cuts"]})
    width = max(1, int(len(bounds) ** 0.5))
    fine, coarse = F.lit(bounds).cast("array<bigint>"), F.lit(bounds[::width]).cast("array<bigint>")
    block = F.size(F.filter(coarse, lambda x: x <= F.col("key"))) - 1
    bucket = block * width + F.size(F.filter(F.slice(fine, block * width + 1, F.lit(width)), lambda x: x <= F.col("key")))
    heads = F.array_contains(F.slice(fine, F.col("bucket"), F.lit(1)), F.col("key"))
    placed = rows.withColumn("bucket", bucket)
    before = F.when(F.col("bucket") == 1, F.lit(len(bounds))).otherwise(F.col("bucket") - 1)
    targets = F.when(heads, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy")), F.struct(before.alias("bucket"), F.lit(1).alias("copy")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))))
    dealt = placed.withColumn("target", F.explode(targets)).drop("bucket").select("*", "target.bucket", "target.copy").drop("target")
    order = Window.partitionBy("bucket").orderBy("copy", "key", "tie")
    following = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return following.where("copy = 0").drop("bucket", "copy")


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, window: int = 8) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"), as_text(text_col).alias("text"))
    rows = rows.withColumns({"tie": F.md5("text"), "selected": selected_grams(F.col("text"), k, window)})
    both = with_next(rows, ["text", "selected"])
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = both.withColumns({"n_chars": size.cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))})
    edited = edited.withColumn("edited_selected", selected_grams(F.col("edited"), k, window))
    return edited.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("selected")).alias("fingerprint"),
        as_string(F.col("edited_selected")).alias("edited_fingerprint"),
        likeness(F.col("selected"), F.col("edited_selected")).alias("near_edited"),
        likeness(F.col("selected"), F.col("next_selected")).alias("near_next"),
    )
