"""N-gram Jaccard join with PartEnum signatures.

A document is its set of word shingles. Sets are put into size bands, each so narrow that sets of the wanted
similarity lie in the same or in neighbouring bands. Within a band, similarity bounds the Hamming distance
by some k. The feature domain is cut by a hash into first-level partitions, each of them into two
second-level ones; k differences cannot put two into each first-level partition, so in one of them one of the two
second-level partitions agrees. A signature is what a set has in a second-level partition, so similar sets share one.

Partitions in which a projection has few elements, or none, would put dissimilar sets together. So a few partitions more than needed are made, and a set keeps
only the signatures of its largest projections: as many as the differences that it can have from a similar set of the band, and one. No link is lost by that: of the signatures that two
similar sets share, take the one that comes first by size of its projection (and by its value, where sizes are equal). Equal signatures have equal projections, so
both sets have the same order; what comes before it in one of the sets is not in the other, which each difference makes true of one signature at most. So it is among those that either set keeps.

Equal sets are found first and only one of them goes on. A bucket's centre is the member that shares most signatures with others; each set is compared
with the most popular of its centres. The links give components, and only pairs of a bucket that lie in different components by then are compared as well.
Pairs whose sizes or parity bits (a lower bound of the Hamming distance) rule a link out are left out: first by 512 bits inside the join, then by two or more
bits for each element, and only pairs that pass both have their sets brought together; all comparisons are exact set intersections. So copies cost nothing,
near copies cost a comparison each, and no link between components is lost.

Edge cases: null text is empty; texts without words have an empty set, which links with nothing;
texts with fewer words than a shingle have the whole sequence as their only element; rows that share an id are linked with each other, whatever their texts; rows with
a null id are returned with a null component; rows repeated in full are returned each; other columns are ignored, and pass through ``keep_first`` whatever their names.
``keep_first`` keeps all rows of an id that it keeps. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utilmine.llm.common import as_text, components, fresh_name, materialise, portions, release, small_side, spread, trimmed, with_key

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = [np.uint64(int(x) | 1) for x in _random.integers(1, 1 << 63, 64, dtype=np.uint64)]
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _powers[:n], _inverse[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    inside = _IS_WORD[data].astype(np.int8)
    edge = np.diff(inside, prepend=0, append=0)
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    width = min(k, len(word))
    out = np.full(len(word) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out += word[i : len(word) - width + 1 + i] * _MIX[i]
    return np.unique(mix(out))


@lru_cache(maxsize=8)
def bands(num: int, den: int) -> list[int]:
    """Largest set size of each band for the similarity num / den."""
    last, out = 0, []
    while last < 1 << 40:
        last = (last + 1) * den // num
        out.append(last)
    return out


def band_plan(band: int, num: int, den: int) -> int:
    """How many first-level partitions a band has; none: only equal sets."""
    k = 2 * (den - num) * bands(num, den)[band] // (den + num)
    if k == 0:
        return 0
    needed = k // 2 + 1
    return needed + 2 + needed // 4


def most_differences(n: int, band: int, num: int, den: int) -> int:
    """Elements in which a set of ``n`` can differ from a similar one of the band at most."""
    return (den - num) * (n + min(bands(num, den)[band], n * den // num)) // (den + num)


@lru_cache(maxsize=4096)
def _tags(band: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that set the bands apart, as one-element arrays (whose products wrap silently)."""
    number = np.array([band + 1], dtype=np.uint64)
    return number * _MIX[40], number * _MIX[42]


def signatures(items: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set for its own band and the next one."""
    if not len(items):
        return np.empty(0, dtype=np.uint64)
    own = bisect_left(bands(num, den), len(items))
    out = []
    for band in (own, own + 1):
        parts = band_plan(band, num, den)
        tag, salt = _tags(band)
        if not parts:
            out.append(mix(np.add.reduce(mix(items ^ _MIX[41]), keepdims=True) + tag))
            continue
        cell = ((mix(items + salt) >> np.uint64(32)) % np.uint64(2 * parts)).astype(np.int64)
        count = np.bincount(cell, minlength=2 * parts)
        order = np.argsort(cell, kind="stable")
        running = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(items ^ _MIX[43])[order])))
        edge = np.concatenate(([0], np.cumsum(count)))
        where = tag + np.arange(1, 2 * parts + 1, dtype=np.uint64) * _MIX[44]
        made = mix((running[edge[1:]] - running[edge[:-1]]) * _MIX[45] + where)
        out.append(made[np.lexsort((made, -count))[: most_differences(len(items), band, num, den) + 1]])
    return np.concatenate(out)


#: Parity bits of a set: each of its elements flips one of 512 bits.
PARITY_WORDS = 8
PARITIES = [f"p{i}" for i in range(PARITY_WORDS)]


def parities(items: np.ndarray) -> np.ndarray:
    """Two sets that differ in d elements differ in at most d of these bits."""
    odd = np.bincount((items & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_bits(items: np.ndarray) -> bytes:
    """Parity bits of a set, at least two for each element: a power of two of them, so that longer ones fold into shorter ones."""
    size = 512
    while size < 2 * len(items):
        size *= 2
    odd = np.bincount((items & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_distance(a: bytes, b: bytes) -> int:
    """How many elements two sets differ in at least, by their parity bits."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bits(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(parity_bits, sets)), pa.binary())], names=["id", "n", "bits"])

    return run


def _may_link(num: int, den: int):
    """(a, b) of the (a, b, n_a, n_b, bits_a, bits_b) that can be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [den * min(x, y) >= num * max(x, y) and (den + num) * least_distance(p.as_py(), q.as_py()) <= (den - num) * (x + y) for x, y, p, q in zip(n, m, b.column(4), b.column(5))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bits = np.stack([parities(s) for s in sets], axis=1) if sets else np.empty((PARITY_WORDS, 0), dtype=np.int64)
            columns = [b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(key, pa.binary()), *(pa.array(x) for x in bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", *PARITIES])

    return run


def _sign(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            held, ids, size = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = signatures(shingles(t.as_py(), k), num, den)
                held.append(s), ids.append(np.full(len(s), i, dtype=np.int64))
                size += len(s)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(ids))], names=["signature", "id"])
                    held, ids, size = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(np.concatenate(ids))], names=["signature", "id"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), k).tobytes() for t in b.column(1)], pa.binary())], names=["id", "items"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            last, one = None, None
            for x, y in zip(b.column(2), b.column(3)):
                two = np.frombuffer(y.as_buffer(), dtype=np.uint64)
                one = np.frombuffer(x.as_buffer(), dtype=np.uint64)
                small, large = (one, two) if len(one) <= len(two) else (two, one)
                if den * len(small) < num * len(large):
                    linked.append(False)
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                linked.append(den * common >= num * (len(one) + len(two) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100, find: Callable | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; sets link from a similarity of num / den on.

    ``find`` gives these of (id, text) whose ids are distinct or null; by default with PartEnum signatures.
    """
    find = find or _components
    texts = docs.select(F.col(id_col).cast("long").alias("id"), as_text(text_col).alias("text"))
    named = texts.where("id IS NOT NULL")
    if not named.groupBy("id").count().where("count > 1").limit(1).count():
        return find(texts, k, num, den)
    # rows of one id are linked: components of rows are joined to components of ids
    rows, _ = with_key(named, "id", "text")
    found = materialise(find(rows.select(F.col("key").alias("id"), "text"), k, num, den), "row-components")
    owner = rows.select("key", "id").distinct()
    owned = found.withColumnRenamed("doc_id", "key").join(owner, "key").join(owner.select(F.col("key").alias("component_id"), F.col("id").alias("b")), "component_id")
    owned = materialise(owned.select("id", "n_shingles", "b"), "owned")
    release(found)
    label = components(owned.select(F.col("id").alias("a"), "b"))
    out = owned.join(label.withColumnRenamed("node", "id"), "id", "left").select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.unionByName(find(texts.where("id IS NULL"), k, num, den))


def copies_of(full: DataFrame) -> DataFrame:
    """(id, first): rows of ``full`` (id, key) whose set is that of a row with a smaller id."""
    first = full.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("key", "first")
    return materialise(full.join(first, "key").where("id != first").select("id", "first"), "copies")


def shared_buckets(signed: DataFrame) -> DataFrame:
    """(signature, id, size) of the signatures that more than one row has."""
    return materialise(signed.withColumn("size", F.count("*").over(Window.partitionBy("signature"))).where("size > 1"), "buckets")


def _components(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``jaccard_components`` of (id, text) whose ids are distinct or null."""
    seen = materialise(spread(texts).mapInArrow(trimmed(_describe(k)), "id long, n long, key binary, " + ", ".join(f"{x} long" for x in PARITIES)), "sets")
    full = seen.where("n > 0 AND id IS NOT NULL")
    copies = copies_of(full)
    # texts of one row of each set only; most rows stay, so what is taken away is the small side
    own = spread(texts).where("id IS NOT NULL").join(small_side(copies.select("id"), copies.count()), "id", "left_anti")
    buckets = shared_buckets(own.mapInArrow(trimmed(_sign(k, num, den)), "signature long, id long"))
    return with_components(seen, copies, link_buckets(texts, full, buckets, k, num, den))


def link_buckets(texts: DataFrame, full: DataFrame, buckets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, component) over the links between rows that share a bucket, confirmed on their full sets; ``buckets`` (a materialised table) is deleted.

    ``full`` (id, n, parities) describes the rows, ``texts`` (id, text) gives their sets.
    """
    scratch: list[DataFrame] = []
    shared = buckets.dropDuplicates(["signature", "id"])
    popular = shared.groupBy("id").agg(F.sum("size").alias("popular"))
    ranked = shared.select("signature", "id").join(popular, "id")
    best = ranked.groupBy("signature").agg(F.min(F.struct((-F.col("popular")).alias("p"), F.col("id").alias("centre"))).alias("best"))
    star = ranked.join(best, "signature").where("id != best.centre").groupBy("id").agg(F.min("best").alias("best"))
    star = star.select(F.least("id", "best.centre").alias("a"), F.greatest("id", "best.centre").alias("b"))
    # sizes and parity bits of the documents in buckets; ids with several rows have none, so they are always compared
    profile = full.join(popular.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("rows"), F.min("n").alias("n"), *(F.min(x).alias(x) for x in PARITIES))
    profile = materialise(profile.where("rows = 1").drop("rows"), "profiles")

    def side(x: str) -> DataFrame:
        return profile.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", *PARITIES)))

    differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in PARITIES), F.lit(0))
    sizes = F.col("n_a") + F.col("n_b")
    can_link = (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")) & ((den + num) * differ <= (den - num) * sizes)
    can_link = F.coalesce(can_link, F.lit(True))
    star = star.select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left").where(can_link)
    star = materialise(star.select("a", "b"), "pairs")

    def sides(pairs: DataFrame, kind, schema: str, columns: list[str]) -> DataFrame:
        """``pairs`` with ``columns`` of both documents, as ``kind`` makes them from their texts."""
        named = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
        made = materialise(texts.join(small_side(named, named.count()), "id", "left_semi").mapInArrow(trimmed(kind(k)), schema), "sides")
        scratch.extend((named, made))
        for x in "ba":
            pairs = pairs.join(made.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)
        return pairs.select("a", "b", *(f"{c}_{x}" for c in columns for x in "ab"))

    def compare(pairs: DataFrame) -> DataFrame:
        """(a, b, linked) of all pairs; sets are fetched for those that long parity bits leave open."""
        likely = materialise(sides(pairs, _bits, "id long, n long, bits binary", ["n", "bits"]).mapInArrow(_may_link(num, den), "a long, b long").distinct(), "likely")
        linked = materialise(sides(likely, _sets, "id long, items binary", ["items"]).mapInArrow(_verify(num, den), "a long, b long, linked boolean"), "compared")
        scratch.append(likely)
        return linked

    compared = compare(star)
    label = components(compared.where("linked"))
    labelled = shared.select("signature", "id").join(label.withColumnRenamed("node", "id"), "id", "left").select("signature", "id", F.coalesce("component", "id").alias("component"))
    split = labelled.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("signature")
    open_ = materialise(labelled.join(split, "signature"), "open")
    left, right = (open_.select("signature", F.col("id").alias(x), F.col("component").alias(f"c{x}")).join(side(x), x, "left") for x in "ab")
    across = left.join(right, (left["signature"] == right["signature"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & can_link)
    across = across.select("a", "b").distinct()
    rest = materialise(across.join(star, ["a", "b"], "left_anti"), "pairs")
    if rest.limit(1).count():
        more = compare(rest)
        found = more.where("linked")
        if found.limit(1).count():
            first, label = label, components(compared.where("linked").select("a", "b").unionByName(found.select("a", "b")))
            scratch.append(first)
        scratch.append(more)
    release(*scratch, buckets, profile, star, compared, open_, rest)
    return label


def with_components(seen: DataFrame, copies: DataFrame, label: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of ``seen`` (id, n): copies are where the first row of their set is."""
    placed = copies.groupBy("id").agg(F.min("first").alias("first"))
    out = seen.select("id", "n").join(small_side(placed, copies.count()), "id", "left").withColumn("node", F.coalesce("first", "id"))
    return out.join(label, "node", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "node")).alias("component_id")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id. Rows without an id stay."""
    found = jaccard_components(docs, id_col, text_col, k, num, den)
    gone_id = fresh_name(docs, "gone_id")
    gone = materialise(found.where("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), F.col(id_col) == F.col(gone_id), "left_anti")
