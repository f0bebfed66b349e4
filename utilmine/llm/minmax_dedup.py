"""MinHash near-duplicates with min-max hashing.

A document is its set of word shingles. Every permutation (a multiplication and an addition modulo 2**64 of hashes that are already mixed) gives two values of
a signature: the least and the greatest image of the set. Either is equal in two sets with a probability of their
similarity J, so the share of equal values is an unbiased estimate of J; as one element is rarely both, the two agree or differ less together than two
independent ones would, and the variance is below that of as many permutations' minima. Half the permutations do for the same length.

Values are banded: a band is ``rows`` values of different permutations, all minima or all maxima, and two sets that agree in a whole band share a bucket.
With 36 bands of 5 values (90 permutations) a link at exactly 0.85 is missed with a probability of (1 - 0.85**5)**36, below 1e-9, and links above it less often.
Equal sets are brought together by a digest before, not by chance, so sets of up to six elements, which 0.85 links only if they are equal, are never missed.

Shared buckets give links as in the Jaccard join: a set is compared with the most popular of its buckets' centres, then within buckets only across
components; sizes and parity bits rule pairs out, and what is left is confirmed on the full sets. So copies cost nothing, near copies cost a comparison each,
and no bucket is cut off.

Defined results: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts with fewer words than a shingle have the whole
sequence as their only element; rows that share an id are linked with each other, whatever their texts; rows with a null id are
returned with a null component and are kept; rows repeated in full are returned each; other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.llm.common import materialise, spread
from utilmine.llm.partenum import PARITIES, PARITY_WORDS, copies_of, jaccard_components, link_buckets, mix, parities, shared_buckets, shingles, with_components

BANDS, ROWS = 36, 5
_CHUNK = 1024


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends, as columns."""
    r = np.random.default_rng(20250307)
    return r.integers(0, 1 << 63, (count, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, (count, 1), dtype=np.uint64) * np.uint64(2)


def min_max(items: np.ndarray, permutations: int) -> np.ndarray:
    """The least images under each permutation, then the greatest ones; ``items`` is not empty."""
    by, more = _permutations(permutations)
    low = high = None
    for at in range(0, len(items), _CHUNK):
        image = by * items[at : at + _CHUNK]
        image += more
        a, b = image.min(axis=1), image.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate((low, high))


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, from ``bands * rows`` values; a band's number is part of its key."""
    tags = (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    sums = (mix(values.reshape(bands, rows)) * tags).sum(axis=1, dtype=np.uint64)
    return mix(sums + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def permutations_for(bands: int, rows: int) -> int:
    if bands % 2:
        raise ValueError("bands must be even: one half are of minima, the other of maxima")
    return bands * rows // 2


def _describe(k: int, bands: int, rows: int):
    permutations = permutations_for(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), k) for t in b.column(1)]
            key = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            bits = np.stack([parities(s) for s in sets], axis=1) if sets else np.empty((PARITY_WORDS, 0), dtype=np.int64)
            keys = [band_keys(min_max(s, permutations), bands, rows).view(np.int64) if len(s) else np.empty(0, dtype=np.int64) for s in sets]
            edges = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            signed = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)))
            columns = [b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(key, pa.binary()), signed, *(pa.array(x) for x in bits)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "bands", *PARITIES])

    return run


def _find(texts: DataFrame, k: int, num: int, den: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (id, text) whose ids are distinct or null; texts are read once for signatures, and those of candidates again."""
    schema = "id long, n long, key binary, bands array<long>, " + ", ".join(f"{x} long" for x in PARITIES)
    seen = materialise(spread(texts).mapInArrow(_describe(k, bands, rows), schema), "min-max")
    full = seen.where("n > 0 AND id IS NOT NULL")
    copies = copies_of(full)
    first = full.join(copies.select("id"), "id", "left_anti")
    buckets = shared_buckets(first.select("id", F.explode("bands").alias("signature")))
    return with_components(seen.drop("bands"), copies, link_buckets(texts, full, buckets, k, num, den))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; sets link from a similarity of num / den on, and one row of a component is kept."""
    found = jaccard_components(docs, id_col, text_col, k, num, den, find=partial(_find, bands=bands, rows=rows))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
