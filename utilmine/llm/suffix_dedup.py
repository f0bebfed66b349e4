"""Exact substring deduplication with per-shard suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts earlier in the corpus (smaller document,
or an earlier place of the same one). Strings never cross documents and are judged on the input.

1. Equal texts: all but the first go entirely; only the first goes on.
2. Every string of ``length`` bytes has one anchor, the smallest k-gram hash in it (leftmost of equal ones), so equal
   strings have equal anchors at equal places. Consecutive strings with the same anchor form a run. Only runs whose
   anchor occurs at least twice can repeat; only their bytes are shuffled, by anchor.
3. A shard is a bounded stretch of runs, ordered by anchor and place. Its suffixes are sorted by Larsson-Sadakane
   refinement: ranks by the first 8 bytes, then by pairs of ranks 8, 16, 32 ... bytes apart, only within groups that are
   not settled. Common prefixes of neighbours follow by Kasai's rule, for all runs in step.
   Neighbours with ``length`` common bytes are repeats; the first place of each group stays.
4. An anchor with more runs than a shard holds spans shards. They come in order of place, so a string of a later shard repeats
   if it is among the sorted strings of the earlier ones, which binary search tells; new ones are merged in.

Hot content: runs that are equal byte for byte within a task are settled there, before the shuffle. Anchors with more
than ``hot`` runs are split by wider context (66 bytes of the string to the left or right of the anchor), which any two equal strings share.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing; with repeated or null ids documents are ordered by
(id, digest of the text), rows that agree in both are one document and keep what that document keeps; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utilmine.llm.common import materialise, small_side, spread, with_key
from utilmine.llm.partenum import _BYTE, _power_tables, mix

GRAM = 32


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """64-bit hashes of all k-byte strings of ``data``."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: len(data) - k + 1])


def anchors(data: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, anchor place, first start, last start) of each run of a text of at least ``length`` bytes."""
    hashed = gram_hashes(data)
    width = length - GRAM + 1
    at = np.arange(len(hashed), dtype=np.int32)
    step = 1
    while 2 * step <= width:
        left, right = at[:-step], at[step:]
        at = np.where(hashed[left] <= hashed[right], left, right)
        step *= 2
    if width > step:
        left, right = at[: len(at) - (width - step)], at[width - step :]
        at = np.where(hashed[left] <= hashed[right], left, right)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    return hashed[place].view(np.int64), place.astype(np.int64), first, last


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all places of ``text`` by their next ``depth`` bytes (a power of two, 8 at least).

    Larsson-Sadakane refinement: places that share their rank with no other are settled and never sorted again.
    Places near the end are compared as if zero bytes followed.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8)))
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(word)  # the order of equal ones does not matter, here and below
    rank = np.empty(n, dtype=np.int64)
    word = word[order]
    new = np.concatenate(([True], word[1:] != word[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = head
    single = new & np.append(new[1:], True)
    active = order[~single]
    have = 8
    while have < depth and len(active):
        ahead = np.minimum(active + have, n - 1)
        second = np.where(active + have < n, rank[ahead] + 1, 0)
        key = (rank[active] << 32) | second
        by_key = np.argsort(key)
        active, key = active[by_key], key[by_key]
        group = key >> 32
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.concatenate(([True], group[1:] != group[:-1]))
        place = np.arange(len(active))
        rank[active] = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(start, place, 0))
        active = active[~(new & np.append(new[1:], True))]
        have *= 2
    return rank


def common_prefixes(text: np.ndarray, order: np.ndarray, offset: np.ndarray, count: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix, ``limit`` at most, of each sorted suffix with the one before it (Kasai's rule).

    ``order`` holds the places of all runs' first ``count`` suffixes in sorted order; runs start at ``offset``. All runs advance in step: going one place on, the
    common prefix shrinks by one at most, as long as the neighbour's next place was sorted as well.
    """
    n = len(text)
    previous = np.full(n + 1, -1, dtype=np.int64)
    previous[order[1:]] = order[:-1]
    sorted_at = np.full(n + 1, -1, dtype=np.int64)
    sorted_at[order] = np.arange(len(order))
    padded = np.concatenate((text, np.zeros(limit + 16, dtype=np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    found = np.zeros(n, dtype=np.int16)
    lanes = np.arange(len(offset))
    carried = np.zeros(len(offset), dtype=np.int64)
    for step in range(int(count.max(initial=0))):
        lanes = lanes[count[lanes] > step]
        here = offset[lanes] + step
        there = previous[here]
        got = np.where(there >= 0, carried[lanes], 0)
        for width in (8, 1):
            open_ = np.flatnonzero((there >= 0) & (got + width <= limit))
            while len(open_):
                x, y = here[open_] + got[open_], there[open_] + got[open_]
                same = (words[x] == words[y]).all(axis=1) if width > 1 else padded[x] == padded[y]
                open_ = open_[same]
                got[open_] += width
                open_ = open_[got[open_] + width <= limit]
        found[here] = got
        # the rule needs the neighbour's next place to be sorted before this one's; beyond the limit it may not be
        ahead = np.where(there >= 0, sorted_at[np.maximum(there, 0) + 1], -1)
        carried[lanes] = np.where((ahead >= 0) & (ahead < sorted_at[here + 1]), np.maximum(got - 1, 0), 0)
    return found[order]


class Merger:
    """Sorted distinct strings of one anchor over the shards so far."""

    def __init__(self, length: int):
        self.length, self.anchor = length, None
        self.strings = np.empty(0, dtype=f"S{length}")

    def known(self, strings: np.ndarray) -> np.ndarray:
        if not len(self.strings):
            return np.zeros(len(strings), dtype=bool)
        at = np.minimum(np.searchsorted(self.strings, strings), len(self.strings) - 1)
        return self.strings[at] == strings

    def merge(self, strings: np.ndarray) -> None:
        self.strings = np.insert(self.strings, np.searchsorted(self.strings, strings), strings)


def _strings(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[places]).view(f"S{length}").ravel()


def repeats(anchor: np.ndarray, runs: list[bytes], length: int, merger: Merger, goes_on) -> list[np.ndarray]:
    """For each run, in order of (anchor, place), which of its starts repeat an earlier string."""
    size = np.array([len(r) for r in runs], dtype=np.int64)
    offset = np.concatenate(([0], np.cumsum(size)[:-1]))
    count = size - length + 1
    text = np.frombuffer(b"".join(runs), dtype=np.uint8)
    depth = 8
    while 2 * depth <= length:
        depth *= 2
    rank = suffix_ranks(text, depth)
    run = np.repeat(np.arange(len(runs)), count)
    starts = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + offset[run]
    key = (rank[starts] << 32) | rank[starts + length - depth]
    order = starts[np.argsort(key, kind="stable")]
    common = common_prefixes(text, order, offset, count, length)
    repeated = np.zeros(len(text), dtype=bool)
    repeated[order[common >= length]] = True
    if merger.anchor is not None and anchor[0] == merger.anchor:
        mine = order[(common < length) & (anchor[np.searchsorted(offset, order, side="right") - 1] == merger.anchor)]
        strings = _strings(text, mine, length)
        seen = merger.known(strings)
        if seen.any():
            # a string known from an earlier shard: its first place here goes as well
            repeated[mine[seen]] = True
        fresh = strings[~seen]
    else:
        merger.strings, fresh = merger.strings[:0], None
    if goes_on == anchor[-1]:
        if fresh is None or anchor[0] != goes_on:
            merger.strings = merger.strings[:0]
            mine = order[(common < length) & (anchor[np.searchsorted(offset, order, side="right") - 1] == goes_on)]
            fresh = _strings(text, mine, length)
        merger.merge(fresh)
        merger.anchor = goes_on
    else:
        merger.anchor = None
        merger.strings = merger.strings[:0]
    return [repeated[o : o + c] for o, c in zip(offset.tolist(), count.tolist())]


def spans_of(flags: np.ndarray, base: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges [from, to) covered by the strings that start where ``flags`` is set."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [(base + a, base + b - 1 + length) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


_FOUND = "anchor long, key long, start long, stop long, run binary"


def _find_anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for key, t in zip(b.column(0).to_pylist(), b.column(1)):
                data = np.frombuffer(t.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                h, place, first, last = anchors(data, length)
                held.append((h, np.full(len(h), key, dtype=np.int64), (first << 16) | ((place - first) << 8) | (last - first)))
                size += len(h)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["anchor", "key", "packed"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["anchor", "key", "packed"])

    return run


def _cut_runs(length: int, remember: int = 200_000):
    """Bytes of repeated runs; equal runs within the task are settled at once (rows without an anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_of: dict[bytes, tuple[int, int]] = {}
        names = ["anchor", "key", "start", "stop", "run"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=names)

        rows, held = [], 0
        for b in batches:
            for key, t, runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = t.as_py().encode("utf-8", "surrogatepass")
                values = runs.values
                packed = values.field("packed").to_numpy(zero_copy_only=False)
                hashes, hot = values.field("anchor").to_pylist(), values.field("hot").to_pylist()
                for i in np.argsort(packed, kind="stable").tolist():
                    p, h = int(packed[i]), hashes[i]
                    start, back, more = p >> 16, (p >> 8) & 0xFF, p & 0xFF
                    parts = [(h, start, start + more)]
                    if hot[i]:
                        # strings that begin at least 34 bytes before the anchor, and the others
                        middle = min(start + more, start + back - 34)
                        parts = []
                        if middle >= start:
                            parts.append((_context(data, start + back - 34, h, 1), start, middle))
                        if middle < start + more:
                            low = max(start, middle + 1)
                            parts.append((_context(data, start + back, h, 2), low, start + more))
                    for anchor, low, high in parts:
                        piece = data[low : high + length]
                        mark = hashlib.blake2b(piece, digest_size=16).digest()
                        seen = first_of.get(mark)
                        if seen is not None and seen < (key, low):
                            rows.append((None, key, low, high + length, None))
                        else:
                            if seen is None and len(first_of) >= remember:
                                first_of.clear()
                            first_of[mark] = (key, low)
                            rows.append((anchor, key, low, None, piece))
                            held += len(piece)
                if held > 4 << 20 or len(rows) > 100_000:
                    yield batch(rows)
                    rows, held = [], 0
        yield batch(rows)

    return run


def _context(data: bytes, at: int, anchor: int, side: int) -> int:
    digest = hashlib.blake2b(data[at : at + GRAM + 34], digest_size=8, key=bytes([side])).digest()
    return int.from_bytes(digest, "little", signed=True)


def _sort_shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, key, start, runs, held = [], [], [], [], 0
        merger = Merger(length)

        def settle(goes_on):
            nonlocal held
            out = []
            for k, s, flags in zip(key, start, repeats(np.array(anchor, dtype=np.int64), runs, length, merger, goes_on)):
                if flags.any():
                    out += [(k, a, b) for a, b in spans_of(flags, s, length)]
            for x in (anchor, key, start, runs):
                x.clear()
            held = 0
            columns = list(zip(*out)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "stop"])

        for b in batches:
            for a, k, s, r in zip(*(b.column(i).to_pylist() for i in range(4))):
                # a shard ends between anchors where it can, and in the middle of one where it must
                if held >= shard_bytes and (a != anchor[-1] or held >= 2 * shard_bytes):
                    yield settle(a)
                anchor.append(a), key.append(k), start.append(s), runs.append(r)
                held += len(r)
        if runs:
            yield settle(None)

    return run


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, copy, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                data = t.as_py().encode("utf-8", "surrogatepass")
                merged: list[list[int]] = [[0, len(data)]] if copy else []
                for s in sorted((x["start"], x["stop"]) for x in spans or () if not copy):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                kept, at = [], 0
                for x, y in merged:
                    kept.append(data[at:x])
                    at = y
                kept = b"".join([*kept, data[at:]])
                out.append((i, len(data), len(data) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard_bytes: int = 3 << 20, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each whole text, as UTF-8 bytes."""
    if not GRAM + 34 <= length <= 127 + GRAM:
        raise ValueError(f"length must be from {GRAM + 34} to {127 + GRAM}")
    rows, unique = with_key(docs, id_col, text_col)
    single = rows if unique else rows.dropDuplicates(["key"])
    long_ = single.where(F.octet_length("text") >= length)
    digests = materialise(long_.select("key", F.md5("text").alias("digest")).distinct(), "digests")
    first = digests.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(digests.join(first, "digest").where("key != first").select("key"), "copies")
    n_copies = copies.count()
    own = long_.join(small_side(copies, n_copies), "key", "left_anti").select("key", "text")

    found = spread(own).mapInArrow(_find_anchors(length), "anchor long, key long, packed long")
    twice = found.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).where("n > 1")
    listed = twice.groupBy("key").agg(F.collect_list(F.struct("packed", "anchor", (F.col("n") > hot).alias("hot"))).alias("runs"))
    cut = materialise(own.join(listed, "key").select("key", "text", "runs").mapInArrow(_cut_runs(length), _FOUND), "runs")
    shards = cut.where("anchor IS NOT NULL").select("anchor", "key", "start", "run").repartition("anchor").sortWithinPartitions("anchor", "key", "start")
    removed = shards.mapInArrow(_sort_shards(length, shard_bytes), "key long, start long, stop long")
    settled = cut.where("anchor IS NULL").select("key", "start", "stop")
    spans = removed.unionByName(settled).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    marked = copies.select("key", F.lit(True).alias("copy"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    plan = materialise(marked.unionByName(spans.select("key", F.lit(False).alias("copy"), "spans")), "spans")
    # spans grow with the documents, so texts meet them by a shuffle at every size
    out = rows.join(plan, "key", "left").select("id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    return out.mapInArrow(_apply(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
