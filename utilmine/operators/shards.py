"""Item-partitioned depth-first mining: conditional transactions are dealt to shards by itemset, and each shard is mined to the end in one task.

Transactions list their promising items from the least to the most promising one. What follows an item in its transaction is its conditional
transaction; all those of one item are its shard, which holds every itemset that starts with the item. Shards are made where the transactions lie
(equal ones of a batch merged before they are sent), so mining takes two exchanges: entries by transaction, conditional
transactions by shard. A shard of more than ``limit`` places is cut by its next item, again and again, until every part is within the bound.

Inside a shard arrays of all conditional transactions are grown depth first. A row has the utility that its itemset has in it (``base``), how many transactions it stands
for (``n``), and a weight that bounds what is still possible (``w``); a place has an item and its utility. Rows with the same items are merged: utilities are
added place by place. The strategies differ in the weight, and in how much of it goes when a place is left out:

========== ======================= ==================================
kind       weight of a transaction a place that is left out takes away
========== ======================= ==================================
exact      sum of its utilities    its utility
least      sum of its utilities    ``n`` times its least utility
twu        its declared utility    nothing
========== ======================= ==================================

An itemset is extended while the weights of its rows add up to the threshold; items whose rows do not add up to it leave the shard. Utilities are exact in all kinds, so
nothing has to be verified. Sums stay within those of the item table, which Spark has added up with overflow checks.

Closed search: rows also carry the items that came before and were not taken. Merged rows keep those that all of them have (an AND of item sets), so an item
that is in every row's set extends the itemset backwards without losing a transaction: neither the itemset nor anything grown from it is
closed, and the branch is cut. An itemset with an item of its own support among its places is not closed either, but may grow.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.operators.prep import hinted, with_items
from utilmine.plans import cut

#: Places (items of conditional transactions) of a shard that one task mines.
LIMIT = 1 << 20
#: Places of conditional transactions that are made at a time.
_CHUNK = 1 << 19
FOUND = "itemset array<long>, utility long, support long, bound long, visited long, rows long, merged long"


@dataclass
class Rows:
    """Conditional transactions as flat arrays: places of row r are ``start[r]`` to ``start[r + 1]``, its earlier items ``since[r]`` to ``since[r + 1]`` of ``earlier``."""

    items: np.ndarray
    u: np.ndarray
    least: np.ndarray
    start: np.ndarray
    base: np.ndarray
    n: np.ndarray
    w: np.ndarray
    earlier: np.ndarray | None = None
    since: np.ndarray | None = None


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def _ranges(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each of the ranges."""
    ends = np.cumsum(lengths)
    return np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _edges(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths)))


def _added(values: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, where, values)
    return out


def merge(rows: Rows, group: np.ndarray | None = None) -> tuple[Rows, np.ndarray | None]:
    """Rows of the same items (and group) become one; with few such rows they are left as they are."""
    size = len(rows.base)
    if size < 2:
        return rows, group
    lengths = np.diff(rows.start)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_mix(rows.items + 1))))
    key = _mix(sums[rows.start[1:]] - sums[rows.start[:-1]]) + lengths.astype(np.uint64)
    if group is not None:
        key = key * np.uint64(0x9E3779B97F4A7C15) + _mix(group + 1)
    _, first, to = np.unique(key, return_index=True, return_inverse=True)
    if len(first) > 0.9 * size:
        return rows, group
    same = np.array_equal(lengths, lengths[first][to]) and (group is None or np.array_equal(group, group[first][to]))
    if not same or not np.array_equal(rows.items, rows.items[_ranges(rows.start[first][to], lengths)]):
        return rows, group  # two different rows share a hash
    kept = lengths[first]
    start = _edges(kept)
    at = _ranges(start[to], lengths)
    least = np.full(start[-1], np.iinfo(np.int64).max)
    np.minimum.at(least, at, rows.least)
    count = len(first)
    out = Rows(rows.items[_ranges(rows.start[first], kept)], _added(rows.u, at, start[-1]), least, start, *(_added(x, to, count) for x in (rows.base, rows.n, rows.w)))
    if rows.earlier is not None:
        names, code = np.unique(rows.earlier, return_inverse=True)
        both, times = np.unique(np.repeat(to, np.diff(rows.since)) * max(1, len(names)) + code, return_counts=True)
        row = both // max(1, len(names))
        everywhere = times == np.bincount(to, minlength=count)[row]
        out.earlier = names[both[everywhere] % max(1, len(names))]
        out.since = _edges(np.bincount(row[everywhere], minlength=count))
    return out, None if group is None else group[first]


def _losses(rows: Rows, kind: str, row: np.ndarray) -> np.ndarray:
    """What a place takes from its row's weight when it is left out."""
    if kind == "exact":
        return rows.u
    return rows.least * rows.n[row] if kind == "least" else np.zeros(len(rows.u), dtype=np.int64)


def children(rows: Rows, row: np.ndarray, at: np.ndarray, before: np.ndarray) -> Rows:
    """The conditional transactions of the places ``at``; ``before`` is what left-out places before each place take from the weight."""
    r = row[at]
    lengths = rows.start[r + 1] - at - 1
    flat = _ranges(at + 1, lengths)
    out = Rows(rows.items[flat], rows.u[flat], rows.least[flat], _edges(lengths), rows.base[r] + rows.u[at], rows.n[r], rows.w[r] - before[at])
    if rows.earlier is not None:
        old, skipped = rows.since[r + 1] - rows.since[r], at - rows.start[r]
        out.since = _edges(old + skipped)
        out.earlier = np.empty(out.since[-1], dtype=np.int64)
        out.earlier[_ranges(out.since[:-1], old)] = rows.earlier[_ranges(rows.since[r], old)]
        out.earlier[_ranges(out.since[:-1] + old, skipped)] = rows.items[_ranges(rows.start[r], skipped)]
    return out


def _before(losses: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    running = np.cumsum(losses) - losses
    return running - running[np.minimum(start[:-1], max(0, len(running) - 1))][row] if len(running) else running


class _Search:
    """Depth-first search of one shard after the other; ``found`` collects (itemset, utility, support, bound)."""

    def __init__(self, m: int, kind: str, closed: bool = False, candidates: bool = False, best: list[int] | None = None):
        self.m, self.kind, self.closed, self.candidates = m, kind, closed, candidates
        self.found: list[tuple] = []
        self.best = sorted(best) if best is not None else None  # a heap of the k best utilities known so far
        self.visited = self.rows = self.merged = 0

    def run(self, prefix: tuple, rows: Rows) -> None:
        own = (int(rows.base.sum()), int(rows.n.sum()), int(rows.w.sum()))
        stack = [(prefix, rows, own)]
        while stack:
            prefix, rows, own = stack.pop()
            if own[2] < self.m:  # the threshold has risen since
                continue
            before = len(rows.base)
            rows, _ = merge(rows)
            if self.closed and len(rows.earlier):
                _, times = np.unique(rows.earlier, return_counts=True)
                if times.max() == len(rows.base):
                    continue
            if len(rows.items):
                self.visited += 1
                self.rows += before
                self.merged += len(rows.base)
            stack += reversed(self._grow(prefix, rows, own))

    def _emit(self, found: tuple) -> None:
        self.found.append(found)
        if self.best is not None:
            heapq.heappushpop(self.best, found[1])
            self.m = max(self.m, self.best[0])

    def _grow(self, prefix: tuple, rows: Rows, own: tuple) -> list[tuple]:
        m = self.m
        row = np.repeat(np.arange(len(rows.base)), np.diff(rows.start))
        losses = _losses(rows, self.kind, row)
        order = np.argsort(rows.items, kind="stable")
        names, first = np.unique(rows.items[order], return_index=True)

        def sums(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values[order], first) if len(first) else values

        if self.closed and own[0] >= m and not (sums(rows.n[row]) == own[1]).any():
            self._emit((prefix, *own))
        if not len(names):
            return []
        weak = sums(rows.w[row]) < m
        if weak.any():
            stays = ~weak[np.searchsorted(names, rows.items)]
            w = rows.w - _added(losses[~stays], row[~stays], len(rows.base))
            rows = Rows(rows.items[stays], rows.u[stays], rows.least[stays], _edges(np.bincount(row[stays], minlength=len(rows.base))), rows.base, rows.n, w, rows.earlier, rows.since)
            row, losses = row[stays], losses[stays]
            order = np.argsort(rows.items, kind="stable")
            names, first = np.unique(rows.items[order], return_index=True)
            if not len(names):
                return []
        before = _before(losses, rows.start, row)
        bound, utility, support = sums(rows.w[row] - before), sums(rows.base[row] + rows.u), sums(rows.n[row])
        ends = np.append(first[1:], len(order))
        out = []
        for k in np.flatnonzero(bound >= m):
            itemset, sums_ = (*prefix, int(names[k])), (int(utility[k]), int(support[k]), int(bound[k]))
            if not self.closed and (self.candidates or sums_[0] >= self.m):
                self._emit((itemset, *sums_))
            child = children(rows, row, np.sort(order[first[k] : ends[k]]), before)
            if self.closed or len(child.items):
                out.append((itemset, child, sums_))
        return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, edges) of a list column."""
    edges = np.asarray(column.offsets, dtype=np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), edges - edges[0]


def _read(b: pa.RecordBatch, kind: str, closed: bool) -> Rows:
    of = {name: b.column(i) for i, name in enumerate(b.schema.names)}
    items, start = _flat(of["items"])
    u, _ = _flat(of["us"])
    rows = Rows(items, u, _flat(of["least"])[0] if kind == "least" else u, start, *(of[c].to_numpy().astype(np.int64, copy=False) for c in ("base", "n", "w")))
    if closed:
        rows.earlier, rows.since = _flat(of["earlier"])
    return rows


def _schema(kind: str, closed: bool) -> str:
    return "itemset array<long>, items array<long>, us array<long>, base long, n long, w long" + ", least array<long>" * (kind == "least") + ", earlier array<long>" * closed


def _list(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values))


def _project(kind: str, closed: bool, chunk: int = _CHUNK):
    """Conditional transactions of every place; those of a batch that agree in itemset and items are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _read(b, kind, closed)
            named = list(map(tuple, b.column(b.schema.names.index("itemset")).to_pylist()))
            numbers = {x: i for i, x in enumerate(dict.fromkeys(named))}
            owners, owner = list(numbers), np.array([numbers[x] for x in named], dtype=np.int64)
            row = np.repeat(np.arange(len(rows.base)), np.diff(rows.start))
            # the first item fixes the weight: what comes before it is left out exactly
            is_first = np.array([not x for x in named], dtype=bool)[row]
            losses = np.where(is_first & (kind == "least"), rows.u, _losses(rows, kind, row))
            before = _before(losses, rows.start, row)
            made = np.cumsum(rows.start[row + 1] - np.arange(len(row)) + 4) if not closed else np.cumsum(np.diff(rows.start)[row] + 4 + np.diff(rows.since)[row])
            edges = np.searchsorted(made, np.arange(0, made[-1] if len(made) else 0, chunk))
            for lo, hi in zip(edges, [*edges[1:], len(row)]):
                at = np.arange(lo, hi)
                if not len(at):
                    continue
                names, code = np.unique(rows.items[at], return_inverse=True)
                out, group = merge(children(rows, row, at, before), owner[row[at]] * len(names) + code)
                sets = [(*owners[g // len(names)], int(names[g % len(names)])) for g in group.tolist()]
                columns = [pa.array(sets, pa.list_(pa.int64())), _list(out.items, out.start), _list(out.u, out.start), *(pa.array(x) for x in (out.base, out.n, out.w))]
                if kind == "least":
                    columns.append(_list(out.least, out.start))
                if closed:
                    columns.append(_list(out.earlier, out.since))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _schema(kind, closed).split(", ")])

    return run


def _joined(parts: list[Rows], closed: bool) -> Rows:
    def whole(name: str) -> np.ndarray:
        return np.concatenate([getattr(p, name) for p in parts])

    out = Rows(whole("items"), whole("u"), whole("least"), _edges(np.concatenate([np.diff(p.start) for p in parts])), whole("base"), whole("n"), whole("w"))
    if closed:
        out.earlier, out.since = whole("earlier"), _edges(np.concatenate([np.diff(p.since) for p in parts]))
    return out


def _part(rows: Rows, lo: int, hi: int) -> Rows:
    a, b = rows.start[lo], rows.start[hi]
    out = Rows(rows.items[a:b], rows.u[a:b], rows.least[a:b], rows.start[lo : hi + 1] - a, rows.base[lo:hi], rows.n[lo:hi], rows.w[lo:hi])
    if rows.earlier is not None:
        a, b = rows.since[lo], rows.since[hi]
        out.earlier, out.since = rows.earlier[a:b], rows.since[lo : hi + 1] - a
    return out


def _mine(m: int, kind: str, closed: bool = False, candidates: bool = False, best: list[int] | None = None):
    """Shards, each a run of rows with the same itemset; a last row (without an itemset) says how much was done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(m, kind, closed, candidates, best)
        open_, parts = None, []

        def batch(counts: tuple | None = None) -> pa.RecordBatch:
            rows = [(*f, None, None, None) for f in search.found] + ([(None, None, None, None, *counts)] if counts else [])
            search.found = []
            kinds = [pa.list_(pa.int64()), *[pa.int64()] * 6]
            columns = list(zip(*rows)) if rows else [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

        for b in batches:
            rows = _read(b, kind, closed)
            values, edges = _flat(b.column(b.schema.names.index("itemset")))
            sets = [tuple(values[a:z].tolist()) for a, z in zip(edges, edges[1:])]
            turns = [i for i in range(len(sets)) if not i or sets[i] != sets[i - 1]]
            for lo, hi in zip(turns, [*turns[1:], len(sets)]):
                if parts and open_ != sets[lo]:
                    search.run(open_, _joined(parts, closed))
                    parts = []
                    if len(search.found) > 10_000:
                        yield batch()
                open_ = sets[lo]
                parts.append(_part(rows, lo, hi))
        if parts:
            search.run(open_, _joined(parts, closed))
        yield batch((search.visited, search.rows, search.merged))

    return run


def transactions(entries: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """(itemset: empty, items, us, base, n, w, ...) of the promising ``items`` (item, twu, perhaps least): the shard that holds everything."""
    own_least = kind == "least" and "least" in items.columns
    kept = with_items(entries.select("tid", "item", "u", "tu"), items.select("item", "twu", *["least"] * own_least))
    places = F.array_sort(F.collect_list(F.struct("twu", "item", "u", *["least"] * own_least)))
    rows = kept.groupBy("tid").agg(places.alias("x"), F.max("tu").alias("tu"))
    us = F.transform("x", lambda a: a["u"])
    total = F.aggregate(us, F.lit(0).cast("long"), lambda n, x: n + x)
    empty = F.array().cast("array<bigint>")
    more = [(F.transform("x", lambda a: a["least"]) if own_least else us).alias("least")] * (kind == "least")
    return rows.select(empty.alias("itemset"), F.transform("x", lambda a: a["item"]).alias("items"), us.alias("us"), F.lit(0).cast("long").alias("base"), F.lit(1).cast("long").alias("n"), (F.col("tu") if kind == "twu" else total).alias("w"), *more)


def _deal(source: DataFrame, m: int, kind: str, closed: bool, candidates: bool, limit: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """(results found on the way, rows of all shards, (itemset, bound) of the shards): no shard has more than ``limit`` places."""
    schema = _schema(kind, closed)
    rows = cut(source.mapInArrow(_project(kind, closed), schema))
    found, work, shards = [], [], []
    while True:
        held = F.size("items") + 4 + (F.size("earlier") if closed else 0)
        sums = rows.groupBy("itemset").agg(F.sum("base").alias("utility"), F.sum("n").alias("support"), F.sum("w").alias("bound"), F.sum(held).alias("places"))
        sums = cut(sums.where(F.col("bound") >= m))
        if not closed:
            found.append((sums if candidates else sums.where(F.col("utility") >= m)).drop("places"))
        large = sums.where(F.col("places") > limit)
        n, n_large = sums.count(), large.count()
        small = sums.where(F.col("places") <= limit).select("itemset", "bound")
        shards.append(small)
        work.append(rows.join(hinted(small.select("itemset"), n, 8), "itemset", "left_semi"))
        if not n_large:
            break
        split = rows.join(hinted(large.select("itemset"), n_large, 8), "itemset", "left_semi")
        if closed:
            found.append(_closed_of(split, large, m))
        rows = cut(split.mapInArrow(_project(kind, closed), schema))
    dealt = reduce(DataFrame.unionByName, work)
    return found, dealt if closed else dealt.where(F.size("items") > 0), reduce(DataFrame.unionByName, shards)


def _mined(dealt: DataFrame, task) -> tuple[DataFrame, DataFrame]:
    """(results, counts of the tasks) of the shards ``dealt``."""
    mined = cut(dealt.repartition("itemset").sortWithinPartitions("itemset").mapInArrow(task, FOUND))
    counts = mined.where("itemset IS NULL").agg(*(F.sum(c).alias(c) for c in ("visited", "rows", "merged")))
    return mined.where("itemset IS NOT NULL").select("itemset", "utility", "support", "bound"), counts


def mine_shards(entries: DataFrame, items: DataFrame, m: int, kind: str = "exact", closed: bool = False, candidates: bool = False, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """((itemset, utility, support, bound) with a utility (``candidates``: a bound) of ``m`` or more, (visited, rows, merged) of the tasks).

    ``items`` (item, twu) are those that entries are kept of; kind ``least`` takes a column ``least`` of them instead of each transaction's own utilities. ``closed`` leaves itemsets
    without a superset of the same support.
    """
    source = transactions(entries, items, kind)
    if closed:
        source = source.withColumn("earlier", F.array().cast("array<bigint>"))
    found, dealt, _shards = _deal(source, m, kind, closed, candidates, limit)
    results, counts = _mined(dealt, _mine(m, kind, closed, candidates))
    return reduce(DataFrame.unionByName, [*found, results]), counts


def mine_top_shards(entries: DataFrame, items: DataFrame, k: int, kind: str = "least", rounds: int = 4, limit: int = LIMIT) -> tuple[DataFrame, list[dict]]:
    """(itemset, utility, support, bound) of at least the ``k`` best, and what each round did.

    Shards are mined in rounds of falling bounds. The border is the k-th best exact utility so far: it rises inside a task with each result and between
    rounds for all, and shards whose bound lies below it are never mined. Only ``k`` utilities and ``rounds`` bounds come to the driver.
    """

    def best_of(df: DataFrame) -> list[int]:
        return [r[0] for r in df.orderBy(F.desc("utility")).limit(k).select("utility").collect()]

    def border() -> int:
        return max(1, best[k - 1]) if len(best) >= k else 1

    best = best_of(items)
    items = cut(items.where(F.col("twu") >= border()))
    found, dealt, shards = _deal(transactions(entries, items, kind), border(), kind, False, False, limit)
    best = best_of(reduce(DataFrame.unionByName, found))
    shards = cut(shards)
    share = [1 - (i + 1) / rounds for i in range(rounds - 1)]
    edges = [*(shards.agg(F.percentile_approx("bound", share, 10_000)).first()[0] or [])] if share else []
    did, high = [], None
    for low in [*edges, 0]:
        within = shards.where(F.col("bound") >= max(low, border()))
        within = within if high is None else within.where(F.col("bound") < high)
        high, n = low, within.count()
        if n:
            known = [*[0] * (k - len(best)), *best]
            results, counts = _mined(dealt.join(hinted(within.select("itemset"), n, 8), "itemset", "left_semi"), _mine(border(), kind, best=known))
            best = sorted(best + best_of(results), reverse=True)[:k]
            found.append(results)
            did.append({"shards": n, "verified": counts.first()["visited"] or 0, "border": border()})
    return reduce(DataFrame.unionByName, found).where(F.col("utility") >= border()), did


def _closed_of(rows: DataFrame, sums: DataFrame, m: int) -> DataFrame:
    """The closed ones of the itemsets that are cut further: no other item is in all their transactions."""
    others = rows.select("itemset", "n", F.explode(F.concat("items", "earlier")).alias("other")).groupBy("itemset", "other").agg(F.sum("n").alias("support"))
    open_ = others.join(sums.select("itemset", "support"), ["itemset", "support"], "left_semi").select("itemset").distinct()
    return sums.where(F.col("utility") >= m).join(open_, "itemset", "left_anti").select("itemset", "utility", "support", "bound")
