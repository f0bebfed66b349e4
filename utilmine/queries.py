"""``mine``: one call for all query kinds; the registry names 23 strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utilmine.functions import one_removed
from utilmine.model import checked
from utilmine.operators import heuristics
from utilmine.operators.blocks import score, tid_blocks
from utilmine.operators.levels import Rule, mine_levels
from utilmine.operators.verify import verify_trie
from utilmine.operators.prep import hinted, item_dim, pairs, ranked_entries, with_items
from utilmine.operators.shards import mine_shards, mine_top_shards
from utilmine.plans import cut
from utilmine.shipping import ship

ALIASES = {"fhm-plus": "fhm+", "up-growth-plus": "up-growth+", "mhui-miner": "mhuiminer"}
DEFAULT_K = 100


def _result(found: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Canonical result: itemsets in ascending order of item id."""
    return found.select(*(extra or []), F.array_sort("itemset").alias("itemset"), F.size("itemset").alias("length"), F.col("utility").cast("long").alias("utility"), F.col("support").cast("long").alias("support"))


def _top(found: DataFrame, k: int) -> DataFrame:
    return _result(found).orderBy(F.desc("utility"), "length", "itemset").limit(k)


def _promising(entries: DataFrame, m: int, groups: list[str] | None = None) -> DataFrame:
    return item_dim(entries, groups).where(F.col("twu") >= m)


def _ranked(entries: DataFrame, items: DataFrame, order=("twu", "item"), groups=None) -> DataFrame:
    return ranked_entries(entries, cut(items), [F.col(c) for c in order], groups)


def _levels(entries: DataFrame, m: int, extend=None, order=("twu", "item"), pair_twu: int | None = None, **more) -> DataFrame:
    items = _promising(entries, m)
    ranked = _ranked(entries, items, order)
    filter_ = (lambda base: pairs(base).where(F.col("twu") >= pair_twu)) if pair_twu is not None else None
    rule = Rule(emit=more.pop("emit", F.col("utility") >= m), extend=extend if extend is not None else F.col("utility") + F.col("rem") >= m, pair_filter=filter_, **more)
    return mine_levels(ranked, rule)


def two_phase(entries, m, **_):
    return _result(_levels(entries, m, extend=F.col("twu") >= m, order=("item",)))


def hui_miner(entries, m, **_):
    return _result(_levels(entries, m))


def fhm(entries, m, **_):
    """Depth first by item: in an item's shard the rows that an item shares with it bound the pair, more tightly than the pair table's transaction utilities do."""
    return _result(mine_shards(entries, cut(_promising(entries, m)), m)[0])


def fhm_plus(entries, m, min_length=1, max_length=None, **_):
    return _result(_levels(entries, m, pair_twu=m, max_length=max_length)).where(F.col("length") >= min_length)


def mhuiminer(entries, m, **_):
    return _result(_levels(entries, m, pair_twu=1))


def hup_miner(entries, m, partitions=8, **_):
    numbers, total = numbered_rows(entries)
    entries = entries.join(numbers, "tid").drop("tid").withColumnRenamed("row", "tid")
    bucket = F.floor(F.col("tid") * partitions / max(1, total))

    def bounded(joined: DataFrame, grown: DataFrame) -> DataFrame:
        """Keep extensions whose bound, over the ranges of transactions in which they occur, reaches the threshold."""
        parent = grown.groupBy("itemset", bucket.alias("bucket")).agg(F.sum(F.col("iu") + F.col("ru")).alias("bound"))
        occurs = joined.select("itemset", "next", bucket.alias("bucket")).distinct()
        good = occurs.join(parent, ["itemset", "bucket"]).groupBy("itemset", "next").agg(F.sum("bound").alias("bound")).where(F.col("bound") >= m)
        return joined.join(good, ["itemset", "next"], "left_semi")

    return _result(_levels(entries, m, pair_twu=m, before_join=bounded))


def efim(entries, m, **_):
    return _result(mine_shards(entries, cut(_promising(entries, m)), m)[0])


def closed(found: DataFrame) -> DataFrame:
    """Itemsets without a superset of one more item and the same support; with utilities >= 0 such a superset is in the result itself."""
    smaller = found.select(F.explode(one_removed("itemset")).alias("itemset"), "support")
    return found.join(smaller, ["itemset", "support"], "left_anti").select(*found.columns)


def efim_closed(entries, m, **_):
    """Closedness is tested in the search, which cuts branches that cannot hold closed itemsets; ``closed`` gives the same from all itemsets."""
    return _result(mine_shards(entries, cut(_promising(entries, m)), m, closed=True)[0])


def haui_miner(entries, m, **_):
    """High average utility: the total of an itemset is at least ``m`` times its length."""
    found = _levels(entries, m, extend=F.col("mu") >= m, emit=F.col("utility") >= m * F.col("length"))
    return _result(found).withColumn("average", F.col("utility") / F.col("length"))


def huim_mmu(entries, m, beta=0.1, **_):
    items = _promising(entries, m).withColumn("threshold", F.greatest(F.lit(m).cast("long"), F.floor(F.lit(beta) * F.col("utility"))))
    items = cut(items.select("item", "twu", "threshold"))
    ranked = ranked_entries(entries, items, [F.col("threshold"), F.col("twu"), F.col("item")])
    ranked = ranked.join(hinted(items.select("item", "threshold"), items.count()), "item")
    rule = Rule(emit=F.col("utility") >= F.col("threshold"), extend=F.col("utility") + F.col("rem") >= F.col("threshold"))
    return _result(mine_levels(ranked, rule))


def _top_k(entries, k, with_pairs: bool) -> DataFrame:
    items = cut(item_dim(entries))
    best = [r[0] for r in items.orderBy(F.desc("utility")).limit(k).select("utility").collect()]
    state = {"best": best}

    def border() -> int:
        return max(1, state["best"][k - 1]) if len(state["best"]) >= k else 1

    ranked = _ranked(entries, items.where(F.col("twu") >= border()))
    if with_pairs:
        ranked = ranked.persist()
        more = [r[0] for r in pairs(ranked).orderBy(F.desc("utility")).limit(k).select("utility").collect()]
        start = sorted(best + more, reverse=True)[:k]
        floor_ = start[k - 1] if len(start) >= k else 1
    else:
        floor_ = border()
    seen = {"levels": 0}

    def raised(sums: DataFrame):
        """The border is the k-th best of the exact utilities known so far."""
        seen["levels"] += 1
        if seen["levels"] > 1:
            more = [r[0] for r in sums.orderBy(F.desc("utility")).limit(k).select("utility").collect()]
            state["best"] = sorted(state["best"] + more, reverse=True)[:k]
        b = max(border(), floor_)
        return F.col("utility") >= b, F.col("utility") + F.col("rem") >= b

    rule = Rule(emit=F.lit(True), extend=F.lit(True), border=raised, pair_filter=lambda base: pairs(base).where(F.col("twu") >= floor_))
    found = _top(mine_levels(ranked, rule), k)
    if with_pairs:
        ranked.unpersist()
    return found


def tko(entries, m=0, k=None, **_):
    return hui_miner(entries, m) if k is None else _top_k(entries, k, False)


def rept(entries, m=0, k=None, **_):
    return hui_miner(entries, m) if k is None else _top_k(entries, k, True)


def ihup(entries, m, **_):
    return _result(mine_shards(entries, cut(_promising(entries, m)), m, "twu")[0])


def hui_trie(entries, m, **_):
    """Candidates by transaction utility, verified by walking their prefix trie over the transactions."""
    found, _counts = mine_shards(entries, cut(_promising(entries, m)), m, "twu", candidates=True)
    return _result(verify_trie(cut(found), entries).where(F.col("utility") >= m))


def hup_tree(entries, m, **_):
    """Utilities place by place, so the sums that the transaction utilities bound are exact."""
    return ihup(entries, m)


def up_growth(entries, m, **_):
    """Estimates less the least utility that each left-out item has anywhere."""
    least = entries.groupBy("item").agg(F.min("u").alias("least"))
    return _result(mine_shards(entries, cut(_promising(entries, m).join(least, "item")), m, "least")[0])


def up_growth_plus(entries, m, **_):
    """Estimates less the least utilities of the transactions that were merged."""
    return _result(mine_shards(entries, cut(_promising(entries, m)), m, "least")[0])


def tku(entries, m=0, k=None, **_):
    k = k or DEFAULT_K
    items = cut(item_dim(entries))
    return _top(mine_top_shards(entries, items, k)[0], k)


def shuim(entries, m, window=1000, **_):
    """Itemsets of every sliding count window (``window_id``), all windows in one pass."""
    return _result(mine_windows(with_windows(entries, window), m), ["window_id"])


def numbered_rows(entries: DataFrame) -> tuple[DataFrame, int]:
    """((tid, row), how many): transactions numbered from 0 in the order of their ids, by a distributed sort."""
    order = cut(entries.select("tid").distinct().sort("tid").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r[0]: r[1] for r in order.groupBy(part.alias("p")).count().collect()}  # one small row per partition
    offsets, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(p, 0)
    first = F.get(F.lit(offsets or [0]).cast("array<bigint>"), part.cast("int"))
    return order.select("tid", (first + F.col("at").bitwiseAND(F.lit((1 << 33) - 1).cast("long"))).alias("row")), total


def full_windows(total: int, window: int) -> int:
    """How many windows of ``window`` transactions, half a window apart, lie in the first ``total`` ones."""
    return (total - window) // (window // 2) + 1 if total >= window else 0


def window_ids(row: str, window: int, first: int, last: int) -> "F.Column":
    """The windows from ``first`` to ``last`` that hold the transaction of number ``row``."""
    half = window // 2
    low = F.greatest(F.lit(first), F.floor((F.col(row) - window) / half) + 1)
    high = F.least(F.floor(F.col(row) / half), F.lit(last))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def with_windows(entries: DataFrame, window: int) -> DataFrame:
    """Entries once per window they lie in: full windows of ``window`` transactions, half a window apart, then the tail."""
    window = max(2, window)
    numbers, total = numbered_rows(entries)
    full = full_windows(total, window)
    ids = window_ids("row", window, 0, full - 1)
    ids = F.when(F.col("row") >= full * (window // 2), F.concat(ids, F.array(F.lit(full).cast("bigint")))).otherwise(ids)
    return entries.join(numbers.select("tid", F.explode(ids).alias("window_id")), "tid")


def mine_windows(entries: DataFrame, m: int) -> DataFrame:
    groups = ["window_id"]
    ranked = _ranked(entries, _promising(entries, m, groups), groups=groups)
    rule = Rule(emit=F.col("utility") >= m, extend=F.col("utility") + F.col("rem") >= m, pair_filter=lambda base: pairs(base, groups).where(F.col("twu") >= m), groups=groups)
    return mine_levels(ranked, rule)


def incfhm(entries, m, batches=10, **_):
    """Growing batches of transactions: a batch reports the itemsets that its rows touched, with their sums over all rows so far, and the newest report of an itemset counts.

    A table has all its batches already, and there the newest report needs no earlier one: no row after the last batch that touches an itemset has it, so its sums by then are those over all rows, and
    as utilities are not negative they reach the threshold then if they ever do. So each row is mined once, depth first by item, whatever the number of ``batches``; rows that
    come later are the business of ``streaming.state``, which keeps what it has seen.
    """
    return fhm(entries, m)


def _neighbours(found: DataFrame, partners: DataFrame) -> DataFrame:
    """Itemsets of one item less, and of one item more that occurs with one of theirs."""
    less = found.select(F.explode(one_removed("itemset")).alias("itemset")).where(F.size("itemset") > 0)
    more = found.select("itemset", F.explode("itemset").alias("i")).join(partners, "i").where(~F.array_contains("itemset", F.col("j")))
    return less.unionByName(more.select(F.array_sort(F.concat("itemset", F.array("j"))).alias("itemset"))).distinct()


def _heuristic(kind: str) -> Callable:
    """Islands propose, and all transactions decide: proposals are scored exactly by their transactions' blocks. Then local search: neighbours of what was found are scored as
    well, for up to ``sweeps`` rounds or until nothing is new. Partners of an item are those whose pair has a transaction utility of the threshold."""

    def run(entries, m, sweeps=6, **options):
        items = cut(_promising(entries, m))
        kept = cut(with_items(entries, items.select("item")))
        names = ("seed", "iterations", "population", "max_length", "shard_rows")
        blocks = cut(tid_blocks(kept, numbered_rows(kept)[0]))
        asked = cut(heuristics.propose(kept, kind, m, **{k: v for k, v in options.items() if k in names}))
        pair = cut(pairs(ranked_entries(kept, None, [F.col("item")])).where(F.col("twu") >= m).select("i", "j")) if sweeps else None
        partners = pair.unionByName(pair.select(F.col("j").alias("i"), F.col("i").alias("j"))) if sweeps else None
        found = new = cut(score(asked, blocks).where(F.col("utility") >= m))
        for _ in range(sweeps):
            around = cut(_neighbours(new, partners).join(asked, "itemset", "left_anti"))
            if not around.limit(1).count():
                break
            asked = asked.unionByName(around)
            new = cut(score(around, blocks).where(F.col("utility") >= m))
            found = found.unionByName(new)
        return _result(found)

    return run


STRATEGIES: dict[str, Callable] = {
    "two-phase": two_phase, "ihup": ihup, "hup-tree": hup_tree, "hui-trie": hui_trie, "up-growth": up_growth, "up-growth+": up_growth_plus,
    "hui-miner": hui_miner, "fhm": fhm, "hup-miner": hup_miner, "mhuiminer": mhuiminer, "efim": efim, "fhm+": fhm_plus, "efim-closed": efim_closed,
    "haui-miner": haui_miner, "tko": tko, "tku": tku, "rept": rept, "huim-mmu": huim_mmu, "shuim": shuim, "incfhm": incfhm,
    "huim-ga": _heuristic("ga"), "huim-bpso": _heuristic("bpso"), "mhui-aco": _heuristic("aco"),
}
TOP_K = {"tko", "tku", "rept"}


def mine(entries: DataFrame, algorithm: str = "fhm", min_utility: int = 1, **options) -> DataFrame:
    """Mine ``entries`` (tid, item, u, tu) by the named strategy; results are (itemset, length, utility, support).

    A streaming DataFrame of (tid, item, utility) rows, or of lines of the text format, starts a query of ``incfhm`` or ``shuim`` instead (``streaming.mine_stream``).
    """
    ship(entries.sparkSession)
    name = ALIASES.get(algorithm, algorithm)
    if entries.isStreaming:
        from utilmine.streaming import mine_stream

        return mine_stream(entries, name, min_utility, **options)
    if name not in STRATEGIES:
        raise ValueError(f"unknown algorithm {algorithm!r}; known are {', '.join(sorted(STRATEGIES))}")
    if options.get("k") is not None and name not in TOP_K:
        raise ValueError(f"{name} takes no k")
    return STRATEGIES[name](checked(entries), min_utility, **options)
