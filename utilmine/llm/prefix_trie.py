"""Conversation prefix trie with rollups by centroid decomposition.

Every distinct sequence of first turns is a node; its members are the conversations that start with it, and the smallest member with the depth names it.
A sequence is known by the running exclusive-or of 128-bit digests of (place, turn), so texts are hashed where they are read and never shuffled,
and a node is one aggregate row.

Nodes of one member are chains without a rollup: one leaf, nothing saved. The others (and the root) form the shared trie. A subtree's total is made by
centroid decomposition of its parent edges: in every component the deepest node whose subtree holds more than half of it is the centroid; the
component's values below the centroid are added up and added to each node on the path from the centroid to the component's top; without the centroid, its child
subtrees and what is above it are components of at most half the size. Each pair of an ancestor and a descendant is counted once, in the round in which a
centroid comes between them, so rounds grow with the logarithm of the trie, not with its depth (a conversation can have any length).

Components beyond ``bound`` nodes are split by Spark, all of them in one round; the others are decomposed in tasks that
stream components of bounded size. Subtree sizes, which centroids need, come from one aggregate: a conversation's path is owned by smaller conversations
down to some depth and by itself below it, so a subtree holds, for each member, the nodes that it owns. Whether a node is below a centroid is read
from the path of the node's own name: one lookup, whatever the depths.

Defined results: rows without a conversation id are left out; null role or text is empty, null turns come first, rows of one turn are ordered by a digest; rows repeated in
full are turns of their own; a remainder has the sign of the id (as SQL's ``%``); texts of any length count whole; an empty table gives no rows, not even a root; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utilmine.llm.common import materialise, release, small_side

#: Nodes of a component that one task decomposes.
BOUND = 4096
WORD = r"[^\x20\x09-\x0D]+"
NAME = ["conv_id", "depth"]
_HALVES = ("a", "b")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): turns numbered from 1, with a digest in two halves and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digests = [F.xxhash64(F.lit(n), role, text).alias(c) for n, c in enumerate(_HALVES)]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *digests, F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), *_HALVES)
    return rows.select("conv_id", F.row_number().over(place).cast("long").alias("depth"), *_HALVES, "words")


def share_heads(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv_id, turns it has), turns): each conversation starts with up to ``heads - 1`` first turns of the one whose id is a multiple of ``every``, as many as its checksum says."""
    own = turns.groupBy("conv_id").agg(F.max("depth").alias("n"))
    own = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = own.join(base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"), "n")
    plan = materialise(plan, "trie-plan")
    first = turns.where(F.col("depth") < heads).withColumnRenamed("conv_id", "base")
    head = plan.where("k > 0").select("conv_id", "base", "h").join(first, "base").where("depth <= h").select("conv_id", "depth", *_HALVES, "words")
    rest = turns.join(plan.select("conv_id", "h", "k"), "conv_id").where("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"), *_HALVES, "words")
    return plan.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), head.unionByName(rest)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, ka, kb, pa, pb, words, last): the key of each sequence of first turns and of the sequence without its last turn."""
    path = Window.partitionBy("conv_id").orderBy("depth")
    own = [F.xxhash64(F.lit(n), "depth", "a", "b").alias(f"r{c}") for n, c in enumerate(_HALVES)]
    rows = turns.select("conv_id", "depth", *own, "words")
    keyed = rows.select("*", *(F.bit_xor(f"r{c}").over(path.rowsBetween(Window.unboundedPreceding, 0)).alias(f"k{c}") for c in _HALVES), F.lead("depth").over(path).isNull().alias("last"))
    return keyed.select("conv_id", "depth", "ka", "kb", *(F.col(f"k{c}").bitwiseXOR(F.col(f"r{c}")).alias(f"p{c}") for c in _HALVES), "words", "last")


def _decompose(parents: list[int], values: list[list[int]]) -> list[list[int]]:
    """Totals of ``values`` over each node's subtree; ``parents`` come before their children, the top (-1) first."""
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    size = [1] * n
    for v in range(n - 1, 0, -1):
        children[parents[v]].append(v)
        size[parents[v]] += size[v]
    totals = [[0] * n for _ in values]
    open_ = [0]
    while open_:
        top = open_.pop()
        half, centroid = size[top], top
        while (heavy := next((c for c in children[centroid] if 2 * size[c] > half), None)) is not None:
            centroid = heavy
        below, at = [centroid], 0
        while at < len(below):
            below.extend(children[below[at]])
            at += 1
        sums = [sum(column[v] for v in below) for column in values]
        taken, v = size[centroid], centroid
        while True:
            for total, s in zip(totals, sums):
                total[v] += s
            if v == top:
                break
            v = parents[v]
            size[v] -= taken
        open_ += children[centroid]
        children[centroid] = []
        if centroid != top:
            children[parents[centroid]].remove(centroid)
            open_.append(top)
    return totals


def _in_tasks(values: list[str]):
    """Components, each a run of rows (top_conv, top_depth, conv_id, depth, parent_conv_id, values) from shallow to deep."""
    names = [*NAME, *values]

    def solved(rows: list[tuple]) -> list[tuple]:
        at = {row[2:4]: n for n, row in enumerate(rows)}
        parents = [at.get((row[4], row[3] - 1), -1) for row in rows]
        columns = [list(c) for c in zip(*(row[5:] for row in rows))]
        return [(*row[2:4], *sums) for row, *sums in zip(rows, *_decompose(parents, columns))]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        for b in batches:
            done: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if open_ and open_[0][:2] != row[:2]:
                    done += solved(open_)
                    open_ = []
                open_.append(row)
            yield batch(done)
        yield batch(solved(open_) if open_ else [])

    return run


def subtree_totals(nodes: DataFrame, paths: DataFrame, values: list[str], bound: int = BOUND) -> DataFrame:
    """(conv_id, depth, values): each value added up over the subtree of each node.

    ``nodes`` (conv_id, depth, parent_conv_id, size, top_conv, values): ``conv_id`` and ``depth`` name a node, ``size`` counts its subtree, ``top_conv`` names
    its tree's top, of depth 0. ``paths`` (conv_id, depth, owner, parent_owner): the nodes on the path of each conversation that names nodes.
    """
    active, parts, scratch = nodes.withColumn("top_depth", F.lit(0).cast("long")), [], []
    top = ["top_conv", "top_depth"]
    columns = [*top, *NAME, "parent_conv_id", "size", *values]
    active = active.select(*columns)
    small = []
    while True:
        large = materialise(active.where("conv_id = top_conv AND depth = top_depth").where(F.col("size") > bound).select(*top, F.col("size").alias("total")), "trie-large")
        n = large.count()
        scratch.append(large)
        if not n:
            small.append(active)
            break
        hint = small_side(large, n, 3)
        small.append(active.join(hint, top, "left_anti"))
        within = active.join(hint, top)
        heavy = within.where(2 * F.col("size") > F.col("total"))
        centre = heavy.groupBy(*top).agg(F.max(F.struct("depth", "conv_id", "size")).alias("c")).select(*top, F.col("c.conv_id").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size"))
        centre = materialise(centre, "trie-centroids")
        named = small_side(centre, n, 5)
        # the node one below the centroid on the path of the node's own name
        step = paths.select(F.col("conv_id").alias("m"), F.col("depth").alias("m_depth"), "owner", "parent_owner")
        met = within.drop("total").join(named, top).join(step, (F.col("conv_id") == F.col("m")) & (F.col("c_depth") + 1 == F.col("m_depth")) & (F.col("depth") > F.col("c_depth")), "left")
        is_centre = (F.col("conv_id") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        met = met.withColumn("below", F.coalesce(F.col("parent_owner") == F.col("c_conv"), F.lit(False))).withColumn("centre", is_centre)
        met = materialise(met.drop("m", "m_depth", "parent_owner"), "trie-met")
        sums = met.where("below OR centre").groupBy(*top).agg(*(F.sum(c).alias(c) for c in values))
        sums = materialise(centre.join(sums, top), "trie-sums")
        on_path = paths.withColumnRenamed("conv_id", "c_conv").join(small_side(sums, n, 5 + len(values)), "c_conv").where("depth >= top_depth AND depth <= c_depth")
        on_path = materialise(on_path.select(F.col("owner").alias("conv_id"), "depth", "c_size", *values), "trie-path")
        parts.append(on_path.select(*NAME, *values))
        less = on_path.select(*NAME, F.col("c_size").alias("less"))
        left = met.where("NOT centre").drop("c_size").join(less, NAME, "left")
        active = left.select(
            F.when(F.col("below"), F.col("owner")).otherwise(F.col("top_conv")).alias("top_conv"), F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            *NAME, "parent_conv_id", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), *values,
        )
        active = materialise(active, "trie-active")
        scratch += [centre, met, sums, on_path, active]
    rest = reduce(DataFrame.unionByName, small)
    alone = (F.col("conv_id") == F.col("top_conv")) & (F.col("depth") == F.col("top_depth")) & (F.col("size") == 1)
    grouped = rest.where(~alone).select(*top, *NAME, "parent_conv_id", *values).repartition(*top).sortWithinPartitions(*top, "depth", "conv_id")
    parts += [rest.where(alone).select(*NAME, *values), grouped.mapInArrow(_in_tasks(values), ", ".join(f"{c} long" for c in (*NAME, *values)))]
    out = materialise(reduce(DataFrame.unionByName, parts).groupBy(*NAME).agg(*(F.sum(c).alias(c) for c in values)), "trie-totals")
    release(*scratch)
    return out


def _joined_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the members of each run of equal (conv_id, depth), comma-joined as they come."""
    open_, digest = None, None

    def batch(rows):
        columns = list(zip(*rows)) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=[*NAME, "ends_sha256"])

    for b in batches:
        done = []
        for conv, depth, member in zip(*(c.to_pylist() for c in b.columns)):
            if open_ == (conv, depth):
                digest.update(b",%d" % member)
                continue
            if open_:
                done.append((*open_, digest.hexdigest()))
            open_, digest = (conv, depth), hashlib.sha256(b"%d" % member)
        yield batch(done)
    yield batch([(*open_, digest.hexdigest())] if open_ else [])


def trie(lengths: DataFrame, turns: DataFrame, bound: int = BOUND) -> DataFrame:
    """One row per node of the trie of the conversations ``lengths`` (conv_id, n: turns, perhaps none) with ``turns`` (conv_id, depth from 1, a, b: digest, words)."""
    lengths = materialise(lengths, "trie-lengths")
    least, n_convs = lengths.agg(F.min("conv_id"), F.count("*")).first()
    keyed = materialise(prefixes(turns), "trie-prefixes")
    nothing = F.lit(None).cast("long")
    root = lengths.limit(0) if least is None else lengths.sparkSession.range(1)
    root = root.select(F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("ka", "kb")), F.lit(least).cast("long").alias("conv_id"), F.lit(n_convs).alias("n_convs"), F.lit(0).cast("long").alias("words"), nothing.alias("pa"), nothing.alias("pb"), F.lit(False).alias("last"))
    nodes = keyed.groupBy("depth", "ka", "kb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("words", "pa", "pb")), F.max("last").alias("last"))
    nodes = materialise(nodes.unionByName(root), "trie-nodes")
    shared = nodes.where("n_convs > 1 OR depth = 0")
    n_shared = shared.count()
    above = shared.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent"))
    # where the node above has one member, that is this node's as well
    named = nodes.join(small_side(above, n_shared, 4), ["depth", "pa", "pb"], "left")
    named = materialise(named.select(*NAME, F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), F.col("parent").isNotNull().alias("under_shared"), "ka", "kb", "n_convs", "words", "last"), "trie-named")
    kids = named.where("under_shared").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("chains"))
    inner = named.where("n_convs > 1 OR depth = 0").join(kids, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    inner = materialise(inner.select(*NAME, "parent_conv_id", "ka", "kb", "n_convs", "n_children", (F.coalesce("chains", F.lit(0)) + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), "trie-inner")

    owners = inner.where("depth > 0").select("depth", "ka", "kb", F.col("conv_id").alias("owner"), F.col("parent_conv_id").alias("parent_owner"))
    paths = keyed.select("conv_id", "depth", "ka", "kb", "last").join(small_side(owners, n_shared, 5), ["depth", "ka", "kb"]).select("conv_id", "depth", "owner", "parent_owner", "last")
    at_root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("owner"), nothing.alias("parent_owner"), (F.col("n") == 0).alias("last"))
    paths = materialise(paths.unionByName(at_root), "trie-paths")
    # subtree sizes: what each member owns; of the node's own name only what is below
    owned = materialise(paths.where("conv_id = owner").groupBy("conv_id").agg(F.count("*").alias("own"), F.max("depth").alias("deepest")), "trie-owned")
    held = paths.join(owned.select("conv_id", "own"), "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("own").alias("all_own"))
    sized = inner.join(held, NAME).join(owned, "conv_id").withColumn("size", F.col("all_own") - F.col("own") + F.col("deepest") - F.col("depth") + 1)
    forest = materialise(sized.select(*NAME, "parent_conv_id", F.lit(least).cast("long").alias("top_conv"), "size", "n_leaves", "saved_tokens"), "trie-forest")
    totals = subtree_totals(forest, paths.drop("last"), ["n_leaves", "saved_tokens"], bound)

    ends = paths.where("last").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    hashed = ends.repartition(*NAME).sortWithinPartitions(*NAME, "member").mapInArrow(_joined_hashes, "conv_id long, depth long, ends_sha256 string")
    empty = F.sha2(F.lit(""), 256)
    branching = inner.drop("n_leaves", "saved_tokens").join(totals, NAME).join(hashed, NAME, "left")
    branching = branching.select(*NAME, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    chains = named.where("n_convs = 1 AND depth > 0")
    alone = F.sha2(F.col("conv_id").cast("string"), 256)
    chains = chains.select(*NAME, "parent_conv_id", "n_convs", (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("last"), alone).otherwise(empty).alias("ends_sha256"))
    release(nodes, owned, forest)
    return branching.unionByName(chains)


def rebuilt_trie(conversations: DataFrame, every: int = 20, heads: int = 4, bound: int = BOUND) -> DataFrame:
    """The trie of conversations that share first turns (``share_heads``)."""
    turns = materialise(ordered_turns(conversations), "trie-turns")
    lengths, rebuilt = share_heads(turns, every, heads)
    return trie(lengths, rebuilt, bound)
