"""Item-partitioned mining: bounds of shards, merging, closed search and rounds of falling bounds, against enumeration."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_mining import as_dict, database, entries, enumerate_all
from utilmine.operators import shards
from utilmine.operators.prep import item_dim
from utilmine.plans import cut
from utilmine.queries import mine


def promising(e, m):
    return item_dim(e).where(F.col("twu") >= m)


def found(result):
    return {tuple(sorted(r["itemset"])): (r["utility"], r["support"]) for r in result.collect()}


@pytest.fixture(scope="module")
def hot(spark):
    """One item in every transaction, one in two thirds of them."""
    r = random.Random(11)
    rows = [x | {500: r.randint(0, 5)} | ({501: r.randint(1, 9)} if r.random() < 0.66 else {}) for x in database(2, 120, 12, 6)]
    return rows, enumerate_all(rows), entries(spark, rows)


@pytest.mark.parametrize("kind", ["exact", "least", "twu"])
@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_hot_items_are_split(hot, kind, limit):
    rows, every, e = hot
    m = 90
    items = promising(e, m)
    assert found(shards.mine_shards(e, items, m, kind, limit=limit)[0]) == {c: v for c, v in every.items() if v[0] >= m}


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_closed_search(hot, limit):
    """Same as the filter over all itemsets, at fewer visited ones; branches of itemsets that miss an item of all their transactions are cut."""
    rows, every, e = hot
    m, size = 90, max(map(len, every))
    best = defaultdict(int)
    for c, v in every.items():  # largest support of a superset of one more item
        for i in range(len(c)):
            best[c[:i] + c[i + 1 :]] = max(best[c[:i] + c[i + 1 :]], v[1])
    want = {c: v for c, v in every.items() if v[0] >= m and best[c] < v[1]}
    assert 1 < size and 0 < len(want) < sum(v[0] >= m for v in every.values())
    got, did = shards.mine_shards(e, promising(e, m), m, closed=True, limit=limit)
    _, all_did = shards.mine_shards(e, promising(e, m), m, limit=limit)
    assert found(got) == want and did.first()["visited"] < all_did.first()["visited"]


def test_no_shard_beyond_the_limit(hot):
    _, _, e = hot
    source = shards.transactions(e, promising(e, 90), "exact")
    _, dealt, names = shards._deal(source, 90, "exact", False, False, 60)
    places = dealt.groupBy("itemset").agg(F.sum(F.size("items") + 4).alias("n"), F.first(F.size("itemset")).alias("depth")).collect()
    assert max(r["n"] for r in places) <= 60 and {r["depth"] for r in places} > {1} and names.count() >= len(places)


def test_long_transaction_is_made_in_pieces(spark):
    """The conditional transactions of a long one are made some thousand places at a time, and are the same."""
    rows = [{i: 1 for i in range(300)}, {0: 5, 299: 7}]
    e = entries(spark, rows)
    assert found(shards.mine_shards(e, item_dim(e), 300, "exact")[0]) == {tuple(range(300)): (300, 1)}
    top = shards.transactions(e, item_dim(e), "exact")
    whole, pieces = (top.mapInArrow(shards._project("exact", False, n), shards._schema("exact", False)) for n in (1 << 19, 500))
    assert whole.exceptAll(pieces).count() == pieces.exceptAll(whole).count() == 0 and pieces.count() == 302


def test_two_exchanges(hot):
    """Entries go by transaction once and never by item; conditional transactions by shard once."""
    e = cut(hot[2])
    items = cut(promising(e, 90))
    dealt = shards.transactions(e, items, "exact").mapInArrow(shards._project("exact", False), shards._schema("exact", False))
    plan = dealt.repartition("itemset")._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 2 and "tid" in exchanges[1] and "itemset" in exchanges[0]


def test_merging_adds_place_by_place():
    r = np.random.default_rng(3)
    plain = [(tuple(sorted(r.choice(4, r.integers(1, 4), replace=False).tolist())), r.integers(1, 9, 4)) for _ in range(200)]
    items = np.concatenate([np.array(i) for i, _ in plain])
    u = np.concatenate([v[: len(i)] for i, v in plain])
    start = np.concatenate(([0], np.cumsum([len(i) for i, _ in plain])))
    earlier = [np.flatnonzero(r.random(3) < 0.8) + 10 for _ in plain]
    ones = np.ones(200, dtype=np.int64)
    rows = shards.Rows(items, u, u, start, ones * 2, ones, ones * 3, np.concatenate(earlier), np.concatenate(([0], np.cumsum([len(x) for x in earlier]))))
    out, _ = shards.merge(rows)
    want = defaultdict(lambda: [0, 0, 99, None])
    for (i, v), x in zip(plain, earlier):
        w = want[i]
        w[0], w[1], w[2], w[3] = w[0] + v[: len(i)], w[1] + 1, np.minimum(w[2], v[: len(i)]), set(x) if w[3] is None else w[3] & set(x)
    got = {}
    for k in range(len(out.base)):
        a, b = out.start[k], out.start[k + 1]
        got[tuple(out.items[a:b].tolist())] = (out.u[a:b].tolist(), out.n[k], out.least[a:b].tolist(), set(out.earlier[out.since[k] : out.since[k + 1]].tolist()), out.base[k], out.w[k])
    assert got == {i: (w[0].tolist(), w[1], w[2].tolist(), w[3], 2 * w[1], 3 * w[1]) for i, w in want.items()}


def test_rows_of_one_hash_are_not_merged(monkeypatch):
    monkeypatch.setattr(shards, "_mix", lambda x: x.astype(np.uint64) * np.uint64(0))
    ones = np.ones(3, dtype=np.int64)
    rows = shards.Rows(np.array([1, 2, 1]), ones, ones, np.arange(4), ones, ones, ones)
    assert shards.merge(rows)[0] is rows


@pytest.mark.parametrize("k", [1, 15, 100_000])
def test_rounds_of_falling_bounds(hot, k):
    """The k best of all itemsets; later rounds start at a higher border, so fewer itemsets are looked at than without rounds."""
    _, every, e = hot
    got, did = shards.mine_top_shards(e, item_dim(e), k)
    utilities = sorted((r["utility"] for r in got.collect()), reverse=True)[:k]
    assert utilities == sorted((v[0] for v in every.values()), reverse=True)[:k]
    borders = [d["border"] for d in did]
    assert borders == sorted(borders)
    if k == 15:
        single = sorted((v[0] for c, v in every.items() if len(c) == 1), reverse=True)
        plain = shards.mine_shards(e, item_dim(e), single[14] if len(single) > 14 else 1, "least")[1].first()["visited"]
        assert sum(d["verified"] for d in did) < plain


def test_odd_databases(spark):
    empty = entries(spark, [{1: 2}]).where("false")
    for name in ("efim", "efim-closed", "ihup", "up-growth", "up-growth+", "hup-tree", "hui-trie", "tku"):
        assert mine(empty, name, 1).count() == 0
    zero = entries(spark, [{1: 0, 2: 4}, {1: 0, 2: 3}, {1: 0}])
    assert as_dict(mine(zero, "efim", 1)) == {(2,): (7, 2), (1, 2): (7, 2)} and as_dict(mine(zero, "efim-closed", 1)) == {(1, 2): (7, 2)}
    big = entries(spark, [{4_000_000_000: 2**61, 7: 2**60}] * 2)
    assert as_dict(mine(big, "up-growth+", 2**61)) == {(4_000_000_000,): (2**62, 2), (7,): (2**61, 2), (7, 4_000_000_000): (2**62 + 2**61, 2)}
