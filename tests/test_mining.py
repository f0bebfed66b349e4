"""Every strategy against enumeration of all subsets."""

import math
import random
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import pytest

from utilmine.model import check, entries_from, mismatches
from utilmine.queries import STRATEGIES, mine

TINY = [{1: 20, 2: 20}, {1: 30, 3: 30}, {2: 25, 3: 25}]


def enumerate_all(rows):
    out = defaultdict(lambda: [0, 0])
    for x in rows:
        for k in range(1, len(x) + 1):
            for c in combinations(sorted(x), k):
                out[c][0] += sum(x[i] for i in c)
                out[c][1] += 1
    return {c: tuple(v) for c, v in out.items()}


def database(seed=5, rows=50, items=10, longest=5, cheap=False):
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        chosen = {int(r.random() ** 2 * items) + 1: r.randint(1, 20) for _ in range(r.randint(1, longest))}
        if cheap and r.random() < 0.7:
            chosen[999] = 1
        out.append(chosen)
    return out


def entries(spark, rows):
    return entries_from(spark.createDataFrame([(t, i, u) for t, x in enumerate(rows) for i, u in x.items()], "tid long, item long, utility long")).cache()


def as_dict(result):
    rows = result.collect()
    out = {tuple(r["itemset"]): (r["utility"], r["support"]) for r in rows}
    assert len(out) == len(rows)
    return out


EXACT = [n for n in STRATEGIES if n not in ("efim-closed", "haui-miner", "huim-mmu", "tko", "tku", "rept", "shuim", "huim-ga", "huim-bpso", "mhui-aco", "incfhm")]


@pytest.fixture(scope="module")
def db(spark):
    rows = database(cheap=True)
    return rows, enumerate_all(rows), entries(spark, rows)


@pytest.mark.parametrize("name", EXACT)
def test_all_high_utility_itemsets(db, name):
    rows, every, e = db
    m = sum(v for x in rows for v in x.values()) // 12
    assert as_dict(mine(e, name, m)) == {c: v for c, v in every.items() if v[0] >= m}


def test_incremental(db):
    rows, every, e = db
    assert as_dict(mine(e, "incfhm", 120, batches=3)) == {c: v for c, v in every.items() if v[0] >= 120}


def test_batches_add_nothing_to_disk(spark, db):
    """Rows are not copied into later batches: twenty batches write no more than one."""
    rows, every, e = db
    mine(e, "incfhm", 120, batches=1).collect()
    folder = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))

    def written(batches):
        before = {f for f in folder.rglob("part-*")}
        assert as_dict(mine(e, "incfhm", 120, batches=batches)) == {c: v for c, v in every.items() if v[0] >= 120}
        return sum(f.stat().st_size for f in folder.rglob("part-*") if f not in before)

    assert 0 < written(20) <= 1.2 * written(1)


def test_other_kinds(db):
    rows, every, e = db
    m = 60
    hui = {c: v for c, v in every.items() if v[0] >= m}
    closed = {c: v for c, v in hui.items() if not any(set(c) < set(d) and every[d][1] == v[1] for d in every)}
    assert as_dict(mine(e, "efim-closed", m)) == closed
    assert as_dict(mine(e, "haui-miner", m)) == {c: v for c, v in every.items() if v[0] >= m * len(c)}
    single = {c[0]: v[0] for c, v in every.items() if len(c) == 1}
    assert as_dict(mine(e, "huim-mmu", m)) == {c: v for c, v in every.items() if v[0] >= min(max(m, math.floor(0.1 * single[i])) for i in c)}
    assert as_dict(mine(e, "fhm+", m, min_length=2, max_length=3)) == {c: v for c, v in hui.items() if 2 <= len(c) <= 3}


@pytest.mark.parametrize("name", ["tko", "tku", "rept"])
def test_top_k(db, name):
    _, every, e = db
    assert [r["utility"] for r in mine(e, name, k=15).collect()] == sorted((v[0] for v in every.values()), reverse=True)[:15]


@pytest.mark.parametrize("name", ["huim-ga", "huim-bpso", "mhui-aco"])
def test_approximate_results_are_exact(db, name):
    _, every, e = db
    found = as_dict(mine(e, name, 60, iterations=300))
    assert found and all(every[c] == v and v[0] >= 60 for c, v in found.items())


@pytest.mark.parametrize("kind", ["ga", "bpso", "aco"])
def test_iterations_are_generations(spark, kind):
    from utilmine.operators import heuristics

    e = entries(spark, database(3, 60, 30, 12))
    assert heuristics.propose(e, kind, 1, iterations=20, population=30).count() > 150


def test_children_are_new_and_occur():
    import pandas as pd

    from utilmine.operators.heuristics import Island

    baskets = [{1, 2, 3, 4}, {2, 3, 5}, {1, 5, 6}, {4, 6, 7, 8}]
    frame = pd.DataFrame([(t, i, 5) for t, x in enumerate(baskets) for i in x], columns=["tid", "item", "u"])
    island = Island(frame, 1, 4)
    assert {island.mutate((2, 3)) for _ in range(200)} == {(2,), (3,), (1, 2, 3), (2, 3, 4), (2, 3, 5)}
    island.utility((2, 3))
    assert sum(island.diversify((2, 3)) == (2, 3) for _ in range(200)) < 40 and island.diversify((5,)) == (5,)
    island.colony(300, 10)
    assert set(island.known) == {c for x in baskets for k in range(1, 5) for c in combinations(sorted(x), k)}


def test_windows(spark):
    rows = database(7, 23, 8, 4)
    w, h = 10, 5
    full = (len(rows) - w) // h + 1
    expected = {}
    for k in range(full + 1):
        part = rows[k * h : k * h + w] if k < full else rows[k * h :]
        expected |= {(k, c): v for c, v in enumerate_all(part).items() if v[0] >= 25}
    found = mine(entries(spark, rows), "shuim", 25, window=w).collect()
    assert {(r["window_id"], tuple(r["itemset"])): (r["utility"], r["support"]) for r in found} == expected


def test_tiny_and_errors(spark):
    e = entries(spark, TINY)
    assert {c: v[0] for c, v in as_dict(mine(e, "fhm", 45)).items()} == {(1,): 50, (2,): 45, (3,): 55, (1, 3): 60, (2, 3): 50}
    assert as_dict(mine(e, "efim", 10_000)) == {}
    with pytest.raises(ValueError):
        mine(e, "unknown")
    with pytest.raises(ValueError):
        mine(e, "fhm", 1, k=3)
    with pytest.raises(ValueError):
        check(entries(spark, [{1: -3}]))
    declared = entries_from(spark.createDataFrame([(0, 1, 5, 9)], "tid long, item long, utility long, tu long"), tu="tu")
    assert mismatches(declared).count() == 1
