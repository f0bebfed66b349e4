"""Min-max near-duplicates against all pairs, and its signatures against what they should estimate."""

import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from utilmine.llm import minmax_dedup, registry

SCHEMA = "doc_id long, text string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def shingle_set(text, k):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def by_force(texts, k=5, num=85):
    """(size, smallest reachable id) of each id."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    low = {i: i for i in sets}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return {i: (len(sets[i]), low[i]) for i in sets}


def test_same_as_all_pairs(spark):
    r = random.Random(8)
    texts = {}
    for g in range(12):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 6, 40, 120, 400]))]
        for _ in range(r.randint(1, 5)):
            texts[len(texts) + 100] = " ".join(words)
            if r.random() < 0.8:  # a chain of small edits, so that components are longer than links
                words = list(words)
                words[r.randrange(len(words))] = f"n{r.randint(0, 9999)}"
    texts |= {1: None, 2: "", 3: " \t", 4: "One two", 5: "one  TWO", 6: "a b c d e f", 7: "a b c d e f"}
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minmax_dedup.near_duplicates(docs(spark, texts.items())).collect()}
    assert got == by_force(texts)


def test_hot_groups(spark):
    """A large group of copies and a large one of near copies are one component each."""
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, "same text in all of these rows, word for word") for i in range(300)]
    rows += [(1000 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(180)]
    r.shuffle(rows)
    got = {x["doc_id"]: x for x in minmax_dedup.near_duplicates(docs(spark, rows)).collect()}
    assert {i for i, x in got.items() if x["kept"]} == {0, 1000} and all(x["component_id"] == (0 if i < 1000 else 1000) for i, x in got.items())


def test_odd_rows(spark):
    text = "a text of more than five words that is its own"
    rows = [(None, text), (None, None), (1, text), (1, "quite another text than the one above it"), (2, "Quite another text than the one above it"), (3, None), (3, None), (4, "x" * 200_000)]
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in minmax_dedup.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False), (3, 3, True), (3, 3, True), (4, 4, True)], key=str)
    assert minmax_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_signatures_are_unbiased_with_lower_variance():
    r = np.random.default_rng(1)
    errors, plain = [], []
    for _ in range(400):
        universe = r.integers(0, 1 << 63, 30, dtype=np.uint64)
        a, b = universe[:26], universe[4:]  # 22 of 30
        same = minmax_dedup.min_max(a, 45) == minmax_dedup.min_max(b, 45)
        errors.append(same.mean() - 22 / 30)
        plain.append(same[:45].mean() - 22 / 30)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < 0.75 * np.var(plain)


def test_band_keys_tell_bands_apart():
    values = np.tile(np.arange(5, dtype=np.uint64), 36)
    assert len(set(minmax_dedup.band_keys(values, 36, 5).tolist())) == 36
    with pytest.raises(ValueError):
        minmax_dedup.permutations_for(35, 5)


def test_same_as_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(registry.OP13_SQL).df()
    got = registry.queries()["op13_minmax_dedup"](spark, small).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
