"""Structure repair and prefix tries of conversations against brute force and their SQL."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from utilmine.llm import conversation_sql, prefix_trie, registry, structure_repair

ROWS = "conv_id long, turn long, role string, text string, audit string"
PRICE = {"K": 0, "R": 3, "D": 4, "I": 3}


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "other") for c, t, r, x in rows], ROWS)


def same_as_sql(spark, query, sql, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(sql)
    columns = sorted(c[0] for c in want.description)
    frame = query(spark, sf)
    assert sorted(frame.columns) == columns
    asked = con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted(asked, key=str)


def repaired_by_force(rows):
    """Every row of (role, text, fault) kept, given the other role or deleted, with up to two insertions at each place."""
    best = None
    gaps = ["", "I", "II"]
    for letters in product(*(("D",) if f in (1, 2) else ("K", "R", "D") for _, _, f in rows)):
        for inserted in product(gaps, repeat=len(rows) + 1):
            audit = "".join(i + x for i, x in zip(inserted, letters)) + inserted[-1]
            if best and (sum(PRICE[x] for x in audit) + 3 * sum(f == 3 for x, (*_, f) in zip(letters, rows) if x != "D"), audit) >= best[:2]:
                continue
            for roles in product("ua", repeat=sum(x in "RI" for x in audit)):
                roles, at, initials, lines, cost = list(roles), 0, "", [], 0
                for x in audit:
                    cost += PRICE[x]
                    if x == "I":
                        r = roles.pop(0)
                        initials, lines = initials + r, [*lines, {"u": "user:", "a": "assistant:"}[r]]
                        continue
                    role, text, fault = rows[at]
                    at += 1
                    if x == "D":
                        continue
                    cost += 3 * (fault == 3)
                    if x == "R":
                        role = {"u": "user", "a": "assistant"}[roles.pop(0)]
                    initials, lines = initials + (role[:1] or "-"), [*lines, f"{role}:{text}"]
                if re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return best


def faulty(rows):
    """(role, text, fault) in order."""
    seen, out = set(), []
    for role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        out.append((role, text, 1 if not stripped else 2 if (role, text) in seen else 0 if stripped[-1] in ".!?" else 3))
        seen.add((role, text))
    return out


def test_cheapest_edits(spark):
    r = random.Random(3)
    conversations = {i: [(r.choice(["system", "user", "assistant", "tool", ""]), r.choice(["One.", "Two!", "cut off", " ", "Three? \n", "x"])) for _ in range(r.randint(0, 4))] for i in range(24)}
    rows = [(i, t, *x) for i, c in conversations.items() for t, x in enumerate(c)]
    got = {x["conv_id"]: x for x in structure_repair.repair(table(spark, rows), spill_bytes=8).collect()}
    assert set(got) == {i for i, c in conversations.items() if c}
    for i, c in conversations.items():
        if c:
            x, marked = got[i], faulty(c)
            assert (x["cost"], x["audit"], x["repaired_sha256"]) == repaired_by_force(marked), c
            assert [x["blank"], x["duplicate"], x["truncated"]] == [sum(f == k for *_, f in marked) for k in (1, 2, 3)]
            assert x["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(c, c[1:]))


def test_long_conversation_spills(spark):
    """Bounded state: backpointers in a file and many Arrow batches give the same audit as memory does."""
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), f"Line {t}." if r.random() < 0.9 else "cut") for t in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        held, spilled = (structure_repair.repair(table(spark, rows), spill_bytes=n).first() for n in (1 << 20, 64))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert held == spilled and len(held["audit"].replace("I", "")) == 6000


def test_repaired_rows_give_the_hash(spark, small):
    damaged = structure_repair.damage(structure_repair.conversation_rows(spark.read.parquet(f"{small}/conversations.parquet")))
    report = structure_repair.repair(damaged)
    turns = structure_repair.repaired_rows(damaged, report)
    text = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("role", F.lit(":"), "text").alias("line")))).alias("x"))
    text = text.select("conv_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("whole"))
    joined = report.join(text, "conv_id", "left").select(F.sha2(F.coalesce("whole", F.lit("")), 256).alias("h"), "repaired_sha256").collect()
    assert joined and all(x["h"] == x["repaired_sha256"] for x in joined)


def test_odd_conversations(spark):
    """Nulls in all columns, repeated rows, one turn twice, very long text, empty table, a column named as a result."""
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "A."), (1, 0, "assistant", "B."), (1, 0, "assistant", "B."), (2, 0, None, None), (3, 5, "user", "x" * 300_000 + "."), (3, 9, "assistant", "y.")]
    got = {x["conv_id"]: x for x in structure_repair.repair(structure_repair.conversation_rows(table(spark, rows))).collect()}
    assert {i: (x["gaps"], x["blank"], x["duplicate"], x["audit"], x["cost"]) for i, x in got.items()} == {None: (0, 1, 0, "DKI", 7), 1: (0, 0, 1, "KKD", 4), 2: (0, 1, 0, "D", 4), 3: (3, 0, 0, "KK", 0)}
    assert structure_repair.repair(structure_repair.conversation_rows(table(spark, []))).count() == 0
    big = structure_repair.repair(table(spark, [(2**60 + 1, 2**60 + k, "user", "A.") for k in (1, 3)] + [(None, None, "user", "B.")])).collect()
    assert {(x["conv_id"], x["gaps"]) for x in big} == {(2**60 + 1, 1), (None, 0)}


def test_damage_follows_the_checksum(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(12) for t in range(6)]
    left = structure_repair.damage(structure_repair.conversation_rows(table(spark, rows))).collect()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = {0: [("assistant", "", False)], 1: [("assistant", "", True)], 2: [("assistant", "One Two", True)], 3: [(role, text, True)] * 2, 4: [("user", text, True)]}.get(fault, [(role, text, True)])
        assert [(x["role"], x["text"], x["present"]) for x in left if (x["conv_id"], x["turn"]) == (c, t)] == want
    gone = [(c, t) for c in range(3000) for t in [0] if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:1]
    report = structure_repair.repair(structure_repair.damage(structure_repair.conversation_rows(table(spark, [(c, t, "user", "A.") for c, t in gone])))).first()
    assert (report["gaps"], report["cost"], report["audit"], report["repaired_sha256"]) == (0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repair_is_what_sql_gives(spark, sf):
    same_as_sql(spark, registry.queries()["op12_structure_repair"], conversation_sql.OP12_SQL, f"/root/testdata/{sf}")


# prefix trie


def trie_by_force(conversations, every=20, heads=4):
    """Nodes of {conv_id: [(role, text)]} by walking all prefixes."""
    rebuilt = {}
    for c, own in conversations.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = conversations.get(c - c % every, [])[:h] + own[h:]
    members = {}
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in held if len(rebuilt[c]) == len(path))
        out.add((held[0], len(path), members[path[:-1]][0] if path else None, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("bound", [1, 7, 4096])
def test_trie_of_mixed_conversations(spark, bound):
    """Shared beginnings of all lengths, exact copies, one long shared chain and turnless conversations; small bounds make Spark split the components."""
    r = random.Random(bound)
    words = ["a b", "c", "", "d e f", "long words here"]
    chain = [("user", f"step {i}") for i in range(40)]
    conversations = {c: [(r.choice(["user", "assistant"]), r.choice(words)) for _ in range(r.randint(1, 6))] for c in range(0, 160, 3)}
    conversations |= {1000 + c: list(chain) for c in range(0, 12)} | {1100 + c: chain[: 5 * c + 1] for c in range(7)}
    rows = [(c, t, *x) for c, turns in conversations.items() for t, x in enumerate(turns)]
    got = prefix_trie.rebuilt_trie(table(spark, rows), bound=bound).select(*COLUMNS).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == trie_by_force(conversations)


def test_decomposition_of_any_tree():
    r = random.Random(6)
    for n, shape in [(1, "r"), (2, "r"), (300, "chain"), (300, "star"), *((r.randint(2, 200), "r") for _ in range(20))]:
        parents = [-1] + [{"chain": v - 1, "star": 0}.get(shape, r.randrange(v)) for v in range(1, n)]
        values = [[r.randint(-5, 9) for _ in range(n)] for _ in range(2)]
        want = [list(v) for v in values]
        for v in range(n - 1, 0, -1):
            for w in want:
                w[parents[v]] += w[v]
        assert prefix_trie._decompose(parents, values) == want


def test_trie_of_odd_rows(spark):
    """Null ids are left out; null roles, texts and turns, repeated rows and very long texts count; an empty table has no root."""
    long_ = "word " * 100_000
    rows = [(None, 0, "user", "x"), (40, None, None, None), (40, 0, "user", long_), (40, 0, "user", long_), (41, 0, "", ""), (41, 1, "user", long_), (42, 3, "user", "b"), (2**60, 0, "user", "c")]
    want = {40: [("", ""), ("user", long_), ("user", long_)], 41: [("", ""), ("user", long_)], 42: [("user", "b")], 2**60: [("user", "c")]}
    assert set(map(tuple, prefix_trie.rebuilt_trie(table(spark, rows)).select(*COLUMNS).collect())) == trie_by_force(want)
    assert prefix_trie.rebuilt_trie(table(spark, [])).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_is_what_sql_gives(spark, sf):
    same_as_sql(spark, registry.queries()["op11_prefix_trie"], conversation_sql.OP11_SQL, f"/root/testdata/{sf}")
