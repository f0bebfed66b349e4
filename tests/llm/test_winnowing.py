"""Winnowing against a plain implementation, and the edge cases of the docstring."""

import hashlib
import random

from pyspark.sql import functions as F

from utilmine.llm.winnowing import HASH_BITS, fingerprint_with_edits, rolling, selected_grams, POSITION_BITS

SCHEMA = "doc_id long, text string"


def positions(spark, texts, k, w):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    last = (1 << POSITION_BITS) - 1
    rows = df.select("doc_id", selected_grams(F.col("text"), k, w).alias("s")).collect()
    return {r["doc_id"]: [(x >> POSITION_BITS, last - (x & last)) for x in r["s"]] for r in rows}


def test_rightmost_minimum_of_each_window(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for _ in range(60)]
    every = positions(spark, texts, 3, 1)  # a window of one gram selects all grams
    for i, got in positions(spark, texts, 3, 8).items():
        grams = [h for h, _ in every[i]]
        assert len(grams) == max(len(texts[i].split()) - 2, min(1, len(texts[i].split())))
        expected = []
        for a in range(max(1, len(grams) - 7) if grams else 0):
            window = grams[a : a + 8]
            at = a + max(j for j, h in enumerate(window) if h == min(window))
            if (grams[at], at) not in expected:
                expected.append((grams[at], at))
        assert got == expected
        assert all(h < 1 << HASH_BITS for h in grams)


def test_rolling_hashes(spark):
    r = random.Random(4)
    rows = [(i, [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(n)]) for i, n in enumerate((1, 2, 4, 5, 6, 7, 13, 40))]
    df = spark.createDataFrame(rows, "id long, h array<long>")

    def plain(h, k):
        out = []
        for a in range(len(h) - k + 1):
            x = 0
            for y in h[a : a + k]:
                x = ((x << 1 | x >> 63) & ((1 << 64) - 1)) ^ (y & ((1 << 64) - 1))
            out.append(x - (1 << 64) if x >> 63 else x)
        return out

    for k in (1, 2, 3, 4, 5, 6, 7, 11):
        got = df.where(F.size("h") >= k).select("id", rolling(F.col("h"), k).alias("r")).collect()
        assert got and all(x["r"] == plain(rows[x["id"]][1], k) for x in got)


def test_scripts_without_spaces(spark):
    text = "".join(chr(0x4E00 + random.Random(5).randint(0, 3000) * (i % 7 + 1) % 5000) for i in range(200))
    a, b = (len(x) for x in positions(spark, [text, text[:20] + text[20:].replace(text[100], "")], 5, 8).values())
    assert a > 20 and b > 20


def reference(text, k, w, gram_hash):
    """Selected hashes of a text by the plain rule, given the hash of each gram."""
    n = len(text.split())
    grams = gram_hash[text]
    assert len(grams) == (n - k + 1 if n >= k else min(n, 1))
    return {min(grams[a : a + w]) for a in range(max(1, len(grams) - w + 1))} if grams else set()


def test_whole_result_against_plain_version(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 5, 11, 12, 30, 80]))) for i in range(0, 60, 3)}
    texts[7], texts[8] = texts[0] + " end", None
    ids = sorted(texts)
    pair = {a: ((texts[a] or ""), (texts[b] or "")) for a, b in zip(ids, ids[1:] + ids[:1])}
    edited = {a: t[: len(t) - len(t) // 2] + u[: len(t) // 2] for a, (t, u) in pair.items()}
    every = sorted({*edited.values(), *(x for p in pair.values() for x in p)})
    grams = dict(zip(every, ([h for h, _ in x] for _, x in sorted(positions(spark, every, 5, 1).items()))))
    sets = {t: reference(t, 5, 8, grams) for t in every}

    def alike(x, y):
        return len(sets[x] & sets[y]) / len(sets[x] | sets[y]) if sets[x] | sets[y] else 1.0

    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    for row in fingerprint_with_edits(df).collect():
        a = row["doc_id"]
        assert (row["near_edited"], row["near_next"]) == (alike(pair[a][0], edited[a]), alike(*pair[a]))
        for name, t in (("fingerprint", pair[a][0]), ("edited_fingerprint", edited[a])):
            assert {int(x.split(":")[0], 16) for x in row[name].split()} == sets[t]


def test_shared_runs_are_found(spark):
    r = random.Random(2)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    run = words[100:112]  # k + window - 1 words
    texts = [" ".join(words), " ".join([*(f"x{i}" for i in range(37)), *run, *(f"y{i}" for i in range(50))])]
    got = positions(spark, texts, 5, 8)
    assert {h for h, _ in got[0]} & {h for h, _ in got[1]}


def test_edited_and_next(spark):
    texts = {3: "alpha beta gamma delta epsilon zeta", 5: None, 9: "", 11: "ünï x", 20: "alpha beta gamma delta epsilon zeta", None: "last one"}
    df = spark.createDataFrame(list(texts.items()), SCHEMA).withColumn("bucket", F.lit("clash"))
    rows = {r["doc_id"]: r for r in fingerprint_with_edits(df).collect()}
    order = [None, 3, 5, 9, 11, 20]
    for a, b in zip(order, order[1:] + order[:1]):
        t, u = texts[a] or "", texts[b] or ""
        h = len(t) // 2
        assert rows[a]["n_chars"] == len(t)
        assert rows[a]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()
        assert 0 <= rows[a]["near_edited"] <= 1 and 0 <= rows[a]["near_next"] <= 1
    assert rows[3]["fingerprint"] == rows[20]["fingerprint"] != ""
    assert rows[5]["fingerprint"] == "" and rows[5]["near_next"] == 1.0


def test_many_buckets_and_empty(spark):
    from utilmine.llm.winnowing import with_next

    ids = sorted(random.Random(3).sample(range(10_000), 300))
    rows = spark.createDataFrame([(i, f"t{i}", "x") for i in ids], "key long, text string, tie string")
    got = {r["key"]: r["next_text"] for r in with_next(rows, ["text"], rows_per_bucket=7).collect()}
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}
    assert fingerprint_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0
