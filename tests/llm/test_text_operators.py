"""Packing, decontamination, classifier, Jaccard join, suffix and line dedup, url lists against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from utilmine.llm import decontaminate, fm_quality, line_dedup, packing, partenum, suffix_dedup, url_lists
from utilmine.llm.common import portions

SCHEMA = "doc_id long, text string, extra string"


def docs(spark, texts):
    rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
    return spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)


def invent(r, n, vocabulary=300):
    return [f"w{r.randint(0, vocabulary)}" for _ in range(n)]


# packing

ODD = ["", "a  b", " x", "x ", "a \n b\n\tc", "it's  don't", "é漢字 <|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "x<|endoftext|>  y", "it<|endoftext|>'s", "\n \n", "a\xa0 b 　c", "1 22 333", "tab\t tab"]


def reference_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    return t.encode(text, add_special_tokens=False).ids


def test_encoder_is_exact():
    r = random.Random(4)
    texts = ODD + ["".join(r.choice([" ", "\n", "a", "b", "é", "1", ".", "'s", "\t", "\xa0", "  ", "漢", *["<|endoftext|>"] * (k % 3 == 0)]) for _ in range(r.randint(0, 25))) for k in range(150)]
    got = packing.Encoder.of(packing.default_tokenizer()).encode_all(texts, block=40)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference_ids(t) for t in texts]


def test_white_space_is_looked_for_by_single_characters():
    class Watched(str):
        pairs = 0

        def __contains__(self, part):
            Watched.pairs += len(part) == 2
            return str.__contains__(self, part)

    texts = [Watched("é first line\nsecond line")] * 20
    encoder = packing.Encoder.of(packing.default_tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(texts)] == [reference_ids(str(t)) for t in texts]
    assert Watched.pairs <= 2 * len(texts)  # a space and a line feed occur


def test_packing_leaves_no_words_in_workers(spark):
    packing.pack(docs(spark, {k: " ".join(f"word{k}{i}" for i in range(50)) for k in range(20)})).count()
    path = packing.default_tokenizer()

    def held(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.Encoder.of(path).words)], pa.int64())], names=["n"])

    assert spark.range(0, 64, 1, 8).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_packing_needs_few_sequences(spark):
    """At most one in a hundred more than the tokens take, from one small file as from many."""
    docs_ = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    placed = packing.pack(docs_, capacity=2048).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n")).first()
    assert placed["n"] <= 1.01 * placed["tokens"] / 2048 + 1


def test_spread_counts_rows_not_splits(spark, tmp_path):
    from utilmine.llm.common import spread

    one = f"{tmp_path}/one"
    spark.range(4000).coalesce(1).write.parquet(one)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = spark.read.parquet(one)
        assert read.rdd.getNumPartitions() >= 4  # more splits than cores, all rows in one of them
        shares = [len(x) for x in spread(read).rdd.glom().collect()]
        assert max(shares) < 2000 and sum(shares) == 4000
        even = spark.range(4000).repartition(5)
        assert spread(even) is even
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_packing_places_every_token_once(spark):
    r = random.Random(5)
    texts = {i: " ".join(invent(r, r.choice([1, 5, 30, 200, 900]))) for i in range(60)} | {100: None, 101: ""}
    rows = packing.pack(docs(spark, texts), capacity=256, open_bins=8, look_ahead=16, fan_in=2).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x), by_sequence[x["sequence_id"]].append(x)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids, at = [*reference_ids(texts[i] or ""), 0], 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and (k == 0 or p["length"] == 256)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256
    assert len(by_sequence) <= 1.15 * sum(x["length"] for x in rows) / 256 + 2
    assert packing.pack(docs(spark, [])).count() == 0


def test_groups_pass_on_only_what_they_leave_open(monkeypatch):
    """Ten groups of ten sequences with two open bins: rows of open sequences are two a group, the others are final."""
    import pyarrow as pa

    r = random.Random(15)
    rows = [(g, 100 * g + i, n) for g in range(10) for i, n in enumerate(sorted((r.randint(1, 9) for _ in range(10)), reverse=True))]
    table = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["g", "sequence_id", "fill"])
    out = [x for b in packing._merge_open(10, 2)(iter([table.slice(0, 37), table.slice(37)])) for x in b.to_pylist()]
    placed, left = [x for x in out if not x["is_open"]], [x for x in out if x["is_open"]]
    assert sorted(x["sequence_id"] for x in placed) == sorted(s for _, s, _ in rows)
    fill, size = defaultdict(int), {s: n for _, s, n in rows}
    for x in sorted(placed, key=lambda x: x["shift"]):
        assert x["into"] // 100 == x["sequence_id"] // 100 and x["shift"] == fill[x["into"]]
        fill[x["into"]] += size[x["sequence_id"]]
    assert max(fill.values()) <= 10 and all(fill[x["into"]] == x["fill"] < 10 for x in left)
    assert len(left) <= 20 and {x["g"] for x in left} <= set(range(10))


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]
    assert sorted(bins.still_open()) == [0, 1]  # the new one was the fullest of three
    assert bins.place(3) == (1, 7) and bins.place(4) == (0, 6)


def test_encoder_of_blocks_with_more_words_than_its_cache(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "LIMIT", 8)
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["one two three", " ".join(f"w{i}" for i in range(30)) + " two three", "three four", " ".join(f"x{i}" for i in range(9)) + " w3"]
    for block in (1, 1000):
        assert [list(np.frombuffer(x, "<u4")) for x in encoder.encode_all(texts, block)] == [reference_ids(t) for t in texts]


# decontamination


def brute_hits(text, items, window=10):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(low))
        size = min(window, len(w))
        for a in range(len(w) - size + 1) if w else ():
            for b in range(len(words) - size + 1):
                if words[b : b + size] == w[a : a + size]:
                    hit |= set(range(b, b + size))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, block):
    r = random.Random(6)
    items = [(k, " ".join(r.choice("abcD") for _ in range(n))) for k, n in enumerate((14, 12, 3, 1, 10, 11))] + [(7, None), (8, "..."), (2, "a b c")]
    texts = {i: ", ".join(r.choice("abcd") * r.choice([1, 1, 2]) for _ in range(r.randint(0, 40))) for i in range(25)} | {30: None, 31: items[0][1].upper()}
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_contamination(docs(spark, texts), table, block_bytes=block).collect()
    for x in rows:
        got = (x["n_words"], sum(s["to"] - s["from"] for s in x["hit_spans"]), x["hit_items"])
        assert got == brute_hits(texts[x["doc_id"]], items)


def test_contamination_with_clashing_names_and_null_ids(spark):
    item = " ".join(f"q{i}" for i in range(12))
    rows = [(1, f"before {item} after " + "z " * 40, 5, "h", 9), (1, f"before {item} after " + "z " * 40, 5, "h", 9), (None, "w " * 100_000 + item, 6, "i", 8), (2, None, 7, "j", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, hit_spans string, Hit_Items int")
    items = spark.createDataFrame([(None, item), (4, item), (5, None)], "item_id long, text string")
    got = sorted(((x["doc_id"] or 0, x["n_words"], x["hit_items"], len(x["hit_spans"])) for x in decontaminate.find_contamination(df, items).collect()), key=str)
    assert got == [(0, 100_012, ["4"], 1), (1, 54, ["4"], 1), (1, 54, ["4"], 1), (2, 0, [], 0)]
    cleaned = decontaminate.clean(df, items)
    assert cleaned.columns == df.columns
    assert sorted((x["doc_id"] or 0, len((x["text"] or "").split()), x["n_words"], x["hit_spans"], x["Hit_Items"]) for x in cleaned.collect()) == [(0, 100_000, 6, "i", 8), (1, 42, 5, "h", 9), (1, 42, 5, "h", 9), (2, 0, 7, "j", 7)]
    assert decontaminate.clean(df, items, min_span=13).where("doc_id = 1").first()["text"] == rows[0][1]


def test_cleaning_is_one_python_pass_over_portions(spark):
    df, items = docs(spark, {1: "a b"}), spark.createDataFrame([(0, "a b c")], "item_id long, text string")
    plan = decontaminate.clean(df, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # a second one is a second worker beside each task's first
    r = random.Random(2)
    texts = [None, "", "x" * 5000, *("é" * r.randint(0, 300) for _ in range(500)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    parts = list(portions(iter([batch, batch.slice(0, 0)]), 1, 1000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    sizes = [[len((t or "").encode()) for t in part.column(1).to_pylist()] for part in parts]
    assert len(parts) > 50 and all(sum(x) - max(x, default=0) <= 1000 for x in sizes)


def test_cleaning_cuts_spans_and_keeps_the_rest(spark):
    item = " ".join(f"q{i}" for i in range(15))
    texts = {1: "Before it. " + item + "; after it.", 2: "Nothing  here.\n", 3: item, 4: None}
    table = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = {x["doc_id"]: x["text"] for x in decontaminate.clean(docs(spark, texts), table, max_coverage=0.9).collect()}
    assert left == {1: "Before it. after it.", 2: "Nothing  here.\n", 4: None}
    assert decontaminate.clean(docs(spark, texts), table.where("false")).count() == 4


# classifier


def test_pairwise_term_in_linear_time():
    m = fm_quality.FactorisationMachine()
    m.w = np.random.default_rng(1).normal(size=fm_quality.FEATURES)
    index, value = fm_quality.features("one two two THREE!! | four")
    plain = m.w0 + (m.w[index] * value).sum() + sum(value[i] * value[j] * m.v[index[i]] @ m.v[index[j]] for i in range(len(index)) for j in range(i))
    got, _ = m.margins(index, value, np.zeros(1, dtype=np.int64))
    assert got[0] == pytest.approx(plain)


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    scored = fm_quality.score(d, fm_quality.train(d, labels)).join(labels, "doc_id").where(fm_quality.held_out()).select("score", "quality").collect()
    assert sum((x["score"] >= 0.5) == (x["quality"] == 1) for x in scored) >= 0.95 * len(scored)
    odd = docs(spark, {1: None, 2: "", 3: "x" * 100_000})
    assert all(0 <= x["score"] <= 1 for x in fm_quality.score(odd, fm_quality.FactorisationMachine()).collect())
    one_class = fm_quality.train(d, labels.where("quality = 1"))
    assert one_class.score("text") > 0.5


# Jaccard join


def brute_components(sets, num, den):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, num):
    r = random.Random(7)
    texts = {}
    for g in range(14):
        base = invent(r, r.choice([2, 6, 20, 60, 150]))
        for _ in range(r.randint(1, 9)):
            near = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                near[r.randrange(len(near))] = f"n{r.randint(0, 99)}"
            texts[len(texts)] = "\t".join(near).upper() if r.random() < 0.3 else " ".join(near)
    texts |= {500: None, 501: " \n", 502: "", 503: texts[0]}
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    rows = partenum.jaccard_components(docs(spark, [*texts.items(), (None, "no id")]), k=k, num=num).collect()
    expected = brute_components(sets, num, 100)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows if x["doc_id"] is not None} == {i: (len(s), expected[i]) for i, s in sets.items()}
    kept = partenum.keep_first(docs(spark, texts), k=k, num=num)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i in sets if expected[i] == i) and kept.columns == ["doc_id", "text", "extra"]


def test_jaccard_with_repeated_ids_and_clashing_names(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (7, a), (7, b), (8, b + " more"), (9, c), (9, c), (None, a), (None, a), (3, None), (2, "")]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, gone_id int, key string")
    got = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["n_shingles"], x["component_id"]) for x in partenum.jaccard_components(df, k=4).collect()), key=str)
    assert got == sorted([(False, 5, 37, 5), (False, 7, 37, 5), (False, 7, 37, 5), (False, 8, 38, 5), (False, 9, 37, 9), (False, 9, 37, 9), (True, 0, 37, None), (True, 0, 37, None), (False, 3, 0, 3), (False, 2, 0, 2)], key=str)
    kept = partenum.keep_first(df, k=4)
    assert kept.columns == df.columns and sorted((x["doc_id"] or 0, x["text"] or "") for x in kept.collect()) == sorted([(5, a), (9, c), (9, c), (0, a), (0, a), (3, ""), (2, "")])
    assert partenum.keep_first(df.where("false")).count() == 0


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(8)
    for size in (1, 5, 7, 13, 40, 200, 900):
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 62, size, dtype=np.uint64))
            out = int(r.integers(0, len(a) * 8 // 100 + 1))
            b = np.unique(np.concatenate((a[out:], r.integers(0, 1 << 62, int(r.integers(0, len(a) * 8 // 100 + 1)), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert len(np.intersect1d(partenum.signatures(a, 85, 100), partenum.signatures(b, 85, 100)))
                differ = sum(int(x).bit_count() for x in (partenum.parities(a) ^ partenum.parities(b)).view(np.uint64))
                assert differ <= len(a) + len(b) - 2 * both


def test_unrelated_sets_share_no_signature():
    """Projections without elements agree between any two sets, so buckets of them would grow with the corpus, and their pairs with its square."""
    r = np.random.default_rng(9)
    for size in (40, 100, 250, 320, 900):
        made = [partenum.signatures(np.unique(r.integers(0, 1 << 62, size, dtype=np.uint64)), 80, 100) for _ in range(150)]
        _, times = np.unique(np.concatenate([np.unique(x) for x in made]), return_counts=True)
        assert times.max() == 1, size


def test_sets_at_the_threshold_share_a_signature():
    """Similarities of exactly 80 and 85 in a hundred, sizes apart and equal, small sets in all their ways."""
    r = np.random.default_rng(10)
    for num, both, a_only, b_only in [(80, 4, 1, 0), (80, 8, 1, 1), (80, 8, 2, 0), (80, 12, 3, 0), (80, 16, 2, 2), (80, 100, 25, 0), (80, 100, 12, 13), (80, 800, 0, 200), (80, 800, 100, 100), (85, 17, 2, 1), (85, 170, 30, 0), (85, 170, 15, 15)]:
        for _ in range(60):
            x = np.unique(r.integers(0, 1 << 62, both + a_only + b_only, dtype=np.uint64))
            r.shuffle(x)
            a, b = np.sort(x[: both + a_only]), np.sort(np.concatenate((x[:both], x[both + a_only :])))
            assert len(np.intersect1d(partenum.signatures(a, num, 100), partenum.signatures(b, num, 100))), (num, both, a_only, b_only)


# suffix arrays


def brute_repeats(ordered, length):
    seen, out = set(), []
    for text in ordered:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                mark[k : k + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if mark[k] and (not k or not mark[k - 1]))
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard,hot", [(3 << 20, 20_000), (400, 3)])
def test_repeated_bytes(spark, shard, hot):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefg é") for _ in range(180))
    texts = ["".join(r.choice("abcdefg é") for _ in range(r.randint(0, 400))) for _ in range(30)]
    texts = [t[:50] + passage[r.randint(0, 40) : r.randint(120, 180)] + t[50:] if r.random() < 0.7 else t for t in texts]
    texts += [texts[3], texts[5][10:] + texts[6], "ab" * 300, "x" * 250, "x" * 120 + "y", None, "", passage[:99], passage * 3]
    rows = suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), shard_bytes=shard, hot=hot).collect()
    got = [tuple(x)[1:5] for x in sorted(rows, key=lambda x: x["doc_id"])]
    assert got == brute_repeats(texts, 100)


def test_repeated_ids_do_not_crash(spark):
    r = random.Random(10)
    long_ = "".join(r.choice("abcdef") for _ in range(300))
    rows = suffix_dedup.remove_repeats(docs(spark, [(1, long_), (1, long_), (2, long_), (None, long_[50:]), (1, "short")])).collect()
    assert sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in rows)) == [(False, 1, 5, 0), (False, 1, 300, 250), (False, 1, 300, 250), (False, 2, 300, 300), (True, 0, 250, 0)]
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_ranks():
    r = random.Random(16)
    for letters in (b"ab", bytes([1, 127, 128, 255])):
        text = bytes(r.choice(letters) for _ in range(700)) + b"ab" * 60
        padded = text + bytes(64)
        keys = [padded[i : i + 64] for i in range(len(text))]
        ordered = sorted(keys)
        first = {k: i for i, k in reversed(list(enumerate(ordered)))}
        got = suffix_dedup.suffix_ranks(np.frombuffer(text, dtype=np.uint8), 64)
        assert got.tolist() == [first[k] for k in keys]


# lines


def test_banded_distance(spark):
    r = random.Random(11)
    pairs = []
    for _ in range(300):
        a = [r.choice("abcé") for _ in range(r.randint(4, 40))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = r.choice([[], ["a"], ["b"]])
            b = b or ["c"]
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3):
        got = df.select(line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("d"), F.levenshtein("a", "b").alias("e")).collect()
        assert all((x["d"] <= edits) == (x["e"] <= edits) and (x["e"] > edits or x["d"] == x["e"]) for x in got)
        cut = line_dedup.differing_parts(df.select(F.repeat("a", 3).alias("line"), F.concat(F.repeat("a", 2), "b").alias("line2")), edits)
        same = cut.select(F.levenshtein("line", "line2").alias("d"), F.levenshtein("part_a", "part_b").alias("e"), F.char_length("part_a").alias("n")).collect()
        assert all(x["d"] == x["e"] and x["n"] > edits for x in same)


def test_repeated_lines(spark):
    r = random.Random(12)
    base = [" ".join(invent(r, r.randint(4, 12), 40)) for _ in range(12)]
    texts = {}
    for i in range(25):
        lines = []
        for _ in range(r.randint(1, 5)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                x[r.randrange(len(x))] = r.choice("xyz")
            lines.append("".join(x) if r.random() < 0.9 else "short")
        texts[i] = "\n".join(lines)
    texts |= {90: None, 91: "", 92: "\n\n"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    seen, expected = [], {}
    for i in sorted(texts):
        kept = []
        for line in (texts[i] or "").split("\n"):
            again = len(line) >= 20 and any(abs(len(s) - len(line)) <= 2 and distance(s, line) <= 2 for s in seen)
            if len(line) >= 20:
                seen.append(line)
            if not again:
                kept.append(line)
        expected[i] = "\n".join(kept)
    got = line_dedup.drop_repeated_lines(docs(spark, [*texts.items(), (None, base[0])]))
    rows = {x["doc_id"]: x["text"] for x in got.collect()}
    assert got.columns == ["doc_id", "text", "extra"] and rows.pop(None) == base[0] and rows.pop(90) is None
    expected.pop(90)
    assert rows == expected


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(rows, per_words=10, edits=2, min_chars=20, exact_chars=1):
    """Texts that are left of (id, text) rows in their order."""
    seen, out = [], []
    for _, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            w = line.split()
            near = len(line) >= min_chars and any(
                len(s) >= min_chars and (edit_distance(w, s.split()) <= max(len(w), len(s.split())) // per_words or abs(len(s) - len(line)) <= edits and edit_distance(s, line) <= edits) for s in seen
            )
            if not near and not (len(line) >= exact_chars and line.strip() and line in seen):
                kept.append(line)
            seen.append(line)
        out.append("\n".join(kept))
    return out


@pytest.mark.parametrize("hot", [64, 2])
def test_reworded_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(13)
    texts = {}
    for n in (8, 9, 10, 11, 19, 20, 21, 30, 39, 45, 90, 130):
        base = invent(r, n, 5000 if n % 2 else 30)
        texts[len(texts)] = " ".join(base)
        for changes in (1, 2, 3, n // 10, n // 10, n // 10 + 1):
            words = list(base)
            # evenly spread edits leave the shortest runs
            for k in range(changes):
                at = min(len(words) - 1, (k + 1) * len(words) // (changes + 1))
                words[at : at + r.choice([0, 1, 1])] = r.choice([[], ["replacement" + str(r.randint(0, 99))]])
            texts[len(texts)] = " ".join(words)
    # few distinct words, hardly any words, white space of other kinds, characters edited in long lines
    texts |= {200 + i: t for i, t in enumerate(["go " * 30, "go " * 31 + "on", "| " * 12, "| " * 11 + "x", "a b " * 25, "a b " * 24 + "b a", "x" * 60, "x" * 58 + "yz", "one\ttwo  three four five six seven eight nine ten", " ".join(texts[60].split())[:-1] + "##", "x y" * 9])}
    texts |= {300 + i: texts[70][:40] + str(i) + " " + texts[70][41:] for i in range(8)}
    left = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(docs(spark, texts), per_words=10, exact_chars=1).collect()}
    expected = dict(zip(sorted(texts), brute_lines([(i, texts[i]) for i in sorted(texts)])))
    assert left == expected and list(left.values()).count("") > 20


def test_edits_of_characters_that_join_and_part_words(spark):
    r = random.Random(15)
    texts = {}
    for n in (9, 10, 11, 12, 13, 19, 20, 29, 38, 39, 40, 41):
        for _ in range(2):
            base = " ".join(invent(r, n, 3000))
            texts[len(texts)] = base
            for edits in (1, 2, 2, 3):
                x = base
                for _ in range(edits):
                    at = r.choice([k for k, c in enumerate(x) if c == " "])
                    x = r.choice([x[:at] + x[at + 1 :], x[:at] + "-" + x[at + 1 :], x[: at + 2] + " " + x[at + 2 :]])
                texts[len(texts)] = x
    left = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(docs(spark, texts), per_words=10, exact_chars=1).collect()}
    assert left == dict(zip(sorted(texts), brute_lines(sorted(texts.items()))))


def test_few_keys_and_few_comparisons(spark, monkeypatch):
    line = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(25)))], "h1 long, line string")
    assert line_dedup.line_keys(line, 2, 20, 10).count() <= 2 * 5  # no keys of segments from ten words on

    written = []
    materialise = line_dedup.common.materialise

    def counted(df, what):
        out = materialise(df, what)
        if what == "close-lines":
            written.append(out.count())
        return out

    monkeypatch.setattr(line_dedup.common, "materialise", counted)
    texts = {k: " ".join([f"word{i}" for i in range(25)] + [f"end{k}"]) for k in range(60)}
    got = line_dedup.drop_repeated_lines(docs(spark, texts), per_words=10, exact_chars=1, report=True)
    assert got.agg(F.sum("n_gone")).first()[0] == 59
    assert sum(written) <= 2 * 60  # not one for each of the 1,770 pairs


def test_first_tokens_meet():
    """The prefix argument on plain lists: t edits of words leave a token in common among the first t + 1, two among the first t + 2."""
    r = random.Random(14)

    def prefix(words, n):
        distinct = [(0, w) for w in sorted(set(words))]
        return distinct[:n] if len(distinct) >= n else distinct + [(j, w) for j in range(1, 9) for w in sorted(set(words)) if words.count(w) >= 1 << j]

    for _ in range(400):
        n = r.randint(9, 60)
        a = [r.randint(0, r.choice([1, 5, 500])) for _ in range(n)]
        b, edits = list(a), r.randint(0, n // 10)
        for _ in range(edits):
            at = r.randrange(len(b))
            b[at : at + r.randint(0, 1)] = r.choice([[], [r.randint(0, 500)]])
        if edit_distance(a, b) <= max(len(a), len(b)) // 10:
            for more in (1, 2):
                assert len(set(prefix(a, len(a) // 9 + more)) & set(prefix(b, len(b) // 9 + more))) >= more


@pytest.mark.parametrize("hot", [64, 2])
def test_long_lines_are_told_apart_by_parities(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(17)
    common = [f"aquitelongword{i}" for i in range(80)]
    far = [" ".join(common + invent(r, 320, 100_000)) for _ in range(12)]  # 320 of 400 words differ
    if hot == 64:
        lines = spark.createDataFrame([(x,) for x in far], "line string").withColumn("h1", F.xxhash64("line"))
        assert line_dedup.candidates(line_dedup.line_keys(lines, 2, 20, 10), 2, 10).count() == 0  # 66 pairs in each of 41 buckets before
    texts = dict(enumerate(far))
    for n in (88, 91, 178, 182, 200, 400):  # about the lengths at which the number of classes changes
        base = invent(r, n, 100_000)
        for changes in (0, n // 10 - 1, n // 10, n // 10 + 3):
            words = list(base)
            for k in range(changes):
                at = (k + 1) * len(words) // (changes + 1)
                words[at : at + r.choice([0, 1, 1])] = r.choice([[], [f"other{k}"]])
            texts[len(texts)] = " ".join(words)
    left = {x["doc_id"]: x["text"] for x in line_dedup.drop_repeated_lines(docs(spark, texts), per_words=10, exact_chars=1).collect()}
    expected = dict(zip(sorted(texts), brute_lines([(i, texts[i]) for i in sorted(texts)])))
    assert left == expected and 6 <= list(left.values()).count("") < 24


def test_lines_of_repeated_ids_and_clashing_names(spark):
    line, other = "A line that is long enough to be compared with others", "Quite another line, long enough to be compared as well"
    rows = [(0, line), (1, line), (1, f"{other}\n{line}"), (1, line), (None, line), (None, other), (2, None), (3, other + "s"), (3, "\n".join(["common"] * 500))]
    df = spark.createDataFrame([(i, t, "x", 7, "g") for i, t in rows], "doc_id long, text string, __key string, n_lines int, gone string")
    got = line_dedup.drop_repeated_lines(df, per_words=10, exact_chars=1)
    assert got.columns == df.columns
    left = sorted(got.collect(), key=str)
    assert {(x["doc_id"], x["text"]) for x in left} == {(0, line), (1, ""), (1, other), (None, line), (None, other), (2, None), (3, ""), (3, "common")}
    assert all((x["__key"], x["n_lines"], x["gone"]) == ("x", 7, "g") for x in left) and len(left) == len(rows)
    assert line_dedup.drop_repeated_lines(df.where("false"), report=True).count() == 0


def test_short_lines_go_if_equal(spark):
    texts = {1: "Menu\n\nA line that is long enough to count\n \nx", 2: "Menu\n\nA line that is long enough to count\n \nx", 3: "menu\nMenu\nx", 4: None}
    got = line_dedup.drop_repeated_lines(docs(spark, texts), per_words=10, exact_chars=1, report=True)
    rows = {x["doc_id"]: (x["text"], x["n_gone"]) for x in got.collect()}
    assert rows == {1: (texts[1], 0), 2: ("\n ", 3), 3: ("menu", 2), 4: (None, 0)}
    odd = {1: "", 2: None, 3: " \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u2028", 4: "\n.\n", 5: "\u200b"}
    assert sorted(x["doc_id"] for x in docs(spark, odd).where(line_dedup.blank("text")).collect()) == [1, 2, 3]


# url lists


def test_lists_as_of(spark):
    entries = spark.createDataFrame([("bad.com", 10, "add"), ("bad.com", 20, "remove"), ("bad.com", 30, "add"), ("ok.bad.com", 15, "remove"), (None, 1, "add"), ("x.org", None, "add")], "domain string, day long, action string")
    urls = [("http://a.bad.com/x", 9), ("http://A.bad.com:80/x", 10), ("https://u@bad.com?q", 19), ("http://bad.com", 20), ("http://ok.bad.com/", 16), ("http://ok.bad.com/", 12), ("http://notbad.com/", 31), (None, 31), ("nonsense", 31), ("http://bad.com", None), ("http://z.bad.com/", 400)]
    pages = spark.createDataFrame([(i, u, d, "k") for i, (u, d) in enumerate(urls)], "page_id long, url string, day long, domain string")
    rows = url_lists.as_of(pages, entries).collect()
    assert [x["listed"] for x in sorted(rows, key=lambda x: x["page_id"])] == [False, True, True, False, False, True, False, False, False, False, True]
    assert url_lists.as_of(pages, entries.where("false")).where("listed").count() == 0
    assert url_lists.as_of(pages.where("false"), entries).count() == 0
