"""The pipeline's stages keep the columns of documents, and their decisions take effect."""

import corpus_pipeline
from utilmine.llm import registry


def test_stages(spark):
    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[-1] > counts[0] // 2
    packed = corpus_pipeline.run(spark, root)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_copies_leave_no_remnant(spark):
    text = "Menu\n\nA line that is long enough to be compared\n\t\nEnd"
    rows = spark.createDataFrame([(i, text, "en", "web", len(text)) for i in (1, 2)], "doc_id long, text string, lang string, source string, n_chars int")
    assert [(x["doc_id"], x["text"]) for x in corpus_pipeline.lines(spark, rows, "").collect()] == [(1, text)]


def test_registry_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(names)


def test_stages_on_odd_rows(spark):
    """Null ids and texts, empty and very long texts, repeated ids and rows, an extra column: no stage fails, and clean rows stay."""
    root = "/root/testdata/sf0.001"
    good = [r["text"] for r in spark.read.parquet(f"{root}/documents.parquet").join(spark.read.parquet(f"{root}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[1]), (2, good[2]), (None, good[3]), (None, None), (3, None), (4, ""), (5, " ".join(f"{w}{i}" for i in range(300) for w in good[1].split()[:50]))]
    schema = "doc_id long, text string, lang string, source string, n_chars int, key string"
    odd = spark.createDataFrame([(i, t, "en", "web", len(t or ""), "k") for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, odd, root)
        assert left.columns == list(corpus_pipeline.COLUMNS), name
        got = {(x["doc_id"], x["text"]) for x in left.collect()}
        assert (None, good[3]) in got and {t for _, t in got if t} <= {t for _, t in rows}, name
        assert stage(spark, odd.where("false"), root).count() == 0, name
    packed = corpus_pipeline.pack(spark, odd, root)
    assert packed.where("piece = 0").count() == len(rows) and corpus_pipeline.pack(spark, odd.where("false"), root).count() == 0


def test_near_copies_of_a_document_go(spark):
    """A plain version of the stage on the smallest table: of linked documents only the one with the smallest id stays."""
    from itertools import combinations

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}).split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in sets}
    while True:
        before = dict(low)
        for a, b in combinations(sorted(sets), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in sets if low[i] == i}
