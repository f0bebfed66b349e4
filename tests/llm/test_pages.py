"""WARC round trip and main-text extraction."""

import base64
import gzip
import hashlib
import io
import itertools
import random

import pytest

from utilmine.llm import mincut_html, warc
from utilmine.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, payload_bytes string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    rows = [(5, "http://a/ b\r\nX: y", "héllo"), (3, None, "héllo"), (9, "http://c", None), (1, "http://d", ""), (-7, "http://e", "x" * 300_000), (8, "http://f", "WARC/1.1\r\n\r\n"), (None, "http://g", "héllo"), (8, "http://f", "WARC/1.1\r\n\r\n")]
    got = warc.round_trip(pages(spark, rows), payloads=True).collect()
    assert sorted(bytes(x["payload"]).decode() for x in got if x["record_type"] == "response") == sorted({t or "" for _, _, t in rows})
    seen = sorted(((x["page_id"] is None, x["page_id"] or 0, x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got), key=str)
    first = {"héllo": 3, "": 1, "x" * 300_000: -7, "WARC/1.1\r\n\r\n": 8}
    expected = [(p is None, p or 0, len((t or "").encode()), digest(t), "response" if first[t or ""] == p else "revisit", None if first[t or ""] == p else first[t or ""]) for p, _, t in rows]
    expected[-1] = (*expected[-1][:4], "revisit", 8)
    assert seen == sorted(expected, key=str)
    small = {x["page_id"]: x["record_type"] for x in warc.round_trip(pages(spark, rows[:4]), min_bytes=3).collect()}
    assert small == {5: "revisit", 3: "response", 9: "response", 1: "response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_normalised_archives_have_a_member_per_record(spark, tmp_path):
    raw, final = fresh_path(spark, "raw"), fresh_path(spark, "final")
    written = warc.write_monolithic(pages(spark, [(i, f"http://h/{i}", f"text {i}" * 50) for i in range(40)]), raw, max_records=15).cache()
    assert written.count() == 40
    plan = warc.normalise(written.select("archive").distinct(), warc.plan_revisits(written), raw, final)
    assert plan.rdd.getNumPartitions() == written.select("archive").distinct().count() > 1
    done = plan.collect()
    fs, root = warc.file_system(final)
    assert sum(x["records"] for x in done) == 40
    for x in done:
        data = fs.open_input_stream(f"{root}/{x['archive']}", compression=None).read()
        index = [line.split("\t") for line in fs.open_input_stream(f"{root}/{x['index']}", compression=None).read().decode().splitlines()]
        for offset, size, *_ in index:
            assert gzip.decompress(data[int(offset) : int(offset) + int(size)]).startswith(b"WARC/1.1\r\n")
        heads = [h for h, _ in warc.records(warc.inflate(io.BytesIO(data), 100))]
        assert [h["warc-record-id"] for h in heads] == [line[3] for line in index]


def test_truncated_archive_is_refused():
    record = warc.encode_record("response", "<urn:x:1>", "", "D", b"HTTP/1.1 200 OK\r\n\r\n", b"abc")
    with pytest.raises(ValueError):
        list(warc.records(iter([record[:-10]])))


def test_minimum_cut_is_minimal():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 7)
        s, t = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        edges = [(a, b, r.random() * 2) for a in range(n) for b in range(a) if r.random() < 0.5]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(x) for x in itertools.product((True, False), repeat=n))
        assert cost(mincut_html.min_cut(s, t, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="top"><h1>Site</h1></header><nav><ul><li><a href=/x>One</a><li><a href=/y>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site and ask you to accept all of them now.</p></div>
<article><h1>Head &amp; more</h1><p><b>First   paragraph,
of some length.<br><p>Sec&#111;nd one here, with <a href=z>a link</a> in it.</p><aside>Side note that is long enough to look like text.</aside><p>Short.</article>
<div id="comments"><p>What a fine article this is, I have read it twice.</p></div><div class="ad">Buy this thing now, it is the best thing of all.</div>
<form><label>Name</label><textarea>typed</textarea></form><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    want = "Head & more\nFirst paragraph, of some length.\nSecond one here, with a link in it.\nShort."
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "<p>"), (None, "x", PAGE[: PAGE.index("Second") if "Second" in PAGE else 700]), (5, "y", "<div>" * 3000 + "Deep text that is long enough to be content of a page." + "</p>" * 10)]
    got = {x["page_id"]: x for x in mincut_html.extract(pages(spark, rows)).collect()}
    assert got[1]["text"] == want and got[1]["n_chars"] == len(want)
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[2]["n_chars"]) == ("", "", "", 0)
    assert got[5]["text"].startswith("Deep text")
    assert got[None]["text"].startswith("Head & more")


def test_extraction_of_repeated_rows_and_clashing_names(spark):
    """Every row counts, whatever its id; columns named as results are ignored; no pages, no rows."""
    odd = spark.createDataFrame([(1, "u", PAGE, "mine", 7)] * 2 + [(1, "u", "<p>" + "Quite another text that is long enough to be content. " * 3, "mine", 7)], "page_id long, url string, html string, text string, n_chars int")
    got = mincut_html.extract(odd)
    assert sorted(got.columns)[:2] == ["n_chars", "page_id"] and len(set(got.columns)) == len(got.columns)
    texts = sorted(r["text"] for r in got.collect())
    assert len(texts) == 3 and texts[0] == texts[1] and texts[0].startswith("Head & more") and texts[2].startswith("Quite another")
    assert mincut_html.extract(odd.where("false")).count() == 0


def test_archives_of_rows_repeated_in_full(spark):
    """Each of the repeated rows is a record; one is the response, the others revisit it."""
    got = warc.round_trip(pages(spark, [(4, "http://a", "same")] * 3 + [(2, "http://b", "other")] * 2)).collect()
    kinds = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in got)
    assert kinds == [(2, "response", 0), (2, "revisit", 2), (4, "response", 0), (4, "revisit", 4), (4, "revisit", 4)]


def test_broken_markup():
    long_ = "Some text that is long enough to be the content of a page, or so one would think."
    e = mincut_html.extract_text
    assert e(f'<article><p class="x>{long_}</p><p>{long_}</p></article>') == f"{long_}\n{long_}"
    assert e(f"<article><p title='it's>{long_}</p>") == long_
    assert e(f'<article><p title="a > b">{long_}</p>') == long_
    assert e(f"<html><head><title>T</title><meta charset=utf-8><body><p>{long_}") == long_
    assert e(f"<html><head><title>T</title><p>{long_}") == long_
    assert e(f"<title>T</title><p>{long_}") == long_
    assert e(f"<article><p>{long_} <math><mi>x</mi></math> holds.</p><video src=a><p>{long_}</p>") == f"{long_} x holds."
    assert e(f"<article><template><p>{long_}</p></template><svg/><p>{long_}</p><object><p>no</p></object><p>{long_}</p>") == f"{long_}\n{long_}"


def without_marks(html):
    """The page with plain containers in place of the elements and classes that tell the article and the advert."""
    import re

    return re.sub(r"<(/?)(?:article|nav|footer)>", r"<\1div>", html).replace(' class="ad"', ' class="x1"')


def test_the_cut_decides_where_marks_do_not():
    """On the given pages without their marks, neighbourhood tells short paragraphs from adverts; single blocks cannot."""
    import duckdb

    cut = alone = changed = 0
    pages_ = duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (h,) in pages_:
        want = mincut_html.extract_text(h)
        blocks = mincut_html.blocks_of(without_marks(h))
        both = [mincut_html.costs(b) for b in blocks]
        kept = mincut_html.min_cut([x for _, x in both], [x for x, _ in both], mincut_html.edges_of(blocks))
        plain = [boiler > content for content, boiler in both]
        changed += sum(a != b for a, b in zip(kept, plain))
        cut += "\n".join(b.text for b, k in zip(blocks, kept) if k) == want
        alone += "\n".join(b.text for b, k in zip(blocks, plain) if k) == want
    assert changed > 100 and cut >= 0.95 * len(pages_) and alone < 0.7 * len(pages_), (changed, cut, alone)


def test_given_pages():
    import duckdb

    for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        inner = h.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        import html
        import re

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert mincut_html.extract_text(h) == "\n".join(b for b in blocks if b)
