"""Queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.llm.common import table
from utilmine.llm.conversation_sql import OP11_SQL, OP12_SQL


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.partenum import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.warc import round_trip

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.winnowing import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against a dated list. The tables hold neither fetch days nor lists, so both follow from
    the data: a page is fetched on day ``page_id`` modulo 365; every registered domain (the last two labels of a host) and
    every third host is added, removed and added again on days that its digest gives."""
    from utilmine.llm.url_lists import as_of, domains_of, host_of

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.pmod("page_id", F.lit(365)).alias("day"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()

    def number(name: str, start: int) -> "F.Column":
        return F.conv(F.substring(F.md5(name), start, 6), 16, 10).cast("long")

    own = hosts.where(number("host", 1) % 3 == 0).select(F.col("host").alias("domain"))
    parents = hosts.select(F.element_at(domains_of(F.col("host")), -1).alias("domain"))
    named = own.unionByName(parents).distinct()
    day = number("domain", 7) % 200
    later = day + 20 + number("domain", 13) % 60
    entries = named.select("domain", F.explode(F.array(*(F.struct(d.alias("day"), F.lit(a).alias("action")) for d, a in ((day, "add"), (later, "remove"), (later + 40, "add"))))).alias("e")).select("domain", "e.day", "e.action")
    return as_of(pages, entries)


OP4_SQL = r"""
WITH p AS (SELECT page_id, page_id % 365 AS fetched, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '') AS host FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
named AS (
  SELECT host AS domain FROM h WHERE CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) % 3 = 0
  UNION SELECT regexp_extract(host, '([^.]*\.)?[^.]*$', 0) FROM h),
base AS (SELECT domain, CAST('0x' || substr(md5(domain), 7, 6) AS BIGINT) % 200 AS d1, CAST('0x' || substr(md5(domain), 13, 6) AS BIGINT) % 60 AS gap FROM named),
entries AS (
  SELECT domain, d1 AS day, 'add' AS action FROM base
  UNION ALL SELECT domain, d1 + 20 + gap, 'remove' FROM base
  UNION ALL SELECT domain, d1 + 60 + gap, 'add' FROM base),
held AS (SELECT domain, day, action, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until FROM entries),
best AS (
  SELECT page_id, arg_max(struct_pack(domain := held.domain, day := held.day, action := held.action), length(held.domain)) AS b
  FROM p JOIN held ON (p.host = held.domain OR suffix(p.host, '.' || held.domain)) AND held.day <= p.fetched AND (held.until IS NULL OR p.fetched < held.until)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.fetched AS fetch_day, coalesce(b.action = 'add', false) AS listed, b.domain AS entry_domain, b.day AS entry_day
FROM p LEFT JOIN best USING (page_id)
"""


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.line_dedup import drop_repeated_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_repeated_lines(docs, edits=2, min_chars=20, report=True, per_words=10, exact_chars=1)
    return kept.select("doc_id", "n_lines", "n_gone", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.decontaminate import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window=10)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + (s["to"] - s["from"]))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.fm_quality import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.mincut_html import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.prefix_trie import rebuilt_trie

    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.structure_repair import conversation_rows, damage, repair

    return repair(damage(conversation_rows(table(spark, sf_dir, "conversations"))))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from utilmine.llm.minmax_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=5, num=85, den=100)


def queries() -> dict:
    numbered = (op1_jaccard_join, op2_warc, op3_winnowing, op4_url_lists, op5_suffix_dedup, op6_line_dedup, op7_decontamination, op8_quality, op9_extraction, op10_packing, op11_prefix_trie, op12_structure_repair, op13_minmax_dedup)
    return {f.__name__: f for f in numbered}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _linked_sql(k: int, more: str = "") -> str:
    """Sets of k-word shingles, links from a similarity of 85 / 100 on, and the smallest id that links reach."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})]) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
same AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM same UNION ALL SELECT b, a FROM same),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other),
least AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id{more} FROM sets LEFT JOIN least USING (doc_id)
"""


OP1_SQL = _linked_sql(4)
OP13_SQL = _linked_sql(5, ", doc_id <= coalesce(low, doc_id) AS kept")

OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (CAST(k AS INT) // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (CAST(k AS INT) % 4))) & 31 AS BIGINT) + 1, 1) FOR k IN range(32)], '') AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN f USING (payload_digest)
"""

OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item, least(len(w), 10) AS k, unnest([array_to_string(w[j:j + least(len(w), 10) - 1], ' ') FOR j IN range(1, len(w) - least(len(w), 10) + 2)]) AS x FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS pos, unnest([array_to_string(w[j:j + k - 1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS x FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, item, k, pos FROM dw JOIN iw USING (k, x)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM (SELECT DISTINCT doc_id, k, pos FROM m)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": OP1_SQL, "op2_warc": OP2_SQL, "op4_url_lists": OP4_SQL, "op7_decontamination": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_structure_repair": OP12_SQL, "op13_minmax_dedup": OP13_SQL}
