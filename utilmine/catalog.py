"""Named queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utilmine.functions import itemset_text
from utilmine.operators.prep import dataset_stats, item_dim, pairs, ranked_entries, total_utility
from utilmine.model import to_entries
from utilmine.plans import cut, shared_folder
from utilmine.queries import mine
from utilmine.sources.convert import write_utility_text
from utilmine.sources.profiles import PROFILES, SQL
from utilmine.sources.utility_text import diff, read_results, read_utility_text, write_results
from utilmine.sql import register
from utilmine.streaming import mine_event_windows
from utilmine.streaming.state import MiningState

Query = Callable[[SparkSession, str], DataFrame]

#: query name -> (algorithm, profile, options); thresholds are a thousandth of the total utility.
MINED: dict[str, tuple[str, str, dict]] = {
    "hui_miner_brand": ("hui-miner", "brand", {}),
    "two_phase_brand": ("two-phase", "brand", {}),
    "fhm_brand": ("fhm", "brand", {}),
    "fhm_plus_brand": ("fhm+", "brand", {"min_length": 2, "max_length": 3}),
    "mhuiminer_supp": ("mhuiminer", "supp", {}),
    "hup_miner_supp": ("hup-miner", "supp", {}),
    "haui_events": ("haui-miner", "events", {}),
    "mmu_brand": ("huim-mmu", "brand", {}),
    "efim_closed_events": ("efim-closed", "events", {}),
    "efim_brand": ("efim", "brand", {}),
    "efim_events": ("efim", "events", {}),
    "tko_brand": ("tko", "brand", {"k": 100}),
    "rept_brand": ("rept", "brand", {"k": 100}),
    "tku_supp": ("tku", "supp", {"k": 100}),
    "shuim_events": ("shuim", "events", {}),
    "incfhm_brand": ("incfhm", "brand", {}),
    "ihup_supp": ("ihup", "supp", {}),
    "hui_trie_supp": ("hui-trie", "supp", {}),
    "hup_tree_events": ("hup-tree", "events", {}),
    "up_growth_supp": ("up-growth", "supp", {}),
    "up_growth_plus_events": ("up-growth+", "events", {}),
    "huim_ga_events": ("huim-ga", "events", {}),
    "huim_bpso_events": ("huim-bpso", "events", {}),
    "mhui_aco_events": ("mhui-aco", "events", {}),
}
#: Results of these are a subset of the exact ones.
APPROXIMATE = {"huim_ga_events", "huim_bpso_events", "mhui_aco_events"}


def threshold(entries: DataFrame) -> int:
    """A thousandth of all utility; transactions of the profiles declare the sum of their items, so nothing has to be grouped."""
    return (entries.agg(F.sum("u")).first()[0] or 0) // 1000


def shown(result: DataFrame) -> DataFrame:
    """Itemsets as text, for comparison across engines."""
    extra = [c for c in ("window_id",) if c in result.columns]
    return result.select(*extra, itemset_text("itemset").alias("itemset"), "length", "utility", "support")


def _mined(algorithm: str, profile: str, options: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = cut(PROFILES[profile](spark, sf_dir))
        m = 1 if "k" in options else threshold(entries)
        return shown(mine(entries, algorithm, m, **options))

    return run


def dataset_stats_brand(spark, sf_dir):
    found = dataset_stats(PROFILES["brand"](spark, sf_dir))
    return found.select("n_tx", "n_items", F.round("avg_length", 6).alias("avg_length"), "max_length", "total_utility", F.round("density", 6).alias("density"))


def item_twu_brand(spark, sf_dir):
    return item_dim(PROFILES["brand"](spark, sf_dir)).select("item", "twu", "utility", "support")


def pair_twu_brand(spark, sf_dir):
    ranked = ranked_entries(PROFILES["brand"](spark, sf_dir), None, [F.col("item")]).persist()
    return pairs(ranked).select("i", "j", "twu", "utility", "support")


def twu_filtered_supp(spark, sf_dir):
    """Entries of promising items (TWU of a hundredth of the total utility), in processing order, with the remaining utility."""
    entries = cut(PROFILES["supp"](spark, sf_dir))
    items = cut(item_dim(entries).where(F.col("twu") >= total_utility(entries) // 100).select("item", "twu"))
    return ranked_entries(entries, items, [F.col("twu"), F.col("item")]).select("tid", "item", "rank", "u", "ru", "tu")


def result_diff_events(spark, sf_dir):
    """The result at a threshold against the one at twice the threshold."""
    entries = cut(PROFILES["events"](spark, sf_dir))
    m = threshold(entries)
    found = diff(mine(entries, "fhm", m), mine(entries, "efim", 2 * m))
    return found.select(itemset_text("itemset").alias("itemset"), "status", "expected", "found")


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def text_round_trip_supp(spark, sf_dir):
    """Transactions written in the text format, read again, mined, and the result file read back."""
    entries = cut(PROFILES["supp"](spark, sf_dir))
    at, out = _folder(spark, "text"), _folder(spark, "results")
    write_utility_text(entries, at)
    again = cut(to_entries(read_utility_text(spark, at)))
    write_results(mine(again, "fhm", threshold(entries)), out)
    return read_results(spark, out).select(itemset_text("itemset").alias("itemset"), "utility")


def event_windows(spark, sf_dir):
    """Baskets of a user in windows of one day of event time; each window is mined by itself, at a thousandth of all utility."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    rows = events.select(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("key"), F.get_json_object("props", "$.k").cast("bigint").alias("item"), F.round(F.col("value") * 100).cast("bigint").alias("utility"))
    baskets = cut(rows.groupBy("w", "key", "item").agg(F.sum("utility").alias("utility")))
    m = (baskets.where("item IS NOT NULL").agg(F.sum("utility")).first()[0] or 0) // 1000
    found = mine_event_windows(baskets, m)
    return found.select(F.unix_seconds("window_start").alias("window_second"), itemset_text("itemset").alias("itemset"), "length", "utility", "support")


def sql_function_nations(spark, sf_dir):
    """The table function on the orders of each nation's customers: suppliers' nations as items, quantities as utilities, at a fiftieth of the group's total."""
    register(spark)
    at = sf_dir.rstrip("/")
    for name in ("lineitem", "orders", "customer", "supplier"):
        spark.read.parquet(f"{at}/{name}.parquet").createOrReplaceTempView(f"utilmine_{name}")
    spark.sql("""CREATE OR REPLACE TEMP VIEW utilmine_groups AS
        SELECT c_nationkey AS g, l_orderkey AS tid, CAST(s_nationkey AS BIGINT) AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS u
        FROM utilmine_lineitem JOIN utilmine_orders ON o_orderkey = l_orderkey JOIN utilmine_customer ON c_custkey = o_custkey JOIN utilmine_supplier ON s_suppkey = l_suppkey
        GROUP BY 1, 2, 3""")
    total = spark.sql("SELECT sum(u) FROM utilmine_groups").first()[0] or 0
    found = spark.sql(f"SELECT * FROM mine_utility(TABLE(utilmine_groups) PARTITION BY (g), {total // 2000})")
    return found.groupBy("length").agg(F.count("*").alias("itemsets"), F.sum("utility").alias("utility"), F.sum("support").alias("support"))


def kept_state_events(spark, sf_dir):
    """All transactions in three batches, mined with kept state: the result after the last one."""
    entries = cut(PROFILES["events"](spark, sf_dir))
    state = MiningState(spark, _folder(spark, "mining-state"), threshold(entries))
    for batch in range(3):
        state.apply(cut(entries.where(F.pmod("tid", F.lit(3)) == batch)), batch)
    return shown(state.result())


def heuristics_recall_events(spark, sf_dir):
    """What the three heuristics find, against the exact result: itemsets that are not in it or have other sums, and whether nine in ten are found."""
    entries = cut(PROFILES["events"](spark, sf_dir))
    m = threshold(entries)
    exact = cut(mine(entries, "efim", m))
    n = exact.count()
    rows = []
    for kind in ("huim-ga", "huim-bpso", "mhui-aco"):
        found = cut(mine(entries, kind, m, iterations=300))
        good = found.join(exact, ["itemset", "length", "utility", "support"], "left_semi").count()
        rows.append((kind, n, found.count() - good, good >= 0.9 * n))
    return spark.createDataFrame(rows, "kind string, n_exact long, wrong long, recalled boolean")


PLAIN: dict[str, Query] = {f.__name__: f for f in (kept_state_events, heuristics_recall_events, dataset_stats_brand, item_twu_brand, pair_twu_brand, twu_filtered_supp, result_diff_events, text_round_trip_supp, event_windows, sql_function_nations)}


def queries() -> dict[str, Query]:
    return PLAIN | {name: _mined(*what) for name, what in MINED.items()}


def _entries_sql(profile: str) -> str:
    return f"e AS (SELECT tid, item, CAST(sum(u) AS BIGINT) AS u FROM ({SQL[profile]}) GROUP BY tid, item), t AS (SELECT tid, CAST(sum(u) AS BIGINT) AS tu FROM e GROUP BY tid), mm AS (SELECT CAST(sum(u) AS BIGINT) // 1000 AS m FROM e)"


_SUBSETS = """
s AS (SELECT tid, item AS last, [item] AS items, u FROM e
      UNION ALL SELECT s.tid, e.item, list_append(s.items, e.item), s.u + e.u FROM s JOIN e ON s.tid = e.tid AND e.item > s.last),
x AS (SELECT items, CAST(sum(u) AS BIGINT) AS utility, count(*) AS support FROM s GROUP BY items)"""
_SHOWN = "array_to_string(items, ' ') AS itemset, CAST(len(items) AS INT) AS length, utility, support"


def _mined_sql(name: str) -> str:
    algorithm, profile, options = MINED[name]
    head = f"WITH RECURSIVE {_entries_sql(profile)}, {_SUBSETS.strip()}"
    if algorithm == "shuim":
        return f"""WITH RECURSIVE e0 AS (SELECT tid AS t0, item, CAST(sum(u) AS BIGINT) AS u FROM ({SQL[profile]}) GROUP BY 1, 2),
mm AS (SELECT CAST(sum(u) AS BIGINT) // 1000 AS m FROM e0),
r AS (SELECT t0, row_number() OVER (ORDER BY t0) - 1 AS row FROM (SELECT DISTINCT t0 FROM e0)),
n AS (SELECT count(*) AS n, CASE WHEN count(*) >= 1000 THEN (count(*) - 1000) // 500 + 1 ELSE 0 END AS full_windows FROM r),
w AS (SELECT t0, window_id FROM r, n, unnest(range(0, full_windows + 1)) AS g(window_id)
      WHERE row >= window_id * 500 AND (window_id = full_windows OR row < window_id * 500 + 1000)),
s AS (SELECT window_id, t0, item AS last, [item] AS items, u FROM e0 JOIN w USING (t0)
      UNION ALL SELECT s.window_id, s.t0, e0.item, list_append(s.items, e0.item), s.u + e0.u FROM s JOIN e0 ON s.t0 = e0.t0 AND e0.item > s.last),
x AS (SELECT window_id, items, CAST(sum(u) AS BIGINT) AS utility, count(*) AS support FROM s GROUP BY 1, 2)
SELECT window_id, {_SHOWN} FROM x, mm WHERE utility >= m"""
    if "k" in options:
        return f"{head} SELECT {_SHOWN} FROM x ORDER BY utility DESC, len(items), items LIMIT {options['k']}"
    if algorithm == "haui-miner":
        return f"{head} SELECT {_SHOWN} FROM x, mm WHERE utility >= m * len(items)"
    if algorithm == "huim-mmu":
        return f"""{head}, mu AS (SELECT item, greatest(m, CAST(floor(0.1::DOUBLE * sum(u)) AS BIGINT)) AS mu FROM e, mm GROUP BY item, m),
least_mu AS (SELECT items, min(mu) AS mu FROM (SELECT items, unnest(items) AS item FROM x) JOIN mu USING (item) GROUP BY items)
SELECT {_SHOWN} FROM x JOIN least_mu USING (items) WHERE utility >= mu"""
    if algorithm == "efim-closed":
        return f"""{head}, h AS (SELECT * FROM x, mm WHERE utility >= m)
SELECT {_SHOWN} FROM h WHERE NOT EXISTS (SELECT 1 FROM h AS b WHERE len(b.items) = len(h.items) + 1 AND b.support = h.support AND list_has_all(b.items, h.items))"""
    if algorithm == "fhm+":
        return f"{head} SELECT {_SHOWN} FROM x, mm WHERE utility >= m AND len(items) BETWEEN {options['min_length']} AND {options['max_length']}"
    return f"{head} SELECT {_SHOWN} FROM x, mm WHERE utility >= m"


def oracle_sql() -> dict[str, str]:
    brand, supp, events = (_entries_sql(p) for p in ("brand", "supp", "events"))
    plain = {
        "dataset_stats_brand": f"""WITH {brand}, p AS (SELECT tid, count(*) AS n, sum(u) AS tu FROM e GROUP BY tid)
SELECT count(*) AS n_tx, (SELECT count(DISTINCT item) FROM e) AS n_items, round(avg(n), 6) AS avg_length, max(n) AS max_length, CAST(sum(tu) AS BIGINT) AS total_utility, round(avg(n) / (SELECT count(DISTINCT item) FROM e), 6) AS density FROM p""",
        "item_twu_brand": f"WITH {brand} SELECT CAST(item AS BIGINT) AS item, CAST(sum(tu) AS BIGINT) AS twu, CAST(sum(u) AS BIGINT) AS utility, count(*) AS support FROM e JOIN t USING (tid) GROUP BY item",
        "pair_twu_brand": f"WITH {brand} SELECT CAST(a.item AS BIGINT) AS i, CAST(b.item AS BIGINT) AS j, CAST(sum(tu) AS BIGINT) AS twu, CAST(sum(a.u + b.u) AS BIGINT) AS utility, count(*) AS support FROM e a JOIN e b ON a.tid = b.tid AND a.item < b.item JOIN t ON t.tid = a.tid GROUP BY 1, 2",
        "twu_filtered_supp": f"""WITH {supp}, i AS (SELECT item, sum(tu) AS twu FROM e JOIN t USING (tid) GROUP BY item HAVING sum(tu) >= (SELECT CAST(sum(u) AS BIGINT) // 100 FROM e))
SELECT CAST(tid AS BIGINT) AS tid, CAST(item AS BIGINT) AS item, CAST(row_number() OVER w AS INT) AS rank, u, CAST(coalesce(sum(u) OVER (PARTITION BY tid ORDER BY twu, item ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS ru, tu
FROM e JOIN t USING (tid) JOIN i USING (item) WINDOW w AS (PARTITION BY tid ORDER BY twu, item)""",
        "result_diff_events": f"WITH RECURSIVE {events}, {_SUBSETS.strip()} SELECT array_to_string(items, ' ') AS itemset, 'missing' AS status, utility AS expected, CAST(NULL AS BIGINT) AS found FROM x, mm WHERE utility >= m AND utility < 2 * m",
    }
    plain["text_round_trip_supp"] = f"WITH RECURSIVE {supp}, {_SUBSETS.strip()} SELECT array_to_string(items, ' ') AS itemset, utility FROM x, mm WHERE utility >= m"
    plain["event_windows"] = f"""WITH RECURSIVE b AS (SELECT (epoch_us(ts)::BIGINT // 86400000000) * 86400 AS w, user_id AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS u FROM events GROUP BY 1, 2, 3),
e AS (SELECT * FROM b WHERE item IS NOT NULL), mm AS (SELECT CAST(sum(u) AS BIGINT) // 1000 AS m FROM e),
s AS (SELECT w, k, item AS last, [item] AS items, u FROM e UNION ALL SELECT s.w, s.k, e.item, list_append(s.items, e.item), s.u + e.u FROM s JOIN e ON s.w = e.w AND s.k = e.k AND e.item > s.last),
x AS (SELECT w, items, CAST(sum(u) AS BIGINT) AS utility, count(*) AS support FROM s GROUP BY 1, 2)
SELECT w AS window_second, {_SHOWN} FROM x, mm WHERE utility >= m"""
    plain["sql_function_nations"] = """WITH RECURSIVE e AS (SELECT c_nationkey AS g, l_orderkey AS tid, CAST(s_nationkey AS BIGINT) AS item, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS u
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
mm AS (SELECT CAST(sum(u) AS BIGINT) // 2000 AS m FROM e),
s AS (SELECT g, tid, item AS last, [item] AS items, u FROM e UNION ALL SELECT s.g, s.tid, e.item, list_append(s.items, e.item), s.u + e.u FROM s JOIN e ON s.tid = e.tid AND e.item > s.last),
x AS (SELECT g, items, CAST(sum(u) AS BIGINT) AS utility, count(*) AS support FROM s GROUP BY 1, 2)
SELECT CAST(len(items) AS INT) AS length, count(*) AS itemsets, CAST(sum(utility) AS BIGINT) AS utility, CAST(sum(support) AS BIGINT) AS support FROM x, mm WHERE utility >= m GROUP BY 1"""
    plain["kept_state_events"] = f"WITH RECURSIVE {events}, {_SUBSETS.strip()} SELECT {_SHOWN} FROM x, mm WHERE utility >= m"
    plain["heuristics_recall_events"] = f"""WITH RECURSIVE {events}, {_SUBSETS.strip()}, n AS (SELECT count(*) AS n_exact FROM x, mm WHERE utility >= m)
SELECT kind, n_exact, CAST(0 AS BIGINT) AS wrong, true AS recalled FROM n, (VALUES ('huim-ga'), ('huim-bpso'), ('mhui-aco')) AS k(kind)"""
    return plain | {name: _mined_sql(name) for name in MINED if name not in APPROXIMATE}
