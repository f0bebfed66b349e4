"""The driver's contract, and queries against SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from utilmine import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist()))


def test_contract(spark):
    assert entry.entry(spark).limit(3).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["dataset_stats_brand", "item_twu_brand", "twu_filtered_supp", "haui_events", "tko_brand", "shuim_events", "incfhm_brand", "hup_tree_events", "text_round_trip_supp", "event_windows", "sql_function_nations"])
def test_same_as_sql(spark, small, duck, name):
    assert rows(catalog.queries()[name](spark, small).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())
