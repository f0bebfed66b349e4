"""Text format, result files, comparison, statistics, streaming and the SQL function."""

import pytest
from pyspark.sql import functions as F

from utilmine import sql
from utilmine.model import entries_from, to_entries, to_transactions
from utilmine.operators.prep import dataset_stats
from utilmine.queries import mine
from utilmine.sources.utility_text import diff, read_results, read_utility_text, write_results
from utilmine.streaming import closed_windows, current, incremental


def written(tmp_path, text):
    path = tmp_path / "db.txt"
    path.write_text(text)
    return str(path)


def test_reader(spark, tmp_path):
    path = written(tmp_path, "# c\n@CONVERTED\n\n%x\n1 3 5:100:30 10 60\n5 3 5:40:10 20 10\n1 2:10:5\n-1:3:3\n:0:\n9:7:7\n")
    rows = [(r["tid"], r["tu"], [(x["item"], x["utility"]) for x in r["items"]]) for r in read_utility_text(spark, path).orderBy("tid").collect()]
    assert [(tu, items) for _, tu, items in rows] == [(100, [(1, 30), (3, 10), (5, 60)]), (40, [(5, 20), (3, 20)]), (0, []), (7, [(9, 7)])]
    assert [t for t, _, _ in rows] == sorted(t for t, _, _ in rows)
    with pytest.raises(Exception, match="malformed"):
        read_utility_text(spark, path, "FAILFAST").count()
    assert read_utility_text(spark, written(tmp_path, "")).count() == 0


def test_results_round_trip_and_diff(spark, tmp_path):
    e = entries_from(spark.createDataFrame([(0, 1, 20), (0, 2, 20), (1, 1, 30), (1, 3, 30)], "tid long, item long, utility long"))
    found = mine(e, "fhm", 40)
    write_results(found, str(tmp_path / "out"))
    again = read_results(spark, str(tmp_path / "out"))
    assert diff(found, again).count() == 0
    changed = again.withColumn("utility", F.col("utility") + 1)
    assert {r["status"] for r in diff(found, changed).collect()} == {"utility"}
    assert {r["status"] for r in diff(found, again.where("false")).collect()} == {"missing"}


def test_forms_and_statistics(spark):
    e = entries_from(spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 1), (1, 2, 4), (None, 1, 1)], "tid long, item long, utility long"))
    back = to_entries(to_transactions(e))
    assert sorted(map(tuple, back.select("tid", "item", "u", "tu").collect())) == [(0, 1, 5, 6), (0, 2, 1, 6), (1, 2, 4, 4)]
    s = dataset_stats(e).first()
    assert (s["n_tx"], s["n_items"], s["max_length"], s["total_utility"]) == (2, 2, 2, 10)


def test_sql_function(spark):
    sql.register(spark)
    spark.createDataFrame([(0, 1, 20), (0, 2, 20), (1, 1, 30), (1, 3, 30), (2, 2, 25), (2, 3, 25)], "tid long, item long, u long").createOrReplaceTempView("sales")
    found = spark.sql("SELECT * FROM mine_utility(TABLE(sales) WITH SINGLE PARTITION, 45)").collect()
    assert {tuple(r["itemset"]): r["utility"] for r in found} == {(1,): 50, (2,): 45, (3,): 55, (1, 3): 60, (2, 3): 50}


def test_incremental_stream(spark, tmp_path):
    rows = [(0, 1, 20), (0, 2, 20), (1, 1, 30), (1, 3, 30), (2, 2, 25), (2, 3, 25)]
    source = tmp_path / "in"
    for k in (0, 1):
        spark.createDataFrame([r for r in rows if (r[0] > 0) == k], "tid long, item long, utility long").coalesce(1).write.parquet(str(source / f"p{k}"))
    stream = spark.readStream.schema("tid long, item long, utility long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    query = incremental(stream, str(tmp_path / "state"), str(tmp_path / "result"), 45, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    found = {tuple(r["itemset"]): r["utility"] for r in current(spark, str(tmp_path / "result")).collect()}
    assert found == {(1,): 50, (2,): 45, (3,): 55, (1, 3): 60, (2, 3): 50}


def test_event_time_windows(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", 1, 1, 20), ("2024-01-01 00:00:20", 1, 2, 20), ("2024-01-01 00:01:10", 1, 1, 50), ("2024-01-01 01:00:00", 9, 9, 1)]
    spark.createDataFrame(rows, "ts string, user long, item long, value long").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, user long, item long, value long").parquet(str(tmp_path / "ev"))
    got = []
    query = closed_windows(stream, "ts", "user", "item", "value", "1 minute", "10 seconds", lambda df, n: got.extend((str(r["window_start"]), tuple(r["itemset"]), r["utility"]) for r in df.collect()), str(tmp_path / "cp"), min_utility=40)
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [("2024-01-01 00:00:00", (1, 2), 40), ("2024-01-01 00:01:00", (1,), 50)]
