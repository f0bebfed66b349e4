"""Kept state, count windows and text streams against enumeration of all rows so far."""

import random

import pytest

from test_mining import as_dict, database, entries, enumerate_all
from utilmine.__main__ import main
from utilmine.queries import mine
from utilmine.sources.utility_text import read_results, stream_utility_text
from utilmine.streaming import last_window
from utilmine.streaming.state import MiningState


def test_state_after_every_batch(spark, tmp_path):
    """The same as mining everything again, after each batch, after a retry and after compaction; old rows are read only where itemsets are opened."""
    r = random.Random(21)
    batches = [database(30 + b, r.choice([4, 15, 25]), 8, 4) for b in range(4)]
    m, seen, read = 60, [], []
    state = MiningState(spark, str(tmp_path / "state"), m)
    for number, rows in enumerate(batches):
        new = entries(spark, rows)
        report, counts = state.apply(new, number)
        if number == 2:  # as after a failure
            report, counts = state.apply(new, number)
        report = as_dict(report)
        before, seen = enumerate_all(seen), [*seen, *rows]
        want = {c: v for c, v in enumerate_all(seen).items() if v[0] >= m}
        assert as_dict(state.result()) == want
        touched = enumerate_all(rows)
        assert report == {c: v for c, v in want.items() if c in touched}
        read.append((counts["new"], counts["read_again"], len(before)))
        if number == 2:
            state = state.compact(str(tmp_path / "compacted"), number + 1)
            assert as_dict(state.result()) == want
    assert [n for n, *_ in read] == [len(b) for b in batches]


def test_untouched_lists_are_not_read(spark, tmp_path):
    """A batch that opens nothing reads no old transaction, however many there are."""
    state = MiningState(spark, str(tmp_path / "state"), 1000)
    _, first = state.apply(entries(spark, [{1: 1, 2: 1, 3: 1}] * 200), 0)
    report, second = state.apply(entries(spark, [{2: 5, 3: 5}]), 1)
    assert first["read_again"] == second["read_again"] == 0 and report.count() == 0
    report, third = state.apply(entries(spark, [{3: 790}]), 2)  # item 3 had 205, so its list of 201 rows is opened, and nothing else
    assert third["read_again"] == 0 and report.count() == 0
    report, fourth = state.apply(entries(spark, [{3: 5}]), 3)
    assert as_dict(report) == {(3,): (1000, 203)} and fourth["read_again"] == 202
    report, fifth = state.apply(entries(spark, [{3: 5}]), 4)
    assert as_dict(report) == {(3,): (1005, 204)} and fifth["read_again"] == 0


def test_empty_batches(spark, tmp_path):
    state = MiningState(spark, str(tmp_path / "state"), 5)
    report, counts = state.apply(entries(spark, [{1: 1}]).where("false"), 0)
    assert report.count() == 0 and counts == {"new": 0, "read_again": 0} and state.result().count() == 0
    report, _ = state.apply(entries(spark, [{1: 6}]), 1)
    assert as_dict(report) == as_dict(state.result()) == {(1,): (6, 1)}


def text_of(rows):
    return "".join(f"{' '.join(map(str, x))}:{sum(x.values())}:{' '.join(map(str, x.values()))}\n" for x in rows)


def test_count_windows_over_restarts(spark, tmp_path):
    """Files come one by one, the query is stopped and started again in between: the windows are those of all rows at once."""
    rows, window, m = database(7, 23, 8, 4), 10, 25
    edges = [0, 4, 13, 14, 23]
    found = {}
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part{k}.txt").write_text("# header\n" + text_of(rows[a:b]))
        query = mine(stream_utility_text(spark, str(tmp_path / "in"), 1), "shuim", m, window=window, state=str(tmp_path / "state"), result=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), available_now=True)
        query.awaitTermination()
        assert query.exception() is None
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        assert found.setdefault((r["window_id"], tuple(r["itemset"])), (r["utility"], r["support"])) and r["length"] == len(r["itemset"])
    tail = {(r["window_id"], tuple(r["itemset"])): (r["utility"], r["support"]) for r in last_window(spark, str(tmp_path / "state"), 4, m, window).collect()}
    full = (len(rows) - window) // 5 + 1
    want = {}
    for k in range(full + 1):
        part = rows[5 * k : 5 * k + window] if k < full else rows[5 * k :]
        want |= {(k, c): v for c, v in enumerate_all(part).items() if v[0] >= m}
    assert found | tail == want and not set(found) & set(tail)


def test_folder_of_text_files(spark, tmp_path):
    """The command line follows a folder; malformed lines and comments count for nothing."""
    rows, m = database(5, 18, 7, 4), 30
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text("% comment\n" + text_of(rows[9 * k : 9 * k + 9]) + "1 2:x:3\n")
        main([str(tmp_path / "in"), "incfhm", str(m), str(tmp_path / "result"), "--stream", str(tmp_path / "kept")])
        got = {tuple(r["itemset"]): r["utility"] for r in read_results(spark, str(tmp_path / "result")).collect()}
        assert got == {c: v[0] for c, v in enumerate_all(rows[: 9 * k + 9]).items() if v[0] >= m}


def test_strategies_without_a_stream_form(spark, tmp_path):
    stream = spark.readStream.schema("tid long, item long, utility long").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        mine(stream, "efim", 1, state="", result="", checkpoint="")
