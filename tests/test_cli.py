"""Command line, reports, converters, generator."""

import json

import pytest
from pyspark.sql import functions as F

from utilmine import __main__ as cli
from utilmine import experiment
from utilmine.generate import generate
from utilmine.model import entries_from, to_entries
from utilmine.queries import mine
from utilmine.sources.convert import cleaned, cleaning_report, from_baskets, replicate, write_utility_text
from utilmine.sources.utility_text import diff, read_results, read_utility_text

LINES = "1 2:40:20 20\n1 3:60:30 30\n2 3:50:25 25\n"


@pytest.fixture
def dataset(tmp_path):
    (tmp_path / "db.txt").write_text(LINES)
    return str(tmp_path / "db.txt")


@pytest.mark.parametrize("arguments", [["fhm", "45"], ["fhm+", "45", "--min-length", "2", "--max-length", "2"], ["tko", "1", "--top-k", "2"], ["shuim", "45", "--window", "2"], ["incfhm", "45", "--batches", "2"], ["huim-mmu", "45", "--beta", "0.1"], ["hup-miner", "45", "--partitions", "3"], ["huim-ga", "45", "--seed", "1", "--iterations", "20", "--population", "5"]])
def test_command_line(spark, tmp_path, dataset, arguments):
    out = str(tmp_path / "out")
    cli.main([dataset, *arguments, "--malformed", "fail"][:1] + arguments[:2] + [out] + arguments[2:])
    got = {tuple(r["itemset"]): r["utility"] for r in read_results(spark, out).collect()}
    every = {(1,): 50, (2,): 45, (3,): 55, (1, 3): 60, (2, 3): 50}
    expected = {"fhm+": {(1, 3): 60, (2, 3): 50}, "tko": {(1, 3): 60, (3,): 55}}.get(arguments[0], every)
    assert got == expected if arguments[0] not in ("shuim", "huim-ga") else got.items() <= {(1,): 50, (2,): 45, (3,): 55, (1, 3): 60, (2, 3): 50}.items()


def test_options_that_a_strategy_does_not_know(dataset):
    for arguments in (["fhm", "1", "o", "--window", "3"], ["efim", "1", "o", "--top-k", "3"], ["nothing", "1", "o"]):
        with pytest.raises(SystemExit):
            cli.options_of(cli.parser().parse_args([dataset, *arguments]))


def test_reports(spark, tmp_path, dataset):
    report = str(tmp_path / "report")
    cli.main([dataset, "fhm", "45", str(tmp_path / "out"), "--report", report, "--compare", "efim,ihup"])
    rows = [json.loads(x.value) for x in spark.read.text(report).collect()]
    assert {(r["algorithm"], r["itemsets"], r["mismatches"], r["exact"]) for r in rows} == {("efim", 5, 0, True), ("ihup", 5, 0, True)}
    entries = to_entries(read_utility_text(spark, dataset))
    found = experiment.run(entries, ["fhm"], 45)
    assert found.first()["exact"] is None
    experiment.report(found, report + "-csv", "csv")
    assert spark.read.option("header", True).csv(report + "-csv").first()["algorithm"] == "fhm"
    experiment.report(found, "", "console")
    with pytest.raises(ValueError):
        experiment.report(found, "", "xml")
    swept = experiment.sweep(entries, "fhm", [45, 55], [2, 3]).collect()
    assert {(r["min_utility"], r["partitions"], r["itemsets"], r["exact"]) for r in swept} == {(45, 2, 5, True), (45, 3, 5, True), (55, 2, 2, True), (55, 3, 2, True)}


def test_converters(spark, tmp_path, dataset):
    baskets = from_baskets(spark.createDataFrame([("1 2, 2",), ("",), ("x 3",)], "value string"), utility=2)
    assert sorted(tuple(r)[1:] for r in baskets.select("tid", "item", "u", "tu").collect()) == [(1, 2, 6), (2, 4, 6), (3, 2, 2)]
    entries = to_entries(read_utility_text(spark, dataset))
    # n times the database at n times the threshold: the same itemsets, n times the utility
    once, thrice = mine(entries, "fhm", 45), mine(replicate(entries, 3), "fhm", 135)
    assert diff(once.withColumn("utility", F.col("utility") * 3), thrice).count() == 0
    odd = spark.createDataFrame([(1, 1, 0, 9), (1, 2, 5, 9), (2, 1, 0, 0), (3, 1, 4, 4)], "tid long, item long, u long, tu long")
    assert sorted(map(tuple, cleaned(odd).select("tid", "item", "u", "tu").collect())) == [(1, 2, 5, 5), (3, 1, 4, 4)]
    assert tuple(cleaning_report(odd).first()) == (1, 2, 0)
    write_utility_text(entries, str(tmp_path / "text"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "text")).collect()) == LINES.split()[:0] + sorted(LINES.strip().split("\n"))


def test_generator_is_seeded_and_skewed(spark):
    a, b = (sorted(map(tuple, generate(spark, 300, 50, 8, seed=s).select("tid", "item", "u", "tu").collect())) for s in (1, 1))
    assert a == b and a != sorted(map(tuple, generate(spark, 300, 50, 8, seed=2).select("tid", "item", "u", "tu").collect()))
    assert all(1 <= i <= 50 and 1 <= u <= 20 for _, i, u, _ in a) and sum(i <= 10 for _, i, _, _ in a) > len(a) / 3


def test_negative_utilities_are_refused(spark):
    bad = entries_from(spark.createDataFrame([(0, 1, 5), (0, 2, -1)], "tid long, item long, utility long"))
    with pytest.raises(Exception, match="negative"):
        mine(bad, "fhm", 1).collect()


@pytest.mark.parametrize("transactions,items,length,share", [(200, 12, 6, 20), (80, 6, 6, 8), (150, 60, 4, 100)])
@pytest.mark.parametrize("algorithm", ["fhm", "efim", "up-growth+", "hup-tree", "hup-miner"])
def test_random_databases(spark, transactions, items, length, share, algorithm):
    """Skewed, dense and low-threshold databases against plain enumeration."""
    from itertools import combinations

    entries = generate(spark, transactions, items, length, seed=transactions).cache()
    baskets: dict = {}
    for r in entries.collect():
        baskets.setdefault(r["tid"], {})[r["item"]] = r["u"]
    m = max(1, sum(sum(b.values()) for b in baskets.values()) // share)
    every: dict = {}
    for b in baskets.values():
        for n in range(1, len(b) + 1):
            for x in combinations(sorted(b), n):
                u, s = every.get(x, (0, 0))
                every[x] = (u + sum(b[i] for i in x), s + 1)
    expected = {x: v for x, v in every.items() if v[0] >= m}
    assert expected and {tuple(r["itemset"]): (r["utility"], r["support"]) for r in mine(entries, algorithm, m).collect()} == expected
