"""``python -m utilmine DATASET ALGORITHM MIN_UTILITY OUTPUT``: mine a file in the utility text format.

``--report FILE --report-format json|csv|console`` also compares strategies named by ``--compare`` and reports counts and times.
With ``--stream FOLDER`` the dataset is a folder that files come into: ``incfhm`` reads those that are new since the last call, brings its state in FOLDER
up to date and writes the result of all files so far; ``shuim`` does so for the windows that are full by now.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from utilmine import experiment
from utilmine.model import check, to_entries
from utilmine.plans import cut
from utilmine.queries import ALIASES, STRATEGIES, TOP_K, mine
from utilmine.sources.utility_text import read_utility_text, stream_utility_text, write_results
from utilmine.streaming.state import MiningState

#: Options and the strategies that know them.
OWN = {
    "min_length": ("fhm+",), "max_length": ("fhm+", "huim-ga", "huim-bpso", "mhui-aco"), "window": ("shuim",), "batches": ("incfhm",), "beta": ("huim-mmu",), "partitions": ("hup-miner",),
    "seed": ("huim-ga", "huim-bpso", "mhui-aco"), "iterations": ("huim-ga", "huim-bpso", "mhui-aco"), "population": ("huim-ga", "huim-bpso", "mhui-aco"), "shard_rows": ("huim-ga", "huim-bpso", "mhui-aco"), "k": tuple(sorted(TOP_K)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="utilmine", description=__doc__)
    p.add_argument("dataset"), p.add_argument("algorithm"), p.add_argument("min_utility", type=int), p.add_argument("output")
    p.add_argument("--malformed", choices=("drop", "fail"), default="drop"), p.add_argument("--recompute-tu", action="store_true")
    p.add_argument("--top-k", dest="k", type=int)
    for name in OWN:
        if name != "k":
            p.add_argument("--" + name.replace("_", "-"), type=float if name == "beta" else int)
    p.add_argument("--stream")
    p.add_argument("--report"), p.add_argument("--report-format", choices=experiment.FORMATS, default="json"), p.add_argument("--compare", default="")
    return p


def options_of(a: argparse.Namespace) -> dict:
    """The options that were given; one that the strategy does not know is an error."""
    name = ALIASES.get(a.algorithm, a.algorithm)
    if name not in STRATEGIES:
        raise SystemExit(f"unknown algorithm {a.algorithm}; known are {', '.join(sorted(STRATEGIES))}")
    given = {k: getattr(a, k) for k in OWN if getattr(a, k) is not None}
    if strange := [k for k in given if name not in OWN[k]]:
        raise SystemExit(f"{name} takes no {', '.join(strange)}")
    return given


def follow(spark: SparkSession, a: argparse.Namespace) -> None:
    """Mine what is new in a folder, with state that later calls go on from."""
    more = {"window": a.window} if a.window else {}
    at = {name: f"{a.stream.rstrip('/')}/{name}" for name in ("state", "result", "checkpoint")}
    mine(stream_utility_text(spark, a.dataset), a.algorithm, a.min_utility, **at, **more, available_now=True).awaitTermination()
    if a.algorithm == "incfhm":
        write_results(MiningState(spark, at["state"], a.min_utility).result(), a.output)
    else:
        spark.read.parquet(at["result"]).drop("batch").write.mode("overwrite").parquet(a.output)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    options = options_of(a)
    spark = SparkSession.builder.getOrCreate()
    if a.stream:
        return follow(spark, a)
    rows = read_utility_text(spark, a.dataset, "FAILFAST" if a.malformed == "fail" else "DROPMALFORMED")
    entries = cut(to_entries(rows, a.recompute_tu))
    check(entries)
    found = cut(mine(entries, a.algorithm, a.min_utility, **options))
    write_results(found, a.output)
    if a.report:
        names = [x for x in a.compare.split(",") if x] or [a.algorithm]
        experiment.report(experiment.run(entries, names, a.min_utility, found), a.report, a.report_format)


if __name__ == "__main__":
    main()
