"""``python -m strictpast.cli --source LEDGER [--output RUNS] [options]``: one prepared run."""

from __future__ import annotations

import sys
from argparse import ArgumentParser
from dataclasses import replace

from pyspark.sql import SparkSession

from strictpast.operators.periods import SplitConfig
from strictpast.plans.pipeline import EtlConfig, prepare

#: Each option: how it is read, and which part of a preparation it sets.
OPTIONS = {
    "--source": (dict(required=True, metavar="LEDGER", help="CSV or Parquet, a file or a folder"), "place"),
    "--output": (dict(default="artifacts/runs", metavar="RUNS", help="folder of all runs"), "place"),
    "--smoke": (dict(action="store_true", help="a fiftieth of the senders, each with all it sent"), "place"),
    "--warmup-days": (dict(type=int, metavar="N", help="days at the start that count as history alone"), "split"),
    "--keep-sparse-tail": (dict(action="store_true", help="last days stay however few rows they hold"), "split"),
}


def parser() -> ArgumentParser:
    out = ArgumentParser(prog="strictpast.cli", description=__doc__)
    for flag, (reading, _) in OPTIONS.items():
        out.add_argument(flag, **reading)
    return out


def split_of(given: dict) -> SplitConfig:
    """The default split with what the command line says."""
    changes = {}
    if given["warmup_days"] is not None:
        changes["warmup_units"] = given["warmup_days"]
    if given["keep_sparse_tail"]:
        changes["tail_min_share"] = None
    return replace(SplitConfig(), **changes)


def main(argv: list[str] | None = None) -> str:
    given = vars(parser().parse_args(argv))
    spark = SparkSession.builder.appName("strictpast").getOrCreate()
    run = prepare(spark, given["source"], given["output"], sample=given["smoke"], config=EtlConfig(split=split_of(given)))
    sys.stdout.write(f"{run}\n")
    return run


if __name__ == "__main__":
    main()
