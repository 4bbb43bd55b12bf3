"""Command line: python -m bookpulse.cli STAGE --options. Each stage reads and writes Parquet."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from bookpulse.plans import stages
from bookpulse.sources import ingest

# Short names of months.
MONTHS = {"11": "202511", "12": "202512"}


def month(text: str) -> str:
    found = MONTHS.get(text, text)
    if len(found) != 6 or not found.isdigit():
        raise ValueError(f"unknown month {text}")
    return found


def _ints(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def _names(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bookpulse")
    subs = top.add_subparsers(dest="stage", required=True)

    def add(name: str, *required: str, **options) -> None:
        p = subs.add_parser(name)
        for r in required:
            p.add_argument(f"--{r.replace('_', '-')}", required=True)
        for o, kind in options.items():
            if kind is bool:
                p.add_argument(f"--{o.replace('_', '-')}", action="store_true")
            else:
                p.add_argument(f"--{o.replace('_', '-')}", type=kind)
        if name != "figures":
            p.add_argument("--force", action="store_true")

    picks = {"factor_columns": _names, "label_columns": _names}
    add("ingest", "sources", "root", months=_names, datasets=_names)
    add("factors", "snapshots", "out", trades=str, window_ms=int)
    add("labels", "source", "out", horizons_ms=_ints, price=str)
    add("panel", "source", "out", **picks)
    add("evaluation", "source", "root", least=int, sweep=_ints, no_auction_filter=bool, **picks)
    add("diagnostics", "panel_path", "timeseries", "root")
    add("robustness", "timeseries", "root")
    add("grouping", "panel_path", "root", least=int, groups=int, **picks)
    add("redundancy", "panel_path", "timeseries", "summary", "root", least=int, **picks)
    add("figures", "reports", "root", plots=bool, core=_names, supplementary=_names)
    return top


def main(argv: list[str] | None = None) -> dict | list:
    args = {k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None}
    name = args.pop("stage")
    spark = SparkSession.builder.appName(f"bookpulse-{name}").getOrCreate()
    if name == "ingest":
        # A JSON file: month -> dataset -> folder of CSV files.
        sources = {month(m): d for m, d in json.load(open(args["sources"], encoding="utf-8")).items()}
        jobs = ingest.plan(sources, args["root"], [month(m) for m in args.get("months", sources)], args.get("datasets"))
        return ingest.run(spark, jobs, args["force"])
    if args.pop("no_auction_filter", False):
        args["filter_auction"] = False
    return getattr(stages, name)(spark, **args)


if __name__ == "__main__":
    print(json.dumps(main(), indent=1))
