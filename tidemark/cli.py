"""Command line: ``python -m tidemark.cli run NAME --data DIR``, ``checks``, ``panel``, ``walkforward``, ``synthetic``, ``stability``, ``list``."""

from __future__ import annotations

import argparse
import sys

from tidemark.plans import catalogue, checks
from tidemark.session import build_session
from tidemark.sources import market, readers


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    parts = parser.add_subparsers(dest="command", required=True)
    parts.add_parser("list", help="names of all queries")
    texts = {
        "run": "run a query and show it",
        "checks": "data checks; fails if any finds a row",
        "walkforward": "summary of all members",
        "synthetic": "scores of the detectors on generated paths",
        "stability": "agreement of the gates of successive refits",
    }
    for name, text in texts.items():
        sub = parts.add_parser(name, help=text)
        if name == "run":
            sub.add_argument("name", choices=sorted(catalogue.QUERIES))
        sub.add_argument("--data", required=name != "synthetic")
        sub.add_argument("--out")
    sub = parts.add_parser("panel", help="build the panel from landed files")
    sub.add_argument("patterns", nargs="+")
    sub.add_argument("--symbol", required=True)
    sub.add_argument("--out", required=True)
    given = parser.parse_args(args)
    if given.command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
        return 0
    spark = build_session()
    if given.command == "panel":
        readers.write_sorted_parquet(market.build_panel(spark, given.patterns, given.symbol), given.out, "date")
        return 0
    name = {"run": getattr(given, "name", None), "checks": "chk8_report", "walkforward": "orc3_runner", "synthetic": "gen5_path_scores", "stability": "met7_refit_stability"}[given.command]
    rows = catalogue.QUERIES[name](spark, given.data)
    if given.out:
        rows.coalesce(1).write.mode("overwrite").csv(given.out, header=True)
    else:
        rows.show(50, truncate=False)
    return 0 if given.command != "checks" or checks.passed(rows) else 1


if __name__ == "__main__":
    sys.exit(main())
