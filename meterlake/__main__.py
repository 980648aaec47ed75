"""``python -m meterlake SNAPSHOT [--by agent|model] [--json] [--config FILE]``: a cost report of a snapshot."""

from __future__ import annotations

import argparse

from .config import load
from .operators.logs import enabled
from .operators.reports import cost_report
from .session import session
from .store import load_best


def main() -> None:
    ask = argparse.ArgumentParser(prog="meterlake")
    ask.add_argument("snapshot")
    ask.add_argument("--by", choices=["agent", "model"], default="agent")
    ask.add_argument("--json", action="store_true")
    ask.add_argument("--config", default="")
    given = ask.parse_args()
    spark = session("meterlake")
    rows = enabled(load_best(spark, given.snapshot), load(given.config)["agents"])
    report = cost_report(rows, given.by)
    if given.json:
        print("[" + ",\n".join(report.toJSON().toLocalIterator()) + "]")
    else:
        report.show(1000, truncate=False)


if __name__ == "__main__":
    main()
