"""python -m plumbline.cli --dataset FILE --use-cases FILE --definitions FILE[,FILE] [--use-case ID]: exit codes 0, 1 (a run that failed), 2 (usage)."""

from __future__ import annotations

import argparse
import sys

from plumbline.model import PlumblineError
from plumbline.sources import config, names, strict_bool, threads


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    p.add_argument("--dataset", required=True)
    p.add_argument("--use-cases")
    p.add_argument("--use-case")
    p.add_argument("--definitions")
    p.add_argument("--packages")
    p.add_argument("--reports")
    p.add_argument("--threads", type=threads)
    p.add_argument("--dedup", type=strict_bool)
    p.add_argument("--settings")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 2
    from pyspark.sql import SparkSession

    from plumbline.api import prepare, run
    from plumbline.reports import write_reports
    from plumbline.sources import read_settings

    try:
        builder = SparkSession.builder.appName("plumbline")
        if args.threads:
            builder = builder.master(f"local[{args.threads}]")
        spark = builder.getOrCreate()
        given = {k: v for k, v in vars(args).items() if isinstance(v, str) and k in ("use_cases", "definitions", "packages", "reports")}
        c = config(given | ({"dedup": str(args.dedup).lower()} if args.dedup is not None else {}), spark)
        prepared = prepare(spark, args.dataset, names(c["definitions"]), c["use_cases"] or None, args.use_case, names(c["packages"]))
        if args.settings:
            prepared = prepared.with_parameters(read_settings(args.settings))
        done = run(prepared, strict_bool(c["dedup"]))
        write_reports(done, c["reports"])
        print(f"plumbline completed: {done.responses.count()} outcomes")
        return 0
    except (PlumblineError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
