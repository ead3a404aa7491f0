"""Command line: compare two folders or files, print a summary, optionally write a bundle.

Exit codes: 0 done, 1 bad arguments, 2 missing input, 3 write refused, 4 the comparison failed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veridelta", description="Compare a candidate with a baseline document.")
    p.add_argument("candidate")
    p.add_argument("baseline")
    p.add_argument("--match", type=float, default=0.75)
    p.add_argument("--low", type=float, default=0.45)
    p.add_argument("--window", type=int, default=2)
    p.add_argument("--first", type=int, default=10, help="records to print")
    p.add_argument("--output")
    p.add_argument("--allow-write", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    try:
        args = build().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    if not 0 <= args.low <= args.match <= 1 or args.window < 0 or args.first < 0:
        print("thresholds must satisfy 0 <= low <= match <= 1; window and first must not be negative", file=sys.stderr)
        return 1
    for path in (args.candidate, args.baseline):
        if not os.path.exists(path):
            print(f"no such file: {path}", file=sys.stderr)
            return 2
    if args.output and not args.allow_write:
        print("--output needs --allow-write", file=sys.stderr)
        return 3
    try:
        return run(args)
    except FileExistsError as e:
        print(f"exists: {e}", file=sys.stderr)
        return 3
    except Exception as e:  # the last resort of a command: say what failed
        print(f"comparison failed: {e}", file=sys.stderr)
        return 4


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from veridelta.plans import compare, report
    from veridelta.sources import files

    spark = SparkSession.builder.getOrCreate()
    sides = [files.as_pages(files.read_documents(spark, path), side, "pair") for path, side in ((args.candidate, "candidate"), (args.baseline, "baseline"))]
    pages, elements = sides[0][0].unionByName(sides[1][0]), sides[0][1].unionByName(sides[1][1])
    found = compare.DocumentComparison(pages, elements, match=args.match, low=args.low, window=args.window).evidence()
    print(json.dumps(report.summary_dict(found), ensure_ascii=False, indent=2))
    for r in found.orderBy("seq").limit(args.first).collect():
        print(f"{r['evidence_id']} [{r['severity']}] {r['message']}")
    if args.output:
        report.write_bundle(found, args.output, {"candidate": args.candidate, "baseline": args.baseline}, True, args.overwrite)
    return 0


if __name__ == "__main__":
    sys.exit(main())
