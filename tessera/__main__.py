"""python -m tessera list | run QUERY --data DIR [--out PATH] [--rows N]"""

from __future__ import annotations

import argparse

from . import plans


def main() -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(plans.queries()))
    run.add_argument("--data", required=True)
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    args = parser.parse_args()
    if args.command == "list":
        print("\n".join(sorted(plans.queries())))
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    result = plans.queries()[args.query](spark, args.data)
    if args.out:
        result.write.parquet(args.out)
    else:
        result.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
