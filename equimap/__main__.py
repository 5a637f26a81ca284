"""python -m equimap list | run QUERY... --data DIR --out DIR: runs queries of the catalogue and writes their rows."""

from __future__ import annotations

import argparse
import sys


def main(args: list[str]) -> int:
    from .plans import catalog

    p = argparse.ArgumentParser(prog="equimap", description=__doc__)
    p.add_argument("action", choices=["list", "run"])
    p.add_argument("queries", nargs="*")
    p.add_argument("--data", help="folder of the tables")
    p.add_argument("--out", help="folder of the results")
    p.add_argument("--format", default="parquet", choices=["parquet", "json", "orc"])
    a = p.parse_args(args)
    if a.action == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    unknown = [q for q in a.queries if q not in catalog.QUERIES]
    if unknown or not a.queries or not a.data or not a.out:
        p.error(f"unknown queries: {unknown}" if unknown else "queries, --data and --out are needed")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("equimap").getOrCreate()
    for q in a.queries:
        catalog.QUERIES[q](spark, a.data).write.mode("overwrite").format(a.format).save(f"{a.out}/{q}")
        print(q, spark.read.format(a.format).load(f"{a.out}/{q}").count())
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
