"""python -m trellis.plans.cli mine|schemas|search|verify: batches over folders of CSV files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.relation import list_files, read_csv
from . import mining


def _list(kind):
    return lambda s: [kind(x) for x in s.split(",")]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--header", action="store_true", help="files begin with a line of names")
    sub = p.add_subparsers(dest="what", required=True)
    m = sub.add_parser("mine")
    m.add_argument("folder")
    m.add_argument("out")
    m.add_argument("thresholds", type=_list(float))
    m.add_argument("--ranges", type=_list(int), default=[None])
    m.add_argument("--timeouts", type=_list(float), default=[None])
    m.add_argument("--separators-only", action="store_true")
    s = sub.add_parser("schemas")
    s.add_argument("data")
    s.add_argument("folder", help="of .sep files")
    s.add_argument("out")
    s.add_argument("--timeout", type=float)
    q = sub.add_parser("search")
    q.add_argument("folder")
    q.add_argument("out")
    q.add_argument("thresholds", type=_list(float))
    q.add_argument("--timeout", type=float)
    v = sub.add_parser("verify")
    v.add_argument("folder")
    v.add_argument("thresholds", type=_list(float))
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.what == "mine":
        mining.mine_folder(spark, a.folder, a.out, a.thresholds, a.ranges, a.timeouts, not a.separators_only, a.header)
    elif a.what == "schemas":
        mining.enumerate_folder(spark, read_csv(spark, a.data, header=a.header), a.folder, a.out, a.timeout)
    elif a.what == "search":
        mining.search_folder(spark, a.folder, a.out, a.thresholds, a.timeout, a.header)
    else:
        bad = [f"{path} at {e}: {line}" for path in list_files(spark, a.folder, "*.csv") for e in a.thresholds for line in mining.verify(read_csv(spark, path, header=a.header), e)]
        print("\n".join(bad) or "all separators agree")
        return int(bool(bad))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
