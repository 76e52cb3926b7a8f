"""python -m codelake scan|extract|run|ops ..."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="codelake")
    sub = p.add_subparsers(dest="do", required=True)
    s = sub.add_parser("scan", help="items of a source tree")
    s.add_argument("path")
    s.add_argument("--language")
    s.add_argument("--type")
    e = sub.add_parser("extract", help="write the blocks of a source tree to a folder")
    e.add_argument("path")
    e.add_argument("out")
    e.add_argument("--target")
    e.add_argument("--pattern")
    e.add_argument("--as-of", required=True)
    r = sub.add_parser("run", help="one query over stored tables")
    r.add_argument("name")
    r.add_argument("folder")
    sub.add_parser("ops", help="the catalogue of queries")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from codelake.engine import Engine, Scan
    from codelake.plans import catalogue
    from codelake.registry import describe

    spark = SparkSession.builder.appName("codelake").getOrCreate()
    engine = Engine(spark)
    if a.do == "scan":
        items = engine.scan(a.path).blocks
        if a.language:
            items = items.filter(F.col("language") == a.language)
        if a.type:
            items = items.filter(F.col("block_type") == a.type)
        items.select("language", "block_type", "qualified_name", "file_path", "line_number").orderBy("ordinal").show(1000, truncate=False)
    elif a.do == "extract":
        got = Scan(spark, engine.select(engine.scan(a.path), a.target, a.pattern)).export(a.out, a.as_of)
        print(f"{got.count()} files in {a.out}")
    elif a.do == "run":
        catalogue.QUERIES[a.name](spark, a.folder).show(100, truncate=False)
    else:
        describe(spark).orderBy("category", "name").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
