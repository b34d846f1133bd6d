"""Command line: profile a collection, print the report, write DDL, DRDL or the JSON plan.

    python -m docrel.cli --from-file docs.jsonl --collection orders --out-ddl orders.sql
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .operators.collect import plan_documents
from .plans import render
from .plans.nesting import STRATEGIES
from .sources.documents import from_table, read_documents, sample


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docrel", description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--from-file", help="JSON lines or JSON array, any path that Spark reads")
    source.add_argument("--from-parquet", help="typed table; its rows become documents")
    p.add_argument("--collection", required=True)
    p.add_argument("--key", default="_id", help="column of a typed table that is the document's key")
    p.add_argument("--sample", type=int, default=0, help="documents to profile; 0 for all")
    p.add_argument("--seed", type=int, default=0, help="of the sample")
    p.add_argument("--schema", default="dbo")
    p.add_argument("--database", default="docs", help="database name in the DRDL")
    p.add_argument("--nesting", choices=list(STRATEGIES), default="deep")
    p.add_argument("--headroom", type=float, default=1.5)
    p.add_argument("--map-min-keys", type=int, default=30)
    p.add_argument("--map-max-fill", type=float, default=0.2)
    p.add_argument("--out-json")
    p.add_argument("--out-ddl")
    p.add_argument("--out-drdl")
    return p


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: no documents. Wrong usage ends with 2."""
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.from_file:
        docs = read_documents(spark, a.from_file)
    else:
        docs = from_table(spark.read.parquet(a.from_parquet).withColumnRenamed(a.key, "_id"), "_id")
    docs = sample(docs, a.sample, "seq", a.seed)
    if docs.isEmpty():
        print("no documents", file=sys.stderr)
        return 1
    plan, profile = plan_documents(docs, a.collection, a.nesting, a.schema, a.map_min_keys, a.map_max_fill, a.headroom)
    print(render.report(plan, profile, a.sample))
    for path, text in ((a.out_json, render.to_json(plan)), (a.out_ddl, render.ddl(plan)), (a.out_drdl, render.drdl(a.database, plan))):
        if path:
            Path(path).write_text(text, encoding="utf-8")
    return 0


if __name__ == "__main__":
    sys.exit(main())
