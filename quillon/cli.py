"""Command line: run a query file, generate or ingest tables, build indexes, sort, dump.

    python -m quillon.cli query  TABLES_DIR QUERY_FILE RESULT_FILE [--join STRATEGY] [--explain]
    python -m quillon.cli generate DEFINITION TARGET ROWS [--seed N]
    python -m quillon.cli ingest DEFINITION TEXT TARGET [--blanks]
    python -m quillon.cli index  TABLE TARGET KEY [KEY ...]
    python -m quillon.cli sort   TABLE TARGET KEY [KEY ...] [--desc]
    python -m quillon.cli dump   TABLE [--rows N]
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from quillon.plans.dialect import parse
from quillon.session import Engine
from quillon.sources import definitions, generate, indexes, statistics, text
from quillon.sources.catalog import Catalog
from quillon.sources.storage import read_text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        return c

    q = command("query", "tables", "query", "result")
    q.add_argument("--join", default="auto")
    q.add_argument("--explain", action="store_true")
    g = command("generate", "definition", "target")
    g.add_argument("rows", type=int)
    g.add_argument("--seed", type=int, default=0)
    command("ingest", "definition", "text", "target").add_argument("--blanks", action="store_true", help="values are parted by any white space")
    command("index", "table", "target").add_argument("keys", nargs="+")
    s = command("sort", "table", "target")
    s.add_argument("keys", nargs="+")
    s.add_argument("--desc", action="store_true")
    command("dump", "table").add_argument("--rows", type=int, default=100)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "query":
        query = Path(a.query).read_text(encoding="utf-8")
        engine = Engine(spark, Catalog.of_folder(spark, a.tables, parse(query).tables))
        if a.explain:
            print(engine.explain(query, join_strategy=a.join))
            print("Expected cost:", engine.cost(query).size_in_bytes, "bytes")
        done = engine.run(query, a.result, a.join)
        print(f"{done.rows} rows. Execution time = {done.seconds:.3f}")
    elif a.command == "generate":
        df = generate.generate(spark, definitions.parse_definition(read_text(spark, a.definition)), a.rows, a.seed)
        df.write.parquet(a.target)
        statistics.table_statistics(spark.read.parquet(a.target)).show(truncate=False)
    elif a.command == "ingest":
        text.ingest(spark, a.text, definitions.parse_definition(read_text(spark, a.definition)), a.target, a.blanks)
    elif a.command == "index":
        indexes.build_sorted(spark.read.parquet(a.table), a.keys, a.target)
    elif a.command == "sort":
        indexes.sort_table(spark.read.parquet(a.table), a.keys, a.target, not a.desc)
    else:
        for row in text.dump_lines(spark.read.parquet(a.table)).limit(a.rows).toLocalIterator():
            print(row.line)


if __name__ == "__main__":
    main()
