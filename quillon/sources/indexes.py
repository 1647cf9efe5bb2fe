"""Sorted and bucketed copies of tables, which Spark uses where other engines keep an index.

A sorted copy is range-partitioned and sorted by its keys, so min-max statistics prune files and row groups for
point and range lookups. Two bucketed copies with equal buckets join on the key without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.comparisons import compare_literal
from quillon.plans.estimates import estimated_bytes
from quillon.plans.spec import QueryError

#: Bytes of a file of a copy, about, where its number of files isn't given.
FILE_BYTES = 128 << 20


def build_sorted(df: DataFrame, keys: Sequence[str], path: str, files: int | None = None) -> DataFrame:
    """files: of the copy; by default one for each shuffle partition of the session."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def build_bucketed(df: DataFrame, keys: Sequence[str], name: str, buckets: int, path: str | None = None) -> DataFrame:
    """A registered table; path: where its files go, instead of the warehouse. One task a bucket writes, so there are as many files."""
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def search(index: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key."""
    return index.filter(compare_literal(F.col(f"`{key}`"), "=", value, index.schema[key].dataType))


def search_range(index: DataFrame, key: str, low=None, high=None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    """The rows between two keys, of which either may be absent."""
    kind = index.schema[key].dataType
    if low is not None:
        index = index.filter(compare_literal(F.col(f"`{key}`"), ">=" if low_inclusive else ">", low, kind))
    if high is not None:
        index = index.filter(compare_literal(F.col(f"`{key}`"), "<=" if high_inclusive else "<", high, kind))
    return index


def first_key(index: DataFrame, key: str):
    return index.agg(F.min(f"`{key}`")).first()[0]


def last_key(index: DataFrame, key: str):
    return index.agg(F.max(f"`{key}`")).first()[0]


def insert(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Rows added to a sorted copy as files of their own, sorted too, each of a range of keys; pruning works by file."""
    if rows.columns != spark.read.parquet(path).columns:
        raise QueryError("the rows don't have the columns of the index")
    files = min(1 + estimated_bytes(rows) // FILE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))  # an unknown size counts as large
    rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("append").parquet(path)


def delete(index: DataFrame, key: str, value, path: str, keys: Sequence[str]) -> DataFrame:
    """A new copy at path without the rows of one key."""
    kept = index.filter(compare_literal(F.col(f"`{key}`"), "!=", value, index.schema[key].dataType))
    return build_sorted(kept, keys, path)


def sort_table(df: DataFrame, keys: Sequence[str], path: str, ascending: bool = True) -> DataFrame:
    """The table sorted as a whole: its files, in the order of their names, hold the rows in order."""
    df.orderBy(*(F.col(f"`{k}`").asc() if ascending else F.col(f"`{k}`").desc() for k in keys)).write.parquet(path)
    return df.sparkSession.read.parquet(path)
