"""The tables a session can query, by name: opened when a query first uses them, with their copies and statistics."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.plans.spec import QueryError
from quillon.sources.statistics import TableStatistics


class Catalog:
    """Tables by name, their statistics, and their sorted or bucketed copies by table and key."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._sources: dict[str, tuple[str, T.StructType | None]] = {}
        self._tables: dict[str, DataFrame] = {}
        self._statistics: dict[str, TableStatistics] = {}
        self._indexes: dict[tuple[str, str], DataFrame] = {}

    def add(self, name: str, source: str | DataFrame, schema: T.StructType | None = None) -> None:
        """source: a Parquet path or a frame; schema: the declared one, of a path, whose files are then not read for theirs."""
        self._tables.pop(name, None)
        if isinstance(source, DataFrame):
            self._tables[name] = source
        else:
            self._sources[name] = source, schema

    def add_statistics(self, table: str, statistics: TableStatistics) -> None:
        """Counts that the order of joins is chosen by."""
        self._statistics[table] = statistics

    def statistics(self, table: str) -> TableStatistics | None:
        return self._statistics.get(table)

    def add_index(self, table: str, key: str, source: str | DataFrame) -> None:
        """A sorted or bucketed copy of the table that joins and filters on key may read instead."""
        copy = source if isinstance(source, DataFrame) else self.spark.read.parquet(source)
        if set(copy.columns) != set(self.table(table).columns):
            raise QueryError(f"the copy doesn't have the columns of {table}")
        self._indexes[table, key] = copy.select(*self.table(table).columns)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name not in self._sources:
                raise QueryError(f"no table {name}")
            path, schema = self._sources[name]
            self._tables[name] = (self.spark.read if schema is None else self.spark.read.schema(schema)).parquet(path)
        return self._tables[name]

    def index(self, table: str, key: str) -> DataFrame | None:
        return self._indexes.get((table, key))

    def schemas(self, names: Iterable[str]) -> Mapping[str, T.StructType]:
        """Of those of the names that are tables."""
        return {name: self.table(name).schema for name in names if name in self._tables or name in self._sources}

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: tuple[str, ...]) -> Catalog:
        """Tables stored as ``<folder>/<name>.parquet``; each is opened when it is first used."""
        catalog = cls(spark)
        for name in names:
            catalog.add(name, f"{folder}/{name}.parquet")
        return catalog
