"""A session: query text in, DataFrame out."""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import explain as explaining
from quillon.plans.analyzer import analyze
from quillon.plans.dialect import parse
from quillon.plans.planner import plan
from quillon.plans.spec import Attr, QuerySpec
from quillon.sources import text as texts
from quillon.sources.catalog import Catalog

#: What cost-based join ordering needs; it has an effect on registered tables with statistics only.
COST_BASED = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"}


class Run(NamedTuple):
    rows: int
    seconds: float


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark)

    def analyze(self, query: str) -> QuerySpec:
        spec = parse(query)
        return analyze(spec, self.catalog.schemas(spec.tables))

    def sql(self, query: str, join_strategy: str = "auto") -> DataFrame:
        """The query as a lazy DataFrame; join_strategy: auto, nested, block, index, merge, hash or broadcast."""
        spec = self.analyze(query)
        tables = {t: self._copy(spec, t) if join_strategy == "index" else self.catalog.table(t) for t in spec.tables}
        return plan(spec, tables, join_strategy, {t: s for t in spec.tables if (s := self.catalog.statistics(t)) is not None})

    def _copy(self, spec: QuerySpec, table: str) -> DataFrame:
        """The copy of a table that is sorted by a column it is joined or filtered on, if there is one."""
        sides = [(a, c) for c in spec.where for a in (c.left, c.right) if isinstance(a, Attr) and a.table == table]
        for a, _ in sorted(sides, key=lambda x: not isinstance(x[1].right, Attr)):
            found = self.catalog.index(table, a.column)
            if found is not None:
                return found
        return self.catalog.table(table)

    def explain(self, query: str, mode: str = "formatted", join_strategy: str = "auto") -> str:
        return explaining.explain(self.sql(query, join_strategy), mode)

    def cost(self, query: str) -> explaining.Cost:
        return explaining.cost(self.sql(query))

    def run(self, query: str, result_file: str, join_strategy: str = "auto") -> Run:
        """The whole result written to a text file, timed from planning to the last row."""
        began = time.perf_counter()
        rows = texts.write_result_file(self.sql(query, join_strategy), result_file)
        return Run(rows, time.perf_counter() - began)

    def use_cost_based_joins(self) -> None:
        for key, value in COST_BASED.items():
            self.spark.conf.set(key, value)
