"""From an analyzed QuerySpec to a lazy DataFrame: scan, filter, join, then aggregate or project, distinct, sort."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import joins
from quillon.operators import relational as R
from quillon.plans.estimates import COLUMN_BYTES, LEAST_COLUMN_BYTES, Estimate, estimates_of, with_domains
from quillon.plans.spec import QuerySpec
from quillon.sources.statistics import TableStatistics


def plan(spec: QuerySpec, tables: Mapping[str, DataFrame], strategy: str = "auto", statistics: Mapping[str, TableStatistics] | None = None) -> DataFrame:
    """statistics: of some tables; the order of joins is chosen by them, and by Catalyst's sizes of the others."""
    frames = {t: R.select_rows(R.scan(tables[t], t), [c for c in spec.where if c.tables == {t}]) for t in spec.tables}
    between = [c for c in spec.where if len(c.tables) == 2]

    def estimates(column_bytes: int) -> dict[str, Estimate]:
        return with_domains({t: estimates_of(frames[t], t, spec.where, (statistics or {}).get(t), column_bytes) for t in spec.tables}, between)

    likely = estimates(COLUMN_BYTES) if len(spec.tables) > 2 else None
    most = estimates(LEAST_COLUMN_BYTES) if strategy in joins.LOOPS else None
    rows = joins.join_tables(frames, spec.tables, between, strategy, likely, most)
    if not spec.aggregated and not spec.distinct:
        if spec.order_by:
            rows = R.sort(rows, [R.column(a) for a in spec.order_by], spec.ascending)
        return R.project(rows, spec.select)
    if spec.group_by:
        rows = R.aggregate_groups(rows, spec.group_by, spec.select)
    elif spec.aggregated:
        rows = R.aggregate_all(rows, spec.select)
    else:
        rows = R.project(rows, spec.select)
    output = [a.output for a in spec.select]
    if spec.distinct:
        rows = R.distinct(rows.select(*output))
    if spec.order_by:
        rows = R.sort(rows, [F.col(a.output) for a in spec.order_by], spec.ascending)
    return rows.select(*output)
