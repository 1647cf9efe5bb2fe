"""Estimated rows of filtered tables and of their joins, for the order in which tables are joined."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame

from quillon.plans.spec import Attr, Cond
from quillon.sources.statistics import TableStatistics

#: Bytes of a column, about, where only the size of a table is known; and at least, where files are well compressed.
COLUMN_BYTES = 8
LEAST_COLUMN_BYTES = 1
#: Bytes of a file for each column besides its values, about: they make up most of the smallest tables.
FILE_COLUMN_BYTES = 600


class Estimate(NamedTuple):
    rows: float
    distinct: Mapping[str, float]  # by column
    unfiltered: float = 0.0  # rows before the table's own conditions, where they are known

    def distinct_of(self, column: str) -> float:
        """Values of a column; where they aren't counted, as many as rows."""
        return max(1.0, min(self.rows, self.distinct.get(column, self.rows)))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _share(c: Cond, estimate: Estimate) -> float:
    """Rows that a condition within a table keeps."""
    if isinstance(c.right, Attr) or c.op not in ("=", "!="):
        return 0.5
    one = 1 / estimate.distinct_of(c.left.column)
    return one if c.op == "=" else 1 - one


def estimates_of(frame: DataFrame, table: str, conditions: Iterable[Cond], statistics: TableStatistics | None, column_bytes: int = COLUMN_BYTES) -> Estimate:
    """frame: the table with its own conditions applied."""
    if statistics is None:
        columns = max(1, len(frame.columns))
        base = Estimate(max(1.0, (estimated_bytes(frame) / columns - FILE_COLUMN_BYTES) / column_bytes), {})
    else:
        base = Estimate(float(statistics.rows), statistics.distinct)
    rows = base.rows
    for c in conditions:
        if c.tables == {table}:
            rows *= _share(c, base)
    return Estimate(max(rows, 1.0), base.distinct, base.rows)


def with_domains(estimates: Mapping[str, Estimate], conditions: Iterable[Cond]) -> dict[str, Estimate]:
    """Counts for the columns without one that equalities link to others: the least values that any of the linked has.

    A nation's key has no more values among customers or suppliers than there are nations, which says how many of each
    other they meet.
    """
    linked: list[set[Attr]] = []
    for c in conditions:
        if len(c.tables) == 2 and c.op == "=":
            met = [s for s in linked if c.left in s or c.right in s]
            linked = [s for s in linked if s not in met] + [{c.left, c.right}.union(*met)]
    counts = {t: dict(e.distinct) for t, e in estimates.items()}
    for columns in linked:
        least = min(estimates[a.table].distinct.get(a.column, estimates[a.table].unfiltered or estimates[a.table].rows) for a in columns)
        for a in columns:
            counts[a.table].setdefault(a.column, least)
    return {t: e._replace(distinct=counts[t]) for t, e in estimates.items()}


def joined_rows(rows: float, within: Collection[str], following: str, conditions: Iterable[Cond], estimates: Mapping[str, Estimate]) -> float:
    """Rows of the join of what is joined already, so many rows of the tables within, with a further table."""
    rows *= estimates[following].rows
    for c in conditions:
        if len(c.tables) == 2 and following in c.tables and c.tables <= {*within, following}:
            values = max(estimates[a.table].distinct_of(a.column) for a in (c.left, c.right))
            rows *= 1 / values if c.op == "=" else 1 - 1 / values if c.op == "!=" else 0.5
    return max(rows, 1.0)
