"""What a parsed query says. Nothing here needs Spark."""

from __future__ import annotations

from dataclasses import dataclass

COMPARISONS = ("<", ">", "<=", ">=", "!=", "=")
AGGREGATES = ("MAX", "MIN", "SUM", "COUNT", "AVG")


class QueryError(ValueError):
    """The text isn't a query, or the query doesn't fit the tables."""


@dataclass(frozen=True)
class Attr:
    """A column of a table, or an aggregate of one."""

    table: str
    column: str
    aggregate: str | None = None

    @property
    def base(self) -> Attr:
        return Attr(self.table, self.column)

    @property
    def label(self) -> str:
        """As result headers print it: T.c or MAX(T.c)."""
        plain = f"{self.table}.{self.column}"
        return f"{self.aggregate}({plain})" if self.aggregate else plain

    @property
    def output(self) -> str:
        """The name of the result column: T_c or max_T_c."""
        plain = f"{self.table}_{self.column}"
        return f"{self.aggregate.lower()}_{plain}" if self.aggregate else plain


@dataclass(frozen=True)
class Cond:
    """left op right; right is an attribute, the text of a literal, or after analysis its value."""

    left: Attr
    op: str
    right: Attr | str | int | float

    @property
    def tables(self) -> frozenset[str]:
        return frozenset({self.left.table} | ({self.right.table} if isinstance(self.right, Attr) else set()))


@dataclass(frozen=True)
class QuerySpec:
    """An empty select list means all columns; conditions all hold."""

    select: tuple[Attr, ...]
    tables: tuple[str, ...]
    where: tuple[Cond, ...] = ()
    group_by: tuple[Attr, ...] = ()
    order_by: tuple[Attr, ...] = ()
    ascending: bool = True
    distinct: bool = False

    @property
    def aggregated(self) -> bool:
        return bool(self.group_by) or any(a.aggregate for a in self.select)
