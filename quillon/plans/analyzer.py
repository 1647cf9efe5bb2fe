"""Checks a QuerySpec against the tables' schemas and gives its literals the types of their columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import types as T

from quillon.plans.spec import Attr, Cond, QueryError, QuerySpec

_INTEGER = re.compile(r"[+-]?[0-9]+")
_REAL = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*")
_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def family(data_type: T.DataType) -> str:
    """INTEGER, REAL, STRING, or OTHER for types that can be selected but not compared or aggregated."""
    if isinstance(data_type, tuple(_BITS)):
        return "INTEGER"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "REAL"
    return "STRING" if isinstance(data_type, T.StringType) else "OTHER"


def literal_value(text: str, data_type: T.DataType, where: str) -> str | int | float:
    kind = family(data_type)
    if kind == "STRING":
        return text
    if kind == "INTEGER":
        if not _INTEGER.fullmatch(text):
            raise QueryError(f'"{text}" is no integer, as {where} is')
        value, bits = int(text), _BITS[type(data_type)]
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise QueryError(f'"{text}" is out of the range of {where}')
        return value
    if kind == "REAL":
        if not _REAL.fullmatch(text):
            raise QueryError(f'"{text}" is no number, as {where} is')
        return float(text)
    raise QueryError(f"{where} can't be compared with a literal")


def analyze(spec: QuerySpec, schemas: Mapping[str, T.StructType]) -> QuerySpec:
    """The spec with typed literals and, for ``SELECT *``, all columns in the order of the tables."""
    repeated = {t for t in spec.tables if spec.tables.count(t) > 1}
    if repeated:
        raise QueryError(f"listed more than once: {', '.join(sorted(repeated))}")
    if len({t.lower() for t in spec.tables}) < len(spec.tables):
        raise QueryError("tables whose names differ only in case can't be joined")
    for t in spec.tables:
        if t not in schemas:
            raise QueryError(f"no table {t}")

    def type_of(a: Attr) -> T.DataType:
        if a.table not in spec.tables:
            raise QueryError(f"{a.label}: {a.table} isn't listed after FROM")
        fields = {f.name: f.dataType for f in schemas[a.table].fields}
        if a.column not in fields:
            raise QueryError(f"{a.table} has no column {a.column}")
        kind = family(fields[a.column])
        if a.aggregate in ("MAX", "MIN", "SUM", "AVG") and kind == "OTHER" or a.aggregate == "AVG" and kind == "STRING":
            raise QueryError(f"{a.label}: not for a column of type {fields[a.column].simpleString()}")
        return fields[a.column]

    def checked(c: Cond) -> Cond:
        sides = [c.left, *([c.right] if isinstance(c.right, Attr) else [])]
        for a in sides:
            if a.aggregate:
                raise QueryError(f"{a.label}: no aggregates in WHERE")
        kinds = [family(type_of(a)) for a in sides]
        if isinstance(c.right, str):
            return replace(c, right=literal_value(c.right, type_of(c.left), c.left.label))
        if ("STRING" in kinds or "OTHER" in kinds) and kinds[0] != kinds[1]:
            raise QueryError(f"{c.left.label} and {c.right.label} have types that don't compare")
        return c

    select = spec.select or tuple(Attr(t, f.name) for t in spec.tables for f in schemas[t].fields)
    for a in (*select, *spec.group_by, *spec.order_by):
        type_of(a)
    if any(a.aggregate for a in spec.group_by):
        raise QueryError("no aggregates in GROUPBY")
    if spec.aggregated:
        if not spec.select:
            raise QueryError("SELECT * can't be grouped")
        stray = [a.label for a in select if not a.aggregate and a not in spec.group_by]
        if stray:
            raise QueryError(f"neither aggregated nor in GROUPBY: {', '.join(stray)}")
        loose = [a.label for a in spec.order_by if a not in select and a not in spec.group_by]
        if loose:
            raise QueryError(f"ORDERBY needs a selected or grouped column: {', '.join(loose)}")
    elif any(a.aggregate for a in spec.order_by):
        raise QueryError("ORDERBY an aggregate needs an aggregate query")
    if spec.distinct:
        hidden = [a.label for a in spec.order_by if a not in select]
        if hidden:
            raise QueryError(f"ORDERBY after DISTINCT needs a selected column: {', '.join(hidden)}")
    names = [a.output.lower() for a in select]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise QueryError(f"selected more than once: {', '.join(sorted(twice))}")
    return replace(spec, select=select, where=tuple(map(checked, spec.where)))
