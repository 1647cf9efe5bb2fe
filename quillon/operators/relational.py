"""Project, filter, aggregate, distinct and sort over frames whose columns are named ``T.c``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.aggregates import aggregate
from quillon.functions.comparisons import compare, compare_literal
from quillon.plans.spec import Attr, Cond


def column(a: Attr) -> Column:
    return F.col(f"`{a.table}.{a.column}`")


def scan(table: DataFrame, name: str) -> DataFrame:
    """A table with its columns renamed ``T.c``; Catalyst reads only those that are used."""
    return table.select(*(F.col(f"`{c}`").alias(f"{name}.{c}") for c in table.columns))


def predicate(df: DataFrame, c: Cond) -> Column:
    if isinstance(c.right, Attr):
        return compare(column(c.left), c.op, column(c.right))
    return compare_literal(column(c.left), c.op, c.right, df.schema[f"{c.left.table}.{c.left.column}"].dataType)


def select_rows(df: DataFrame, conditions: Sequence[Cond]) -> DataFrame:
    for c in conditions:
        df = df.filter(predicate(df, c))
    return df


def project(df: DataFrame, attributes: Sequence[Attr]) -> DataFrame:
    return df.select(*(column(a).alias(a.output, metadata={"label": a.label}) for a in attributes))


def _aggregated(df: DataFrame, a: Attr) -> Column:
    return aggregate(a.aggregate, column(a), df.schema[f"{a.table}.{a.column}"].dataType).alias(a.output, metadata={"label": a.label})


def aggregate_all(df: DataFrame, attributes: Sequence[Attr]) -> DataFrame:
    """One row; none if there are no rows to aggregate."""
    counted = df.agg(*(_aggregated(df, a) for a in attributes), F.count(F.lit(1)).alias("rows of it"))
    return counted.filter(F.col("rows of it") > 0).drop("rows of it")


def aggregate_groups(df: DataFrame, keys: Sequence[Attr], attributes: Sequence[Attr]) -> DataFrame:
    """One row a group, with the keys and the aggregates among the attributes, named as in the result."""
    named = [column(k).alias(k.output, metadata={"label": k.label}) for k in keys]
    values = [_aggregated(df, a) for a in attributes if a.aggregate]
    return df.groupBy(*named).agg(*values) if values else df.select(*named).distinct()


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, columns: Sequence[Column], ascending: bool = True) -> DataFrame:
    return df.orderBy(*(c.asc() if ascending else c.desc() for c in columns))
