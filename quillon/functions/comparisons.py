"""The six comparisons. A literal takes the type of the column, never the other way round, so that scans can prune by it."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PYTHON = {"<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}


def compare(left: Column, op: str, right: Column) -> Column:
    return _PYTHON[op](left, right)


def compare_literal(left: Column, op: str, value: str | int | float, data_type: T.DataType) -> Column:
    return compare(left, op, F.lit(value).cast(data_type))
