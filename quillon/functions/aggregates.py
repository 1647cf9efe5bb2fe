"""MAX, MIN, SUM, COUNT and AVG.

COUNT and integer sums are 64-bit (a sum beyond that raises under ANSI mode), AVG is a double, and the SUM of
strings concatenates them in sorted order, so that it doesn't depend on how rows arrive. The result is one value, so
one task holds a group's strings: together they must be within Spark's 2 GB a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def aggregate(kind: str, column: Column, data_type: T.DataType) -> Column:
    if kind == "SUM":
        if isinstance(data_type, T.StringType):
            return F.array_join(F.sort_array(F.collect_list(column)), "")
        return F.sum(column.cast("double" if isinstance(data_type, (T.FloatType, T.DoubleType)) else "bigint"))
    return {"MAX": F.max, "MIN": F.min, "COUNT": F.count, "AVG": F.avg}[kind](column)
