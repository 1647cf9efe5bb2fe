"""Seeded random tables for a definition, computed on the executors without a shuffle.

A row depends on its number and the seed only. Primary keys run through [0, range) by an affine map, so they
are unique; other numbers are uniform in [0, range), and strings are lower-case letters of the exact length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.spec import QueryError


def _draw(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _permuted(n: int, seed: int, column: int) -> Column:
    """A bijection of [0, n) applied to id."""
    step = (seed * 2_654_435_761 + column * 40_503 + n // 2 + 1) % n or 1
    while math.gcd(step, n) != 1:
        step += 1
    return ((F.col("id") * step + (seed * 97 + column) % n) % n).cast("int")


def generate(spark: SparkSession, schema: T.StructType, rows: int, seed: int = 0) -> DataFrame:
    columns = []
    for i, f in enumerate(schema.fields):
        bound, key = f.metadata["range"], f.metadata["key"]
        if key == "PK" and isinstance(f.dataType, T.IntegerType):
            if rows > bound:
                raise QueryError(f"{f.name}: {rows} unique values don't fit into [0, {bound})")
            made = _permuted(bound, seed, i)
        elif isinstance(f.dataType, T.IntegerType):
            made = F.pmod(_draw(seed, F.col("id"), F.lit(i)), F.lit(bound)).cast("int")
        elif isinstance(f.dataType, T.FloatType):
            made = (F.pmod(_draw(seed, F.col("id"), F.lit(i)), F.lit(bound * 100)) / 100).cast("float")
        else:
            letter = lambda k, i=i: F.char(F.lit(97) + F.pmod(_draw(seed, F.col("id"), F.lit(i), k), F.lit(26)))
            made = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(bound)), letter), "") if bound else F.lit("")
        columns.append(made.alias(f.name, metadata=f.metadata))
    return spark.range(rows).select(*columns)
