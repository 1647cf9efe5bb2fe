"""Row and distinct counts of a table's columns: counted, stored, read back for planning, registered with Spark's catalog."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TableStatistics(NamedTuple):
    rows: int
    distinct: dict[str, int]  # by column


def table_statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row a column: column, n_rows, n_distinct. Approximate distinct counts take one pass of any size."""
    count = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(F.count(F.lit(1)).alias("rows of it"), *(count(F.col(f"`{c}`")).alias(c) for c in df.columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col("rows of it").alias("n_rows"), F.col(f"`{c}`").alias("n_distinct")) for c in df.columns))
    return one.select(F.inline(each))


def write_statistics(df: DataFrame, path: str, exact: bool = False) -> None:
    table_statistics(df, exact).coalesce(1).write.parquet(path)


def read_statistics(spark: SparkSession, path: str) -> TableStatistics:
    """What write_statistics stored: one row a column of one table."""
    rows = spark.read.parquet(path).collect()
    return TableStatistics(max((r["n_rows"] for r in rows), default=0), {r["column"]: r["n_distinct"] for r in rows})


def analyze_table(spark: SparkSession, name: str) -> None:
    """Statistics of a registered table for Catalyst's cost-based join order."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
