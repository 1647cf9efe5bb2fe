"""Plans as text, and Catalyst's cost estimates."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """mode: simple, extended, codegen, cost or formatted."""
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


class Cost(NamedTuple):
    size_in_bytes: int
    row_count: int | None


def cost(df: DataFrame) -> Cost:
    """The estimates for the whole query; rows only where the tables have been analyzed."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return Cost(int(str(stats.sizeInBytes())), int(str(rows.get())) if rows.isDefined() else None)
