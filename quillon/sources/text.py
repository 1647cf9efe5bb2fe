"""Text in and out: ingest of tab- or blank-separated rows, the result file, and row dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "-NULL-"


def read_table_text(spark: SparkSession, path: str, schema: T.StructType, blanks: bool = False) -> DataFrame:
    """Tab-separated rows without a header or quoting; a row of another width or a value that isn't of its type is an error.

    blanks: values are parted by any white space, so none holds any and none is empty.
    """
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+", -1) if blanks else F.split("value", "\t", -1)
    whole = F.when(F.size(parts) == len(schema.fields), parts).otherwise(F.raise_error(F.concat(F.lit(f"not {len(schema.fields)} columns: "), F.col("value"))))

    def typed(i: int, f: T.StructField) -> Column:
        part = F.col("parts")[i]
        value = part.try_cast(f.dataType)
        wrong = F.raise_error(F.concat(F.lit(f"malformed {f.name}: "), part)).cast(f.dataType)
        return F.when(part == NULL, F.lit(None)).when(value.isNotNull(), value).otherwise(wrong).alias(f.name, metadata=f.metadata)

    return spark.read.text(path).select(whole.alias("parts")).select(*(typed(i, f) for i, f in enumerate(schema.fields)))


def write_table_text(df: DataFrame, path: str) -> None:
    """The inverse; a text with a tab or a line break in it is an error."""
    safe = [F.when(t.rlike(r"[\t\n\r]"), F.raise_error(F.lit("a tab or line break within a value")).cast("string")).otherwise(t) for t in _texts(df)]
    df.select(F.array_join(F.array(*safe), "\t")).write.text(path)


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, blanks: bool = False) -> DataFrame:
    """A text file as a Parquet table."""
    read_table_text(spark, source, schema, blanks).write.parquet(target)
    return spark.read.parquet(target)


def _texts(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in df.columns]


def header(df: DataFrame) -> str:
    """The labels of the columns, each followed by two blanks."""
    return "".join(f"{f.metadata.get('label', f.name)}  " for f in df.schema.fields)


def result_lines(df: DataFrame) -> DataFrame:
    """Every value followed by a tab."""
    return df.select(F.concat(*(F.concat(t, F.lit("\t")) for t in _texts(df))).alias("line"))


def write_result_file(df: DataFrame, path: str) -> int:
    """The header and all rows, in order, to one local file, a partition at a time; the number of rows."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write(header(df) + "\n")
        for row in result_lines(df).toLocalIterator(prefetchPartitions=True):
            out.write(row.line + "\n")
            n += 1
    return n


def write_result_folder(df: DataFrame, path: str) -> None:
    """All rows to text files written by the executors, for results of any size; the header goes beside them."""
    result_lines(df).write.text(f"{path}/rows")
    df.sparkSession.createDataFrame([(header(df),)], "line string").coalesce(1).write.text(f"{path}/header")


def dump_lines(df: DataFrame) -> DataFrame:
    """The values of each row, joined by commas."""
    return df.select(F.concat_ws(",", *_texts(df)).alias("line"))
