"""What the corpus operators share: shared scratch tables, skew-safe joins, row ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.storage import shared_dir

#: Documents are long, so fewer of them go to a Python worker at a time than Spark's default of 10,000 rows.
BATCH_ROWS = "2000"
#: At most so many keys can each hold more than 1/HEAVY_KEYS of the rows; only such keys are broadcast.
HEAVY_KEYS = 1024

_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Unless the session sets it, Arrow batches are sized for documents from then on, for all that runs in the session:
    queries are lazy, so it can't be set back.
    """
    if spark.conf.get(_BATCH_SETTING) == "10000":
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quillon")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean_up() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone when the process ends
            return


atexit.register(_clean_up)


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quillon_path", None)
        if path:
            _delete(df.sparkSession, path)
            _scratch[:] = [x for x in _scratch if x[1] != path]


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables stored within it at its end, but for those handed to the function it gives."""
    before, kept = {path for _, path in _scratch}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quillon_path)
        return df

    yield keep
    for spark, path in [x for x in _scratch if x[1] not in before | kept]:
        _delete(spark, path)
        _scratch.remove((spark, path))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front while df has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def skew_safe_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined with one row a key of groups, whose column size says how many rows the key has.

    Keys with more than total / HEAVY_KEYS rows are at most HEAVY_KEYS, so they are broadcast; the
    others go by an ordinary join in which no key is large. how: left or inner.
    """
    limit = max(total // HEAVY_KEYS, 1)
    heavy = groups.filter(F.col(size) > limit)
    hot = rows.join(F.broadcast(heavy), key, "inner")
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(groups.filter(F.col(size) <= limit), key, how)
    return hot.unionByName(cold)


def release() -> None:
    """Hand freed memory back to the system at the end of a task: workers live on, and wait, between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
