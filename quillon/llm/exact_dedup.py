"""Exact deduplication by two-pass Bloom filtering.

Pass one sets bits for every text digest and keeps, beside the bits set once, the bits set twice.
A digest whose bits were not all set twice is unique, so its row never moves; only the other rows are
shuffled. The filter has a fixed size: when the corpus outgrows it, more rows are shuffled and the
result stays the same.

Defined cases: null text counts as empty; texts are equal when identical after deleting the characters
``[\\x20\\x09-\\x0D]``; of equal texts the row with the most code points, then the smallest doc_id (a
null id last) stays; of wholly equal rows one stays; an empty table gives an empty result; other columns,
whatever their names, are carried by ``exact_dedup`` and ignored by ``duplicate_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import common

#: Filter bits, a power of two: 2^28 bits are 32 MB in a worker, whatever the number of documents.
MAX_BITS = 1 << 28
MIN_BITS = 1 << 16
BITS_PER_ROW = 16
CHUNK_BITS = 1 << 20
PROBES = 2


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as lowercase hex."""
    return F.sha2(normalised(text), 256)


def _positions(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [(h >> np.uint64(i * 32)) & np.uint64(bits - 1) for i in range(PROBES)]


_CHUNKS = "chunk int, dense boolean, once binary, twice binary"


def _chunk_rows(rows: list[tuple[int, bool, bytes, bytes]]) -> pa.RecordBatch:
    chunk, dense, once, twice = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.record_batch([pa.array(chunk, pa.int32()), pa.array(dense, pa.bool_()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["chunk", "dense", "once", "twice"])


def _bitmap(positions: np.ndarray, size: int) -> np.ndarray:
    bits = np.zeros(size, bool)
    bits[positions] = True
    return np.packbits(bits, bitorder="little")


def _set_bits(bits: int):
    """A task's chunks of the filter: which positions it set, and which of them more than once; as lists while they are few."""
    size = min(CHUNK_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [p for batch in batches for p in _positions(batch.column(0).to_numpy(zero_copy_only=False), bits)]
        at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
        edges = np.searchsorted(at, np.arange(0, bits + 1, size, dtype=np.uint64)).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if b > a:
                once = (at[a:b] - np.uint64(k * size)).astype(np.uint32)
                twice = once[n[a:b] > 1]
                dense = 32 * (b - a) > size
                yield _chunk_rows([(k, dense, *((_bitmap(x, size) if dense else x).tobytes() for x in (once, twice)))])

    return run


def _merge(size: int):
    """Chunks of many tasks to one a chunk: a bit that two tasks set, or one set twice, is set twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, dense, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = (np.frombuffer(x, np.uint8) if dense else _bitmap(np.frombuffer(x, np.uint32), size) for x in parts)
                if k in sums:
                    sums[k][1] |= t | (sums[k][0] & o)
                    sums[k][0] |= o
                else:
                    sums[k] = [o.copy(), t.copy()]
        yield _chunk_rows([(k, True, o.tobytes(), t.tobytes()) for k, (o, t) in sums.items()])

    return run


def repeat_filter(hashes: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """Pass one over a column of 64-bit hashes: the bits set twice, at most MAX_BITS of them."""
    common.ship(hashes.sparkSession)
    bits = MIN_BITS
    while bits < MAX_BITS and bits < rows * BITS_PER_ROW:
        bits *= 2
    size = min(CHUNK_BITS, bits)
    merged = hashes.mapInArrow(_set_bits(bits), _CHUNKS).repartition(bits // size, "chunk").mapInArrow(_merge(size), _CHUNKS)
    twice = np.zeros(bits // 8, np.uint8)
    for k, part in merged.select("chunk", "twice").collect():  # at most MAX_BITS / CHUNK_BITS chunks
        twice[k * size // 8 : (k + 1) * size // 8] = np.frombuffer(part, np.uint8)
    return bits, twice


def _maybe_repeated(spark: SparkSession, bits: int, twice: np.ndarray):
    shared = spark.sparkContext.broadcast(twice)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        values, ok = h.to_numpy(np.int64), np.ones(len(h), bool)
        for p in _positions(values, bits):
            ok &= (shared.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return probe


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    light = common.stored(
        docs.select(F.col(id_col).alias("doc_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"), digest(F.col(text_col)).alias("text_sha256")).withColumn("h", F.xxhash64("text_sha256")).withColumn("rid", F.monotonically_increasing_id()),
        "digests",
    )
    total = light.count()
    probe = _maybe_repeated(docs.sparkSession, *repeat_filter(light.select("h"), total))
    marked = light.withColumn("maybe", probe("h"))
    alone = marked.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = marked.filter("maybe").drop("maybe", "h")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid")))
    groups = maybe.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size")).select("text_sha256", "best.keep_id", "best.keep_rid", "group_size")
    groups = common.stored(groups, "groups")
    joined = common.skew_safe_join(maybe, groups, "text_sha256", "group_size", total, "inner")
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows with unique digests go straight through. The others meet by digest; as only the first row of a
    digest is wanted, each task sends at most one row of it (Spark's window group limit).
    """
    h, n, maybe, order = (common.free_name(docs, x) for x in ("h", "n", "maybe", "order"))
    short = F.xxhash64(normalised(F.col(text_col)))  # enough to find what may be repeated; only that needs a digest
    total = docs.count()
    probe = _maybe_repeated(docs.sparkSession, *repeat_filter(docs.select(short.alias("h")), total))
    marked = docs.withColumn(maybe, probe(short))
    first = Window.partitionBy(h).orderBy(F.col(n).desc(), F.col(id_col).asc_nulls_last())
    met = marked.filter(maybe).withColumn(h, digest(F.col(text_col))).withColumn(n, F.char_length(F.coalesce(F.col(text_col), F.lit(""))))
    kept = met.withColumn(order, F.row_number().over(first)).filter(F.col(order) == 1)
    return marked.filter(~F.col(maybe)).select(*docs.columns).unionByName(kept.select(*docs.columns))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(common.table(spark, sf_dir, "documents"))


QUERIES = {"op7_exact_dedup": op7_exact_dedup}

ORACLE_SQL = {
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""",
}
