"""Exact deduplication against brute force, and its filter."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def cases():
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices(["a", "b", " ", "\n", " ", "é"], k=rng.randrange(0, 5)))) for i in range(400)]
    rows += [(1000, "hot text")] + [(1001 + i, "hot  text" if i % 2 else "hottext") for i in range(300)]
    return [*rows, (2000, None), (2001, " \t"), (None, "hot text"), (None, None), (None, "only null id"), *rows[:4], (2002, "x" * 100000)]


@pytest.mark.parametrize("bits", [None, 64])
def test_groups(spark, monkeypatch, bits):
    if bits:  # a filter that is far too small
        monkeypatch.setattr(exact_dedup, "MIN_BITS", bits)
        monkeypatch.setattr(exact_dedup, "MAX_BITS", bits)
    rows = cases()
    best, size = {}, {}
    rank = lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0))
    for r in rows:
        k = normal(r[1])
        best[k] = max(best.get(k, r), r, key=rank)
        size[k] = size.get(k, 0) + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("n", F.lit("x")).withColumn("MAYBE", F.lit(2))
    got = exact_dedup.duplicate_groups(df).collect()
    want = sorted(((r[0], best[normal(r[1])][0], size[normal(r[1])], hashlib.sha256(normal(r[1]).encode()).hexdigest()) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(best) and all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.exact_dedup(df)
    assert stay.columns == df.columns
    assert sorted(((r.doc_id, r.text or "") for r in stay.collect()), key=repr) == sorted(((r[0], r[1] or "") for r in best.values()), key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.duplicate_groups(df).count() == 0 and exact_dedup.exact_dedup(df).count() == 0


def test_filter_lets_unique_hashes_pass(spark):
    hashes = [*range(20000), *range(0, 20000, 10)]
    df = spark.createDataFrame([(h,) for h in hashes], "k long").select(F.xxhash64("k").alias("h"), "k").repartition(7)
    bits, twice = exact_dedup.repeat_filter(df.select("h"), len(hashes))
    maybe = {r.k for r in df.filter(exact_dedup._maybe_repeated(spark, bits, twice)("h")).collect()}
    assert maybe >= set(range(0, 20000, 10)) and len(maybe) < 3500


@pytest.mark.parametrize("dense", [False, True])
def test_dense_and_sparse_chunks_agree(dense, monkeypatch):
    monkeypatch.setattr(exact_dedup, "CHUNK_BITS", 1 << 10)
    import pyarrow as pa

    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63, 2000 if dense else 20)
    h = np.append(h, h[:5])
    bits = 1 << 14
    chunks = list(exact_dedup._set_bits(bits)(iter([pa.record_batch([pa.array(h)], names=["h"])])))
    assert any(c["dense"][0].as_py() for c in chunks) == dense
    merged = next(exact_dedup._merge(1 << 10)(iter(chunks)))
    counts = np.zeros(bits, int)
    for p in exact_dedup._positions(h, bits):
        np.add.at(counts, p.astype(np.int64), 1)
    twice = np.zeros(bits, bool)
    for k, part in zip(merged["chunk"].to_pylist(), merged["twice"].to_pylist(), strict=True):
        twice[k << 10 : (k + 1) << 10] = np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little").astype(bool)
    assert (twice == (counts > 1)).all()
