"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    good = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    lengths = [len(v) for v in good.values()]
    dim = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    good = {i: v for i, v in good.items() if len(v) == dim}
    out = {}
    for q in sorted({q for q in asked if q in good}):
        near = sorted((-float(good[q] @ good[i]), i) for i in good if i != q)[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_small_tables_are_exact(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) * (rng.random() * 9 if scale else 1)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [1.0, None, *[0.0] * 6]), (2005, [float("inf"), *[0.0] * 7]), (2006, [1.0]), (None, [1.0] * 8)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vec", F.lit(1)).withColumn("id", F.lit("x"))
    got = collected(ann.nearest(df, df.filter("vec_id % 3 = 0 or vec_id >= 1000"), query_ratio=99))
    want = brute(rows, [i for i, _ in rows if i is not None and (i % 3 == 0 or i >= 1000)], 20)
    assert set(got) == set(want)
    for q, near in want.items():
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        assert np.allclose([s for _, _, s in got[q]], [s for _, s in near], rtol=1e-12)
        assert [i for _, i, _ in got[q]] == [i for i, _ in near]


def test_fewer_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], SCHEMA)
    got = collected(ann.nearest(df, df.filter("vec_id = 0")))
    assert got == {0: [(1, 1, 0.5), (2, 2, 0.0)]}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df, df.limit(0)).count() == 0
    assert ann.nearest(df.limit(1), df.limit(1)).count() == 0


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = collected(ann.nearest(df, df.filter("vec_id % 20 = 0")))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in near}) for q, near in want.items())
    assert hits >= 0.95 * 20 * len(want)


def table(spark, path, vectors):
    """Vectors as a Parquet table, numbered; and for each query the ids of its 20 nearest."""
    ids = np.arange(len(vectors))
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors.reshape(-1)), vectors.shape[1]).cast(pa.list_(pa.float64()))}), path)
    want = {}
    for q in range(0, len(vectors), 20):
        s = vectors @ vectors[q]
        s[q] = -np.inf
        want[q] = set(np.lexsort((ids, -s))[:20].tolist())
    return spark.read.parquet(str(path)), want


def recall(got, want):
    return sum(len({i for _, i, _ in got[q]} & near) for q, near in want.items()) / (20 * len(want))


@pytest.mark.parametrize(("n", "outlier"), [(10_000, False), (10_000, True), (50_000, False)])
def test_recall_and_work(spark, tmp_path, n, outlier):
    """Uniform directions are the hardest case; still fewer products than brute force takes, also beside one long vector."""
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if outlier:
        x[7] *= 100
    df, want = table(spark, tmp_path / "v.parquet", x)
    queries = df.filter("vec_id % 20 = 0")
    got = collected(ann.nearest(df, queries))
    assert set(got) == set(want) and all([r for r, _, _ in near] == list(range(1, 21)) for near in got.values())
    assert recall(got, want) >= 0.9
    index = ann.build_index(df)
    chosen = ann.choose_lists(index, queries.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")))
    assert ann.products(index, chosen) < n * len(want)
    assert len(index.bands) == 1 + outlier and index.sizes.max() < 6 * ann.LIST


def test_norms_of_any_size(spark, tmp_path):
    """Bands of very different norms, and vectors in clusters."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 16))[rng.integers(0, 40, 6000)] + 0.3 * rng.standard_normal((6000, 16))
    x *= np.exp2(rng.integers(-30, 30, (6000, 1)) // 10 * 10.0)
    df, want = table(spark, tmp_path / "v.parquet", x)
    got = collected(ann.nearest(df, df.filter("vec_id % 20 = 0")))
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_the_table_says_the_length(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(50)] + [(100 + i, [1.0, 2.0, 3.0]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    mostly_long = df.filter("vec_id % 25 = 0 or vec_id >= 100")
    assert set(collected(ann.nearest(df, mostly_long))) == {0, 25}


def test_graph_search_finds_the_nearest():
    rng = np.random.default_rng(0)
    centroids = ann.Centroids(ann.bisect(rng.standard_normal((6000, 24)), 300))
    q = rng.standard_normal((500, 24))
    exact = centroids.distances(q)
    ids, d = centroids.search(q, 4, 1.01)
    assert (ids[:, 0] == exact.argmin(axis=1)).mean() > 0.97 and np.isinf(d).any() and (d[:, :1] <= d).all()
    within = centroids.within(q, 1.1)
    near = exact <= exact.min(axis=1, keepdims=True) * 1.1
    assert np.isfinite(within)[near].mean() > 0.98
    assert np.allclose(within[np.isfinite(within)], exact[np.isfinite(within)], atol=1e-3)


def test_too_few_in_the_lists_found(spark):
    """A ratio that leaves one list a query: further lists are read until there are enough entries."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(2000)], SCHEMA)
    got = collected(ann.nearest(df, df.filter("vec_id % 50 = 0"), query_ratio=1.0))
    assert len(got) == 40 and all(len(x) == 20 for x in got.values())


def test_segments_and_blocks(spark, monkeypatch):
    for name, value in (("SEGMENT", 100), ("BLOCK", 30), ("CHUNK", 7), ("MERGED", 100), ("SHARD", 3)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collected(ann.nearest(df, df.filter("vec_id % 5 = 0"), query_ratio=99))
    want = brute(rows, range(0, 900, 5), 20)
    assert {q: [i for _, i, _ in near] for q, near in got.items()} == {q: [i for i, _ in near] for q, near in want.items()}
