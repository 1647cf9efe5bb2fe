"""Joins that keep hot keys apart, and scratch tables."""

import os

from pyspark.sql import functions as F

from quillon.llm import common


def test_skew_safe_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_KEYS", 8)
    rows = spark.range(900).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 50).alias("k"))
    groups = rows.filter("k != 7").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    for how in ("inner", "left"):
        got = common.skew_safe_join(rows, groups, "k", "n", 900, how).select("k", "id", "n", "m").collect()
        assert sorted(got, key=repr) == sorted(rows.join(groups, "k", how).select("k", "id", "n", "m").collect(), key=repr)
    assert common.skew_safe_join(rows, groups.limit(0), "k", "n", 0, "left").count() == 900


def test_stored_tables(spark):
    df = common.stored(spark.range(10), "x")
    path = df._quillon_path.removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(path)
    common.discard(df)
    assert not os.path.exists(path)


def test_held_out(spark):
    df = spark.createDataFrame([(5,), (6,), (None,)], "i long")
    assert [r[0] for r in df.select(common.held_out(F.col("i"))).collect()] == [True, False, False]


def test_free_names(spark):
    df = spark.range(1).select(F.lit(1).alias("H"), F.lit(2).alias("_h"))
    assert common.free_name(df, "h") == "__h" and common.free_name(df, "x") == "x"


def test_scratch_tables_go_but_for_those_kept(spark):
    with common.scratch() as keep:
        a = common.stored(spark.range(3), "a")
        b = keep(common.stored(spark.range(4), "b"))
        with common.scratch() as keep_inner:
            c = keep_inner(common.stored(spark.range(5), "c"))
        assert c.count() == 5
    assert b.count() == 4
    assert [os.path.exists(x._quillon_path.removeprefix("file://")) for x in (a, b, c)] == [False, True, False]
