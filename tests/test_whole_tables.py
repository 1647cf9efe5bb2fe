"""Catalogue queries over whole tables against joins in plain Python."""

import pyarrow.parquet as pq

from quillon import catalogue

DIR = "/root/testdata/sf0.001"


def rows(table):
    return pq.read_table(f"{DIR}/{table}.parquet").to_pylist()


def test_five_tables(spark):
    """Every order meets every supplier of its customer's nation."""
    nation_of = {c["c_custkey"]: c["c_nationkey"] for c in rows("customer")}
    want = sorted((o["o_orderkey"], s["s_suppkey"]) for o in rows("orders") for s in rows("supplier") if nation_of.get(o["o_custkey"]) == s["s_nationkey"])
    got = catalogue.QUERIES["experiment_five_tables"](spark, DIR)
    assert sorted((r.orders_o_orderkey, r.supplier_s_suppkey) for r in got.collect()) == want
    assert max(s for _, s in want) > 5


def test_index_range_join(spark):
    """Every supplier meets every nation up to its own, and both sides are read from their sorted copies."""
    want = sorted((s["s_suppkey"], n["n_nationkey"]) for s in rows("supplier") for n in rows("nation") if s["s_nationkey"] >= n["n_nationkey"])
    got = catalogue.QUERIES["join_index_range"](spark, DIR)
    assert sorted((r.supplier_s_suppkey, r.nation_n_nationkey) for r in got.collect()) == want
    assert all("/index-" in f for f in got.inputFiles())


def test_ordered_join(spark):
    """Every supplier, by its balance."""
    want = sorted(s["s_acctbal"] for s in rows("supplier"))
    got = catalogue.QUERIES["order_star"](spark, DIR).collect()
    assert [r.supplier_s_acctbal for r in got] == want and {r.supplier_s_suppkey for r in got} == {s["s_suppkey"] for s in rows("supplier")}


def test_crossed_components(spark):
    """Every region meets every supplier."""
    nations = {n["n_nationkey"]: n["n_name"] for n in rows("nation")}
    want = sorted((r["r_name"], nations[s["s_nationkey"]], s["s_suppkey"]) for r in rows("region") for s in rows("supplier"))
    got = catalogue.QUERIES["cross_components"](spark, DIR)
    assert sorted((r.region_r_name, r.nation_n_name, r.supplier_s_suppkey) for r in got.collect()) == want
