"""The engine's queries over the driver's tables, each beside the DuckDB SQL that says what it means.

The SQL is written by hand, not derived from the dialect texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.plans.spec import COMPARISONS
from quillon.session import Engine
from quillon.sources import definitions, generate, indexes, statistics, text
from quillon.sources.catalog import Catalog
from quillon.sources.storage import shared_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, Catalog.of_folder(spark, sf_dir, TABLES))


def register(name: str, query: str, oracle: str, strategy: str = "auto") -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).sql(query, strategy)
    ORACLE_SQL[name] = oracle


def named(table: str, *columns: str) -> str:
    """SQL for columns under their result names."""
    return ", ".join(f"{table}.{c} AS {table}_{c}" for c in columns)


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
NATION = ("n_nationkey", "n_name", "n_regionkey")
REGION = ("r_regionkey", "r_name")
SUPPLIER = ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
WORDS = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}

# scan and projection
register("scan_all", "SELECT * FROM customer", f"SELECT {named('customer', *CUSTOMER)} FROM customer")
register("project", "SELECT customer.c_name, customer.c_custkey FROM customer", f"SELECT {named('customer', 'c_name', 'c_custkey')} FROM customer")
register("scan_star_two_tables", "SELECT * FROM nation,region WHERE nation.n_regionkey=region.r_regionkey", f"SELECT {named('nation', *NATION)}, {named('region', *REGION)} FROM nation, region WHERE n_regionkey = r_regionkey")

# the six comparisons on each type
for op in COMPARISONS:
    sql_op = "<>" if op == "!=" else op
    register(f"filter_int_{WORDS[op]}", f'SELECT customer.c_custkey, customer.c_nationkey FROM customer WHERE customer.c_nationkey{op}"7"', f"SELECT {named('customer', 'c_custkey', 'c_nationkey')} FROM customer WHERE c_nationkey {sql_op} 7")
    register(f"filter_str_{WORDS[op]}", f'SELECT customer.c_custkey, customer.c_mktsegment FROM customer WHERE customer.c_mktsegment{op}"FURNITURE"', f"SELECT {named('customer', 'c_custkey', 'c_mktsegment')} FROM customer WHERE c_mktsegment {sql_op} 'FURNITURE'")
    register(f"filter_real_{WORDS[op]}", f'SELECT lineitem.l_orderkey, lineitem.l_linenumber, lineitem.l_discount FROM lineitem WHERE lineitem.l_discount{op}"0.05"', f"SELECT {named('lineitem', 'l_orderkey', 'l_linenumber', 'l_discount')} FROM lineitem WHERE l_discount {sql_op} CAST('0.05' AS DOUBLE)")
register("filter_attr_attr", "SELECT lineitem.l_orderkey, lineitem.l_partkey, lineitem.l_suppkey FROM lineitem WHERE lineitem.l_partkey<lineitem.l_suppkey", f"SELECT {named('lineitem', 'l_orderkey', 'l_partkey', 'l_suppkey')} FROM lineitem WHERE l_partkey < l_suppkey")
register("filter_conjunction", 'SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size>"10",part.p_size<="20",part.p_brand!="Brand#11"', f"SELECT {named('part', 'p_partkey', 'p_size')} FROM part WHERE p_size > 10 AND p_size <= 20 AND p_brand <> 'Brand#11'")
register("filter_str_numeric", 'SELECT customer.c_custkey FROM customer WHERE customer.c_name>"10"', f"SELECT {named('customer', 'c_custkey')} FROM customer WHERE c_name > '10'")

# joins
CO = "customer.c_custkey=orders.o_custkey"
OL = "orders.o_orderkey=lineitem.l_orderkey"
CN = "customer.c_nationkey=nation.n_nationkey"
EQUI = "SELECT customer.c_custkey, customer.c_name, orders.o_orderkey, orders.o_totalprice FROM customer,orders WHERE " + CO
EQUI_SQL = f"SELECT {named('customer', 'c_custkey', 'c_name')}, {named('orders', 'o_orderkey', 'o_totalprice')} FROM customer, orders WHERE c_custkey = o_custkey"
register("join_equi_2", EQUI, EQUI_SQL)
register("join_equi_3", f"SELECT customer.c_name, orders.o_orderkey, lineitem.l_linenumber FROM customer,orders,lineitem WHERE {CO},{OL}", f"SELECT {named('customer', 'c_name')}, {named('orders', 'o_orderkey')}, {named('lineitem', 'l_linenumber')} FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey")
FOUR = f'FROM customer,orders,lineitem,nation WHERE {CO},{OL},{CN},lineitem.l_quantity<"30",lineitem.l_quantity>"10"'
FOUR_SQL = "FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey AND l_quantity < 30 AND l_quantity > 10"
register("join_equi_4", f"SELECT nation.n_name, orders.o_orderkey, lineitem.l_linenumber, lineitem.l_quantity {FOUR}", f"SELECT {named('nation', 'n_name')}, {named('orders', 'o_orderkey')}, {named('lineitem', 'l_linenumber', 'l_quantity')} {FOUR_SQL}")
register("join_equi_5", f"SELECT region.r_name, nation.n_name, orders.o_orderkey, lineitem.l_linenumber FROM lineitem,orders,customer,nation,region WHERE {CO},{OL},{CN},nation.n_regionkey=region.r_regionkey", f"SELECT {named('region', 'r_name')}, {named('nation', 'n_name')}, {named('orders', 'o_orderkey')}, {named('lineitem', 'l_linenumber')} FROM lineitem, orders, customer, nation, region WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey")
for op in COMPARISONS:
    if op != "=":
        register(f"join_theta_{WORDS[op]}", f"SELECT supplier.s_suppkey, nation.n_nationkey FROM supplier,nation WHERE supplier.s_nationkey{op}nation.n_nationkey", f"SELECT {named('supplier', 's_suppkey')}, {named('nation', 'n_nationkey')} FROM supplier, nation WHERE s_nationkey {'<>' if op == '!=' else op} n_nationkey")
register("join_theta_permuted", "SELECT supplier.s_suppkey, nation.n_nationkey FROM nation,supplier WHERE supplier.s_nationkey<nation.n_nationkey", f"SELECT {named('supplier', 's_suppkey')}, {named('nation', 'n_nationkey')} FROM supplier, nation WHERE s_nationkey < n_nationkey")
register("join_multi_cond", "SELECT customer.c_custkey, supplier.s_suppkey FROM customer,supplier WHERE customer.c_nationkey=supplier.s_nationkey,customer.c_custkey<=supplier.s_suppkey", f"SELECT {named('customer', 'c_custkey')}, {named('supplier', 's_suppkey')} FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_custkey <= s_suppkey")
register("join_cycle", f"SELECT customer.c_custkey, supplier.s_suppkey, nation.n_name FROM customer,supplier,nation WHERE {CN},supplier.s_nationkey=nation.n_nationkey,customer.c_nationkey=supplier.s_nationkey,customer.c_acctbal<supplier.s_acctbal", f"SELECT {named('customer', 'c_custkey')}, {named('supplier', 's_suppkey')}, {named('nation', 'n_name')} FROM customer, supplier, nation WHERE c_nationkey = n_nationkey AND s_nationkey = n_nationkey AND c_nationkey = s_nationkey AND c_acctbal < s_acctbal")
register("cross_join", "SELECT * FROM region,nation", f"SELECT {named('region', *REGION)}, {named('nation', *NATION)} FROM region, nation")
register("cross_components", "SELECT region.r_name, nation.n_name, supplier.s_suppkey FROM region,nation,supplier WHERE nation.n_nationkey=supplier.s_nationkey", f"SELECT {named('region', 'r_name')}, {named('nation', 'n_name')}, {named('supplier', 's_suppkey')} FROM region, nation, supplier WHERE n_nationkey = s_nationkey")
for strategy in ("nested", "block", "merge", "hash", "broadcast"):
    register(f"join_{strategy}", EQUI, EQUI_SQL, strategy)
register("join_nested_theta", "SELECT supplier.s_suppkey, nation.n_nationkey FROM supplier,nation WHERE supplier.s_nationkey>=nation.n_nationkey", f"SELECT {named('supplier', 's_suppkey')}, {named('nation', 'n_nationkey')} FROM supplier, nation WHERE s_nationkey >= n_nationkey", "nested")

# the timed joins: every column of two to five tables
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
register("experiment_two_tables", f"SELECT * FROM customer,orders WHERE {CO}", f"SELECT {named('customer', *CUSTOMER)}, {named('orders', *ORDERS)} FROM customer, orders WHERE c_custkey = o_custkey")
register("experiment_three_tables", f"SELECT * FROM region,nation,customer WHERE region.r_regionkey=nation.n_regionkey,{CN}", f"SELECT {named('region', *REGION)}, {named('nation', *NATION)}, {named('customer', *CUSTOMER)} FROM region, nation, customer WHERE r_regionkey = n_regionkey AND c_nationkey = n_nationkey")
register("experiment_five_tables", f"SELECT * FROM region,nation,customer,orders,supplier WHERE region.r_regionkey=nation.n_regionkey,{CN},{CO},supplier.s_nationkey=nation.n_nationkey", f"SELECT {named('region', *REGION)}, {named('nation', *NATION)}, {named('customer', *CUSTOMER)}, {named('orders', *ORDERS)}, {named('supplier', *SUPPLIER)} FROM region, nation, customer, orders, supplier WHERE r_regionkey = n_regionkey AND c_nationkey = n_nationkey AND c_custkey = o_custkey AND s_nationkey = n_nationkey")

# aggregates and groups
register("agg_global", "SELECT MAX(customer.c_nationkey), MIN(customer.c_nationkey), SUM(customer.c_nationkey), COUNT(customer.c_custkey), AVG(customer.c_nationkey) FROM customer", "SELECT max(c_nationkey) AS max_customer_c_nationkey, min(c_nationkey) AS min_customer_c_nationkey, CAST(sum(c_nationkey) AS BIGINT) AS sum_customer_c_nationkey, count(c_custkey) AS count_customer_c_custkey, avg(c_nationkey) AS avg_customer_c_nationkey FROM customer")
register("agg_real", "SELECT MAX(lineitem.l_quantity), MIN(lineitem.l_quantity), SUM(lineitem.l_quantity), AVG(lineitem.l_quantity) FROM lineitem", "SELECT max(l_quantity) AS max_lineitem_l_quantity, min(l_quantity) AS min_lineitem_l_quantity, sum(l_quantity) AS sum_lineitem_l_quantity, avg(l_quantity) AS avg_lineitem_l_quantity FROM lineitem")
register("agg_string", "SELECT MAX(customer.c_name), MIN(customer.c_mktsegment), COUNT(customer.c_name) FROM customer", "SELECT max(c_name) AS max_customer_c_name, min(c_mktsegment) AS min_customer_c_mktsegment, count(c_name) AS count_customer_c_name FROM customer")
register("agg_sum_string", "SELECT SUM(region.r_name) FROM region", "SELECT string_agg(r_name, '' ORDER BY r_name) AS sum_region_r_name FROM region")
register("agg_empty", 'SELECT MAX(customer.c_custkey), COUNT(customer.c_custkey) FROM customer WHERE customer.c_custkey<"0"', "SELECT max(c_custkey) AS max_customer_c_custkey, count(c_custkey) AS count_customer_c_custkey FROM customer WHERE c_custkey < 0 HAVING count(*) > 0")
register("agg_join", f"SELECT COUNT(lineitem.l_orderkey), MAX(nation.n_name) {FOUR}", f"SELECT count(l_orderkey) AS count_lineitem_l_orderkey, max(n_name) AS max_nation_n_name {FOUR_SQL}")
register("group_max", f"SELECT nation.n_name, MAX(lineitem.l_quantity) {FOUR} GROUPBY nation.n_name", f"SELECT n_name AS nation_n_name, max(l_quantity) AS max_lineitem_l_quantity {FOUR_SQL} GROUP BY n_name")
register("group_many", "SELECT lineitem.l_returnflag, lineitem.l_linestatus, COUNT(lineitem.l_orderkey), SUM(lineitem.l_quantity), AVG(lineitem.l_quantity), MIN(lineitem.l_discount), MAX(lineitem.l_discount) FROM lineitem GROUPBY lineitem.l_returnflag, lineitem.l_linestatus", f"SELECT {named('lineitem', 'l_returnflag', 'l_linestatus')}, count(l_orderkey) AS count_lineitem_l_orderkey, sum(l_quantity) AS sum_lineitem_l_quantity, avg(l_quantity) AS avg_lineitem_l_quantity, min(l_discount) AS min_lineitem_l_discount, max(l_discount) AS max_lineitem_l_discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
register("group_without_aggregate", "SELECT customer.c_mktsegment FROM customer GROUPBY customer.c_mktsegment", "SELECT c_mktsegment AS customer_c_mktsegment FROM customer GROUP BY c_mktsegment")
register("group_hidden_key", "SELECT COUNT(customer.c_custkey) FROM customer GROUPBY customer.c_nationkey", "SELECT count(c_custkey) AS count_customer_c_custkey FROM customer GROUP BY c_nationkey")
register("group_order", "SELECT customer.c_nationkey, COUNT(customer.c_custkey) FROM customer GROUPBY customer.c_nationkey ORDERBY customer.c_nationkey", "SELECT c_nationkey AS customer_c_nationkey, count(c_custkey) AS count_customer_c_custkey FROM customer GROUP BY c_nationkey ORDER BY c_nationkey")

# distinct and order
register("distinct_one", "SELECT DISTINCT customer.c_mktsegment FROM customer", "SELECT DISTINCT c_mktsegment AS customer_c_mktsegment FROM customer")
register("distinct_two", "SELECT DISTINCT customer.c_mktsegment, customer.c_nationkey FROM customer", f"SELECT DISTINCT {named('customer', 'c_mktsegment', 'c_nationkey')} FROM customer")
register("distinct_star", "SELECT DISTINCT * FROM nation", f"SELECT DISTINCT {named('nation', *NATION)} FROM nation")
register("distinct_join", f"SELECT DISTINCT nation.n_name, orders.o_orderpriority FROM customer,orders,nation WHERE {CO},{CN}", f"SELECT DISTINCT {named('nation', 'n_name')}, {named('orders', 'o_orderpriority')} FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey")
register("order_asc", "SELECT customer.c_custkey, customer.c_acctbal FROM customer ORDERBY customer.c_acctbal ASC", f"SELECT {named('customer', 'c_custkey', 'c_acctbal')} FROM customer ORDER BY c_acctbal")
register("order_desc_two", "SELECT customer.c_nationkey, customer.c_custkey FROM customer ORDERBY customer.c_nationkey, customer.c_custkey DESC", f"SELECT {named('customer', 'c_nationkey', 'c_custkey')} FROM customer ORDER BY c_nationkey DESC, c_custkey DESC")
register("order_unselected", "SELECT customer.c_name FROM customer ORDERBY customer.c_acctbal", f"SELECT {named('customer', 'c_name')} FROM customer ORDER BY c_acctbal")
register("order_star", "SELECT * FROM supplier,nation WHERE supplier.s_nationkey=nation.n_nationkey ORDERBY supplier.s_acctbal", f"SELECT {named('supplier', *SUPPLIER)}, {named('nation', *NATION)} FROM supplier, nation WHERE s_nationkey = n_nationkey ORDER BY s_acctbal")
FLAGSHIP = f"SELECT nation.n_name, COUNT(lineitem.l_orderkey), SUM(lineitem.l_quantity), MAX(lineitem.l_extendedprice) {FOUR} GROUPBY nation.n_name ORDERBY nation.n_name"
register("flagship", FLAGSHIP, f"SELECT n_name AS nation_n_name, count(l_orderkey) AS count_lineitem_l_orderkey, sum(l_quantity) AS sum_lineitem_l_quantity, max(l_extendedprice) AS max_lineitem_l_extendedprice {FOUR_SQL} GROUP BY n_name ORDER BY n_name")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


# sources, indexes and sinks
DEFINITION = ("5", "84", "id INTEGER 500 PK 4", "grp INTEGER 7 NK 4", "ref INTEGER 500 FK 4", "amount REAL 90 NK 4", "name STRING 34 NK 68")


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def det_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(definitions.definition_rows(definitions.parse_definition(DEFINITION)), "name string, type string, range long, key string, bytes long")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fixed about a generated table, whatever the seed."""
    made = generate.generate(spark, definitions.parse_definition(DEFINITION), 500, seed=11)
    made.createOrReplaceTempView("quillon_generated")
    return spark.sql("SELECT count(*) AS n, count(DISTINCT id) AS ids, min(id) AS first_id, max(id) AS last_id, count_if(grp BETWEEN 0 AND 6) AS grps, count_if(amount >= 0 AND amount < 90) AS amounts, count_if(name RLIKE '^[a-z]{34}$') AS names FROM quillon_generated")


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = engine(spark, sf_dir).catalog.table("supplier")
    source, target = _new_path(spark, "text"), _new_path(spark, "table")
    text.write_table_text(table, source)
    return text.ingest(spark, source, table.schema, target)


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.table_statistics(engine(spark, sf_dir).catalog.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), exact=True)


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.result_lines(engine(spark, sf_dir).sql("SELECT nation.n_nationkey, nation.n_name FROM nation"))


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.dump_lines(engine(spark, sf_dir).catalog.table("region"))


def _sorted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = engine(spark, sf_dir).catalog.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return indexes.build_sorted(table, ["o_custkey", "o_orderkey"], _new_path(spark, "index"))


def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.search(_sorted_orders(spark, sf_dir), "o_custkey", 37)


def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.search_range(_sorted_orders(spark, sf_dir), "o_custkey", 20, 40, high_inclusive=False)


def index_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of the last customer that has orders, by both keys."""
    index = _sorted_orders(spark, sf_dir)
    last = indexes.last_key(index, "o_custkey")
    own = indexes.search(index, "o_custkey", last)
    return indexes.search(own, "o_orderkey", indexes.first_key(own, "o_orderkey"))


def index_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _sorted_orders(spark, sf_dir)
    return spark.createDataFrame([(indexes.first_key(index, "o_custkey"), indexes.last_key(index, "o_custkey"))], "first_key long, last_key long")


def index_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, orders = _new_path(spark, "index"), engine(spark, sf_dir).catalog.table("orders").select("o_orderkey", "o_custkey")
    indexes.build_sorted(orders.filter("o_custkey >= 100"), ["o_custkey"], path)
    indexes.insert(spark, path, orders.filter("o_custkey < 100"), ["o_custkey"])
    return indexes.search_range(spark.read.parquet(path), "o_custkey", 90, 110)


def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _sorted_orders(spark, sf_dir)
    return indexes.search_range(indexes.delete(index, "o_custkey", 37, _new_path(spark, "index"), ["o_custkey"]), "o_custkey", 30, 40)


#: Bucketed copies by application, folder, table and key: each is built once.
_bucketed: dict[tuple[str, str, str, str], str] = {}


def _bucketed_copy(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    at = (spark.sparkContext.applicationId, sf_dir, table, key)
    if at not in _bucketed:
        name = f"quillon_{table}_{key}_{uuid.uuid4().hex}"
        indexes.build_bucketed(engine(spark, sf_dir).catalog.table(table), [key], name, int(spark.conf.get("spark.sql.shuffle.partitions")), _new_path(spark, "buckets"))
        _bucketed[at] = name
    return spark.table(_bucketed[at])


def join_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two copies with equal buckets by the key meet without a shuffle."""
    session = engine(spark, sf_dir)
    for table, key in (("orders", "o_custkey"), ("customer", "c_custkey")):
        session.catalog.add_index(table, key, _bucketed_copy(spark, sf_dir, table, key))
    return session.sql(EQUI, "index")


def join_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = engine(spark, sf_dir)
    for table, key in (("supplier", "s_nationkey"), ("nation", "n_nationkey")):
        session.catalog.add_index(table, key, indexes.build_sorted(session.catalog.table(table), [key], _new_path(spark, "index")))
    return session.sql("SELECT supplier.s_suppkey, nation.n_nationkey FROM supplier,nation WHERE supplier.s_nationkey>=nation.n_nationkey", "index")


def join_index_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index join of tables without an index."""
    return engine(spark, sf_dir).sql(EQUI, "index")


def declared_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of which some columns are declared, read by that schema."""
    catalog = Catalog(spark)
    catalog.add("customer", f"{sf_dir}/customer.parquet", T.StructType.fromDDL("c_custkey bigint, c_name string"))
    return Engine(spark, catalog).sql("SELECT * FROM customer")


def text_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows parted by blanks, tabs and runs of both."""
    table = engine(spark, sf_dir).catalog.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    source, target = _new_path(spark, "text"), _new_path(spark, "table")
    table.select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("  \t"), F.col("o_custkey").cast("string"), F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("\t"))).write.text(source)
    return text.ingest(spark, source, table.schema, target, blanks=True)


def stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_path(spark, "statistics")
    statistics.write_statistics(engine(spark, sf_dir).catalog.table("supplier").select("s_suppkey", "s_nationkey"), path, exact=True)
    found = statistics.read_statistics(spark, path)
    return spark.createDataFrame([(c, found.rows, n) for c, n in found.distinct.items()], "column string, n_rows long, n_distinct long")


def join_by_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest table is listed first and joined last."""
    session = engine(spark, sf_dir)
    for table in ("lineitem", "orders", "customer", "nation"):
        path = _new_path(spark, "statistics")
        statistics.write_statistics(session.catalog.table(table), path)
        session.catalog.add_statistics(table, statistics.read_statistics(spark, path))
    return session.sql(f"SELECT nation.n_name, COUNT(lineitem.l_orderkey) FROM lineitem,orders,customer,nation WHERE {CO},{OL},{CN} GROUPBY nation.n_name")


def plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the printed plan shows the join and the filter in the scan, and whether it has a cost."""
    session, query = engine(spark, sf_dir), f'{EQUI},orders.o_totalprice>"1000"'
    printed = session.explain(query)
    return spark.createDataFrame([("Join" in printed, "GreaterThan(o_totalprice,1000.0)" in printed, session.cost(query).size_in_bytes > 0)], "joins boolean, filters boolean, costs boolean")


def sort_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.sort_table(engine(spark, sf_dir).catalog.table("supplier"), ["s_acctbal", "s_suppkey"], _new_path(spark, "sorted"))


QUERIES |= {f.__name__: f for f in (det_schema, generated, text_round_trip, table_stats, result_lines, dump_lines, index_search, index_range, index_composite, index_bounds, index_insert, index_delete, join_index, join_index_range, join_index_absent, declared_schema, text_blanks, stored_statistics, join_by_statistics, plan_text, sort_tool)}
ORACLE_SQL |= {
    "det_schema": "SELECT * FROM (VALUES ('id', 'INTEGER', 500::BIGINT, 'PK', 4::BIGINT), ('grp', 'INTEGER', 7, 'NK', 4), ('ref', 'INTEGER', 500, 'FK', 4), ('amount', 'REAL', 90, 'NK', 4), ('name', 'STRING', 34, 'NK', 68)) t(name, type, range, key, bytes)",
    "generated": "SELECT 500::BIGINT AS n, 500::BIGINT AS ids, 0::INTEGER AS first_id, 499::INTEGER AS last_id, 500::BIGINT AS grps, 500::BIGINT AS amounts, 500::BIGINT AS names",
    "text_round_trip": "SELECT * FROM supplier",
    "table_stats": "SELECT 'c_custkey' AS \"column\", count(*) AS n_rows, count(DISTINCT c_custkey) AS n_distinct FROM customer UNION ALL SELECT 'c_nationkey', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer",
    "result_lines": "SELECT n_nationkey || chr(9) || n_name || chr(9) AS line FROM nation",
    "dump_lines": "SELECT r_regionkey || ',' || r_name AS line FROM region",
    "index_search": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 37",
    "index_range": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey >= 20 AND o_custkey < 40",
    "index_composite": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders) ORDER BY o_orderkey LIMIT 1",
    "index_bounds": "SELECT min(o_custkey) AS first_key, max(o_custkey) AS last_key FROM orders",
    "index_insert": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 90 AND 110",
    "index_delete": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey BETWEEN 30 AND 40 AND o_custkey <> 37",
    "join_index": EQUI_SQL,
    "join_index_range": f"SELECT {named('supplier', 's_suppkey')}, {named('nation', 'n_nationkey')} FROM supplier, nation WHERE s_nationkey >= n_nationkey",
    "join_index_absent": EQUI_SQL,
    "declared_schema": f"SELECT {named('customer', 'c_custkey', 'c_name')} FROM customer",
    "text_blanks": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "stored_statistics": "SELECT 's_suppkey' AS \"column\", count(*) AS n_rows, count(DISTINCT s_suppkey) AS n_distinct FROM supplier UNION ALL SELECT 's_nationkey', count(*), count(DISTINCT s_nationkey) FROM supplier",
    "join_by_statistics": "SELECT n_name AS nation_n_name, count(l_orderkey) AS count_lineitem_l_orderkey FROM lineitem, orders, customer, nation WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey GROUP BY n_name",
    "plan_text": "SELECT true AS joins, true AS filters, true AS costs",
    "sort_tool": "SELECT * FROM supplier",
}
