"""The relational tables of the test data as a property graph and as triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph, edge_table, node_table, stacked

#: A node's id is the offset of its label plus its key.
OFFSETS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "User": 7}
STRIDE = 1_000_000_000_000


def node_id(label: str, key: str | Column) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("long") + F.lit(OFFSETS[label] * STRIDE)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, and the edges between them.

    Ids of edges are those of their own row where it has a key; order lines have none, so theirs is a hash of all they hold.
    """
    t = {n: read(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    node = lambda label, table, id_, /, **props: node_table(t[table], label, node_id(label, id_), **props)
    nodes = {
        "Region": node("Region", "region", "r_regionkey", key=F.col("r_regionkey").cast("long"), name="r_name"),
        "Nation": node("Nation", "nation", "n_nationkey", key=F.col("n_nationkey").cast("long"), name="n_name"),
        "Customer": node("Customer", "customer", "c_custkey", key="c_custkey", name="c_name", acctbal="c_acctbal", mktsegment="c_mktsegment"),
        "Supplier": node("Supplier", "supplier", "s_suppkey", key="s_suppkey", name="s_name", acctbal="s_acctbal"),
        "Part": node(
            "Part", "part", "p_partkey", key="p_partkey", name="p_name", brand="p_brand", kind="p_type", size=F.col("p_size").cast("long"), price="p_retailprice",
        ),
        "Order": node("Order", "orders", "o_orderkey", key="o_orderkey", status="o_orderstatus", total="o_totalprice", day="o_orderdate", priority="o_orderpriority"),
    }
    line = t["lineitem"]
    edges = {
        "IN_REGION": edge_table(t["nation"], "IN_REGION", node_id("Nation", "n_nationkey"), node_id("Region", "n_regionkey"), F.col("n_nationkey")),
        "FROM_NATION": stacked([
            edge_table(t["customer"], "FROM_NATION", node_id("Customer", "c_custkey"), node_id("Nation", "c_nationkey"), F.col("c_custkey")),
            edge_table(t["supplier"], "FROM_NATION", node_id("Supplier", "s_suppkey"), node_id("Nation", "s_nationkey"), F.col("s_suppkey") + STRIDE),
        ]),
        "PLACED": edge_table(t["orders"], "PLACED", node_id("Customer", "o_custkey"), node_id("Order", "o_orderkey"), F.col("o_orderkey")),
        "CONTAINS": edge_table(
            line, "CONTAINS", node_id("Order", "l_orderkey"), node_id("Part", "l_partkey"), quantity="l_quantity", price="l_extendedprice",
            discount="l_discount", shipped="l_shipdate", supplier="l_suppkey", line=F.col("l_linenumber").cast("long"),
        ),
        "SHIPS": edge_table(line.select("l_suppkey", "l_partkey").distinct(), "SHIPS", node_id("Supplier", "l_suppkey"), node_id("Part", "l_partkey")),
    }
    return PropertyGraph(spark, nodes, edges)


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations and TRADES edges: what customers of one nation bought from suppliers of another; weight is the rounded sum."""
    nation, customer, supplier = (read(spark, sf_dir, n) for n in ("nation", "customer", "supplier"))
    orders, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    trades = (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey")
        .agg(F.round(F.sum("l_extendedprice"), 0).cast("long").alias("weight"), F.count("*").alias("lines"))
    )
    return PropertyGraph(
        spark,
        {"Nation": node_table(nation, "Nation", "n_nationkey", name="n_name", region=F.col("n_regionkey").cast("long"))},
        {"TRADES": edge_table(trades, "TRADES", F.col("c_nationkey"), F.col("s_nationkey"), F.col("c_nationkey") * 1000 + F.col("s_nationkey"), weight="weight", lines="lines")},
    )


def supply_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Orders, parts and suppliers: CONTAINS and SERVED_BY of order lines, SHIPS between suppliers and parts; each pair once."""
    star = star_graph(spark, sf_dir)
    line = read(spark, sf_dir, "lineitem")
    served = line.select("l_orderkey", "l_suppkey").distinct()
    contains = line.select("l_orderkey", "l_partkey").distinct()
    edges = {
        "CONTAINS": edge_table(contains, "CONTAINS", node_id("Order", "l_orderkey"), node_id("Part", "l_partkey")),
        "SERVED_BY": edge_table(served, "SERVED_BY", node_id("Order", "l_orderkey"), node_id("Supplier", "l_suppkey")),
        "SHIPS": star.edges["SHIPS"],
    }
    return PropertyGraph(spark, {n: star.nodes[n] for n in ("Order", "Part", "Supplier")}, edges)
