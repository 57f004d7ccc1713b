"""The statements under analysis, run on the test tables.

Dimensions are joined without hints: Spark broadcasts a side only below its
size threshold, and falls back to a sort-merge join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colflow.workload.corpora import load


def _cents(column: str):
    """Money as an exact number, so that sums do not depend on their order."""
    return F.col(column).cast("decimal(18,2)")


def data_customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders")
    return customer.join(orders, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", F.col("c_name").alias("customer_name"), "c_mktsegment",
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
    )


def data_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    customer, part = load(spark, sf_dir, "customer"), load(spark, sf_dir, "part")
    total = F.col("l_quantity") * F.col("l_extendedprice") * (1 - F.col("l_discount") / 100)
    return (
        lineitem.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .select(
            "o_orderkey", F.col("c_name").alias("customer_name"), F.col("p_name").alias("product_name"),
            "l_quantity", "l_extendedprice", "l_discount", total.alias("line_total"),
        )
    )


def data_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its parent (half its key), as a category with its parent
    category; the parent side is unique, so no row multiplies."""
    part = load(spark, sf_dir, "part")
    a, b = part.alias("a"), part.alias("b")
    parent = F.floor(F.col("a.p_partkey") / 2).cast("bigint")
    return a.join(b, parent == F.col("b.p_partkey")).select(
        F.col("a.p_partkey").alias("part_id"), F.col("a.p_name").alias("part_name"),
        F.col("b.p_partkey").alias("parent_id"), F.col("b.p_name").alias("parent_name"),
    )


def data_composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each (part, supplier) pair sold returned against not returned."""
    sold = load(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(
        F.sum(_cents("l_quantity")).alias("quantity")
    )
    kept = sold.filter("l_returnflag <> 'R'").groupBy("l_partkey", "l_suppkey").agg(F.sum("quantity").alias("kept"))
    back = sold.filter("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.col("quantity").alias("returned"))
    return kept.join(back, ["l_partkey", "l_suppkey"]).select(
        "l_partkey", "l_suppkey", F.col("kept").cast("double").alias("kept"),
        F.col("returned").cast("double").alias("returned"),
    )


def data_two_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by supplier's nation and customer's nation. Lines meet their
    order once; the result is summed map-side before its shuffle."""
    nation = load(spark, sf_dir, "nation")
    supplier_nation = (
        load(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    )
    customer_nation = (
        load(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", F.col("n_name").alias("customer_nation"))
    )
    return (
        load(spark, sf_dir, "lineitem")
        .join(supplier_nation, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(load(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customer_nation, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("supplier_nation", "customer_nation")
        .agg(F.sum(_cents("l_extendedprice")).cast("double").alias("revenue"))
    )


def data_two_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part, supplier = (load(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    return (
        lineitem.join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .select("l_orderkey", "l_linenumber", "p_name", "s_name", "l_quantity")
    )


def data_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(_cents("l_extendedprice")).cast("double").alias("line_sum"), F.count("*").alias("n_lines")
    )
    return (
        load(spark, sf_dir, "orders")
        .join(totals, F.col("o_orderkey") == F.col("l_orderkey"))
        .select("o_orderkey", "o_totalprice", "line_sum", "n_lines")
    )


def data_insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a customer dimension, as an INSERT ... SELECT would write them."""
    customer, nation, region = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return (
        customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
            F.upper("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
        )
    )
