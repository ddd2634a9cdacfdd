"""Nested document views over flat tables, and reads narrowed to the leaves an expression uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their line items as an ordered collection `item`, empty for orders without. Both sides meet on one
    shuffle by order key; collections are as long as an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(*ITEM))).alias("item"))
    item = F.coalesce("item", F.slice("item", 1, 0), F.expr("array()").cast(lines.schema["item"].dataType))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("item", item)


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, each with its line items."""
    orders = order_documents(spark, sf_dir).groupBy(F.col("o_custkey").alias("c_custkey"))
    orders = orders.agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice", "item"))).alias("order"))
    order = F.coalesce("order", F.expr("array()").cast(orders.schema["order"].dataType))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").withColumn("order", order)


def leaves(c: Column, *fields: str) -> Column:
    """A collection of structs with only these fields, in a form from which Spark reads no others: lambdas over the
    whole collection would read every field of it."""
    return F.arrays_zip(*(c[f].alias(f) for f in fields))
