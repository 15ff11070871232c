"""Graphs of the star-schema tables that the queries run on. Parts stand above PART, so
that their ids meet no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridgraph.graph import PropertyGraph

PART = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, with the quantity of all their lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst")).agg(F.sum("l_quantity").cast("bigint").alias("attr"))


def supply_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation, parts with their size."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("attr"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + PART).alias("id"), F.col("p_size").cast("bigint").alias("attr"))
    return s.unionAll(p)


def supply(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    return PropertyGraph(supply_vertices(spark, sf_dir), supply_edges(spark, sf_dir))


def buys_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to part, with the number of lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines.join(orders, "l_orderkey").groupBy(F.col("o_custkey").alias("src"), (F.col("l_partkey") + PART).alias("dst")).agg(F.count(F.lit(1)).alias("attr"))


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to the part of the next line of an order, with how often that is so."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
    return steps.filter("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("attr"))


def flow(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """All parts, with their size, and the flow between them."""
    v = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("bigint").alias("attr"))
    return PropertyGraph(v, flow_edges(spark, sf_dir))


def copurchase(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts, and pairs of different parts (smaller to larger) in one order, with how many
    orders have both."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    e = a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("attr"))
    return PropertyGraph(flow(spark, sf_dir).vertices, e)


def geo(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The tree of regions, nations, customers and suppliers; ids are dealt by level:
    regions 0, nations 1, customers 2, suppliers 3, plus four times the key."""
    n, c, s = (table(spark, sf_dir, x) for x in ("nation", "customer", "supplier"))
    up = lambda key, level: (F.col(key).cast("bigint") * 4 + level)
    e = (
        n.select(up("n_regionkey", 0).alias("src"), up("n_nationkey", 1).alias("dst"))
        .unionAll(c.select(up("c_nationkey", 1), up("c_custkey", 2)))
        .unionAll(s.select(up("s_nationkey", 1), up("s_suppkey", 3)))
    )
    v = table(spark, sf_dir, "region").select(up("r_regionkey", 0).alias("id")).unionAll(e.select("dst"))
    return PropertyGraph(v.withColumn("attr", F.col("id") % 4), e.withColumn("attr", F.col("dst") % 4))
