"""From rows to the tables of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgraph.operators.expressions import merged


def whole(edges: DataFrame) -> DataFrame:
    """Edges with both ends; a null end is no vertex."""
    return edges.filter("src is not null and dst is not null")


def distinct_edges(edges: DataFrame, merge: str | Callable = "min") -> DataFrame:
    """One edge per pair. The default keeps the least attribute, whatever the order."""
    return whole(edges).groupBy("src", "dst").agg(merged(merge, F.col("attr")).alias("attr"))


def distinct_vertices(vertices: DataFrame, merge: str | Callable = "min") -> DataFrame:
    """One vertex per id; null ids are no vertices."""
    return vertices.filter("id is not null").groupBy("id").agg(merged(merge, F.col("attr")).alias("attr"))


def endpoints(edges: DataFrame) -> DataFrame:
    """The ids at the ends of edges, once each; edges with a null end have none."""
    return whole(edges).select(F.explode(F.array(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))).alias("id")).distinct()


def vertices_of(edges: DataFrame, default_attr: object = None) -> DataFrame:
    return endpoints(edges).withColumn("attr", F.lit(default_attr))


def with_endpoints(vertices: DataFrame, edges: DataFrame, default_attr: object = None) -> DataFrame:
    """The vertices, and end points that are none yet, with the default attribute."""
    kind = vertices.schema["attr"].dataType
    new = endpoints(edges).join(vertices.select("id"), "id", "left_anti").withColumn("attr", F.lit(default_attr).cast(kind))
    return vertices.select("id", "attr").unionByName(new)


def routing_table(edges: DataFrame, partition: Column | None = None) -> DataFrame:
    """``(id, pid, position)``: which edge partitions need a vertex, and as what (bit 1:
    source, bit 2: target). Partitions are the present ones, or those of an expression."""
    placed = edges.select("src", "dst", (partition if partition is not None else F.spark_partition_id()).cast("int").alias("pid"))
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("p")), F.struct(F.col("dst").alias("id"), F.lit(2).alias("p")))
    return placed.select("pid", F.explode(ends).alias("x")).groupBy("x.id", "pid").agg(F.bit_or("x.p").alias("position"))
