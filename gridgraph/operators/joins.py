"""Joins of graphs with each other and with tables. All are equi-joins on ids, left to
Catalyst to plan; nothing is broadcast by hint, as either side may be large."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgraph.operators.expressions import merged

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph


def _graph(vertices, edges) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(vertices, edges)


def triplets(g: PropertyGraph, src: bool = True, dst: bool = True) -> DataFrame:
    """Edges with ``src_attr`` and ``dst_attr``, as asked."""
    out = g.edges
    for side, wanted in (("src", src), ("dst", dst)):
        if wanted:
            out = out.join(g.vertices.select(F.col("id").alias(side), F.col("attr").alias(f"{side}_attr")), side)
    return out.select("src", "dst", "attr", *[f"{s}_attr" for s, w in (("src", src), ("dst", dst)) if w])


def _once(other: DataFrame, value: str, merge: str | Callable) -> DataFrame:
    """One row of ``other`` for each id, repeated ones merged; the join then finds it
    partitioned already."""
    return other.groupBy("id").agg(merged(merge, F.col(value)).alias("value"))


def outer_join_vertices(g: PropertyGraph, other: DataFrame, f: Callable[[Column, Column, Column], Column], value: str = "value", merge: str | Callable = "min") -> PropertyGraph:
    """Vertex attributes f(id, attr, value), where ``value`` is null for vertices that
    ``other(id, value)`` lacks; its ids that are no vertices are passed over, and values of
    repeated ids are merged (into the least)."""
    v = g.vertices.join(_once(other, value, merge), "id", "left")
    return _graph(v.select("id", f(F.col("id"), F.col("attr"), F.col("value")).alias("attr")), g.edges)


def join_vertices(g: PropertyGraph, other: DataFrame, f: Callable[[Column, Column, Column], Column], value: str = "value", merge: str | Callable = "min") -> PropertyGraph:
    """As outer_join_vertices for vertices that ``other`` has (even with a null value);
    the others keep their attribute."""
    v = g.vertices.join(_once(other, value, merge).withColumn("found", F.lit(True)), "id", "left")
    new = F.when(F.col("found"), f(F.col("id"), F.col("attr"), F.col("value"))).otherwise(F.col("attr"))
    return _graph(v.select("id", new.alias("attr")), g.edges)


def mask(g: PropertyGraph, other: PropertyGraph) -> PropertyGraph:
    """The vertices and edges that the other graph has too, with this graph's attributes."""
    return _graph(g.vertices.join(other.vertices.select("id"), "id", "left_semi"), g.edges.join(other.edges.select("src", "dst"), ["src", "dst"], "left_semi"))


def inner_join_edges(g: PropertyGraph, other: PropertyGraph | DataFrame, f: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Edges of both, with attributes f(src, dst, attr, other attr)."""
    edges = other if isinstance(other, DataFrame) else other.edges
    both = g.edges.join(edges.select("src", "dst", F.col("attr").alias("other_attr")), ["src", "dst"])
    return both.select("src", "dst", f(F.col("src"), F.col("dst"), F.col("attr"), F.col("other_attr")).alias("attr"))


def inner_join_values(a: DataFrame, b: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Vertex tables (id, attr): ids of both, with f(id, attr, other attr)."""
    return a.join(b.select("id", F.col("attr").alias("other")), "id").select("id", f(F.col("id"), F.col("attr"), F.col("other")).alias("attr"))


def left_join_values(a: DataFrame, b: DataFrame, f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Vertex tables (id, attr): ids of a, with f(id, attr, other attr or null)."""
    return a.join(b.select("id", F.col("attr").alias("other")), "id", "left").select("id", f(F.col("id"), F.col("attr"), F.col("other")).alias("attr"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that both vertex tables have with different attributes, with b's."""
    return a.select("id", F.col("attr").alias("old")).join(b, "id").filter(~F.col("old").eqNullSafe(F.col("attr"))).select("id", "attr")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Vertices of a whose ids b lacks."""
    return a.join(b.select("id"), "id", "left_anti")


def with_active(vertices: DataFrame, active: DataFrame) -> DataFrame:
    """Vertices with a boolean ``active``: whether ``active`` has the id."""
    marked = active.select("id").distinct().withColumn("active", F.lit(True))
    return vertices.join(marked, "id", "left").withColumn("active", F.coalesce("active", F.lit(False)))
