"""Batch updates: a graph with vertices or edges added or removed."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.sources import builders

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph


def _graph(vertices, edges) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(vertices, edges)


def add_vertices(g: PropertyGraph, other: DataFrame, merge: str = "min") -> PropertyGraph:
    """With the vertices of ``other(id, attr)``; its attribute wins where both have an id."""
    new = builders.distinct_vertices(other, merge).select("id", F.col("attr").alias("new"), F.lit(True).alias("found"))
    v = g.vertices.join(new, "id", "full").select("id", F.when(F.col("found"), F.col("new")).otherwise(F.col("attr")).alias("attr"))
    return _graph(v, g.edges)


def remove_vertices(g: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the vertices of ``ids(id)`` and without edges at them."""
    gone = ids.select("id")
    e = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return _graph(g.vertices.join(gone, "id", "left_anti"), e.select("src", "dst", "attr"))


def add_edges(g: PropertyGraph, edges: DataFrame, default_attr: object = None, complete_vertices: bool = True, merge: str = "min") -> PropertyGraph:
    """With the edges of ``edges``; an edge that stands already keeps its attribute. End
    points that are no vertices are added with ``default_attr``."""
    new = builders.distinct_edges(edges, merge).join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    e = g.edges.unionByName(new.select("src", "dst", F.col("attr").cast(g.edges.schema["attr"].dataType).alias("attr")))
    return _graph(builders.with_endpoints(g.vertices, edges, default_attr) if complete_vertices else g.vertices, e)


def remove_edges(g: PropertyGraph, pairs: DataFrame) -> PropertyGraph:
    """Without the edges of ``pairs(src, dst)``; unknown pairs are passed over."""
    return _graph(g.vertices, g.edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti"))
