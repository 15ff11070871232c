"""Maps of attributes; the structure stays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridgraph.operators.expressions import Triplet
from gridgraph.operators.joins import triplets

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph


def _graph(vertices, edges) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(vertices, edges)


def map_vertices(g: PropertyGraph, f: Callable[[Column, Column], Column]) -> PropertyGraph:
    """New vertex attributes f(id, attr)."""
    return _graph(g.vertices.select("id", f(F.col("id"), F.col("attr")).alias("attr")), g.edges)


def map_edges(g: PropertyGraph, f: Callable[[Column, Column, Column], Column]) -> PropertyGraph:
    """New edge attributes f(src, dst, attr)."""
    return _graph(g.vertices, g.edges.select("src", "dst", f(F.col("src"), F.col("dst"), F.col("attr")).alias("attr")))


def map_edge_partitions(g: PropertyGraph, f: Callable[[int, Iterator], Iterator], attr_type: str) -> PropertyGraph:
    """New edge attributes from a function of (partition number, iterator of pandas frames
    of src, dst, attr) to frames of the same columns, row for row. For what Columns
    can't express: rows pass through Python."""

    def run(batches):
        from pyspark import TaskContext

        return f(TaskContext.get().partitionId(), batches)

    return _graph(g.vertices, g.edges.mapInPandas(run, f"src bigint, dst bigint, attr {attr_type}"))


def map_triplets(g: PropertyGraph, f: Callable[[Triplet], Column]) -> PropertyGraph:
    """New edge attributes from a function of the triplet; only ends that it reads are joined."""
    t = Triplet()
    attr = f(t)
    return _graph(g.vertices, triplets(g, t.reads_src, t.reads_dst).select("src", "dst", attr.alias("attr")))


def reverse(g: PropertyGraph) -> PropertyGraph:
    return _graph(g.vertices, g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "attr"))
