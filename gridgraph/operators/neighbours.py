"""Degrees, neighbourhoods, and merged edges."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.operators.expressions import merged

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph


def _graph(vertices, edges) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(vertices, edges)


def _ends(edges: DataFrame, direction: str, *values) -> DataFrame:
    """(id, other, values) for each edge at its end: 'in' at the target, 'out' at the
    source, 'either' at both."""
    at = {"in": [("dst", "src")], "out": [("src", "dst")], "either": [("src", "dst"), ("dst", "src")]}.get(direction)
    if at is None:
        raise ValueError("direction has to be 'in', 'out' or 'either'")
    ends = [F.struct(F.col(a).alias("id"), F.col(b).alias("other")) for a, b in at]
    return edges.select(F.explode(F.array(*ends)).alias("x"), *values).select("x.id", "x.other", *values)


def in_degrees(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def out_degrees(g: PropertyGraph) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def degrees(g: PropertyGraph) -> DataFrame:
    """Edges at each vertex that has any; a self-edge counts twice."""
    return _ends(g.edges, "either").groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def collect_neighbor_ids(g: PropertyGraph, direction: str) -> DataFrame:
    """``(id, neighbors)``, sorted; empty for vertices without any. The other end of each
    edge counts, so reciprocal edges and self-edges under 'either' stand twice."""
    found = _ends(g.edges, direction).groupBy("id").agg(F.array_sort(F.collect_list("other")).alias("neighbors"))
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def collect_neighbors(g: PropertyGraph, direction: str) -> DataFrame:
    """As collect_neighbor_ids, with structs of (id, attr)."""
    with_attr = _ends(g.edges, direction).join(g.vertices.select(F.col("id").alias("other"), "attr"), "other")
    found = with_attr.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("other").alias("id"), "attr"))).alias("neighbors"))
    kind = found.schema["neighbors"].dataType
    return g.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("neighbors", F.array().cast(kind)).alias("neighbors"))


def collect_edges(g: PropertyGraph, direction: str) -> DataFrame:
    """``(id, edges)``: the edges at each vertex that has any, as sorted structs."""
    whole = F.struct("src", "dst", "attr").alias("edge")
    ends = _ends(g.edges.select("src", "dst", whole), direction, "edge")
    return ends.groupBy("id").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def group_edges(g: PropertyGraph, merge: str | Callable) -> PropertyGraph:
    """Merged attributes of repeated pairs; a valid graph has none and stays as it is."""
    return _graph(g.vertices, g.edges.groupBy("src", "dst").agg(merged(merge, F.col("attr")).alias("attr")))


def convert_to_canonical_edges(g: PropertyGraph, merge: str | Callable = "min") -> PropertyGraph:
    """Every edge from the smaller to the larger id, pairs that meet merged."""
    turned = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "attr")
    return _graph(g.vertices, turned.groupBy("src", "dst").agg(merged(merge, F.col("attr")).alias("attr")))


def max_vertex_id(g: PropertyGraph) -> int | None:
    return g.vertices.agg(F.max("id")).first()[0]
