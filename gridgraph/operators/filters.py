"""Filters of vertices and edges."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgraph.operators.expressions import Triplet
from gridgraph.operators.joins import mask

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph


def _graph(vertices, edges) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(vertices, edges)


def subgraph(g: PropertyGraph, epred: Callable[[Triplet], Column] | None = None, vpred: Callable[[Column, Column], Column] | None = None) -> PropertyGraph:
    """Vertices for which vpred(id, attr) holds, and edges between two of these for which
    epred(triplet) holds."""
    v = g.vertices.filter(vpred(F.col("id"), F.col("attr"))) if vpred else g.vertices
    t = Triplet()
    kept = epred(t) if epred else None
    e = g.edges
    for side, reads in (("src", t.reads_src), ("dst", t.reads_dst)):
        if reads:
            e = e.join(v.select(F.col("id").alias(side), F.col("attr").alias(f"{side}_attr")), side)
        elif vpred:
            e = e.join(v.select(F.col("id").alias(side)), side, "left_semi")
    return _graph(v, e.filter(kept).select("src", "dst", "attr") if epred else e.select("src", "dst", "attr"))


def filter_graph(g: PropertyGraph, preprocess: Callable[[PropertyGraph], PropertyGraph], epred: Callable[[Triplet], Column] | None = None, vpred: Callable[[Column, Column], Column] | None = None) -> PropertyGraph:
    """What passes the predicates after preprocessing, with this graph's own attributes."""
    return mask(g, subgraph(preprocess(g), epred, vpred))


def remove_self_edges(g: PropertyGraph) -> PropertyGraph:
    return _graph(g.vertices, g.edges.filter("src <> dst"))


def active_edges(edges: DataFrame, direction: str | None) -> DataFrame:
    """Edges whose ``src_active`` and ``dst_active`` meet a direction: 'out' (source), 'in'
    (target), 'both', 'either', or None (all)."""
    s, d = F.col("src_active"), F.col("dst_active")
    rules = {"out": s, "in": d, "both": s & d, "either": s | d}
    if direction is None:
        return edges
    if direction not in rules:
        raise ValueError(f"direction {direction!r} is none of {sorted(rules)}")
    return edges.filter(rules[direction])


def pick_random_vertex(g: PropertyGraph, seed: int | None = None) -> int | None:
    """A vertex id, each with equal chance; None if there is none."""
    row = g.vertices.select("id").orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1).first()
    return row.id if row else None
