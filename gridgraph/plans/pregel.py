"""Supersteps: messages along edges of active vertices, merged, and a vertex program."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridgraph.operators.expressions import Triplet
from gridgraph.operators.filters import active_edges
from gridgraph.operators.messages import Message, receive
from gridgraph.plans.lineage import cut

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph

#: Directions in which the vertex at an end of an edge has to be active.
NEEDED = {"src": ("out", "both"), "dst": ("in", "both")}


def pregel(
    g: PropertyGraph, initial: Column, vprog: Callable[[Column, Column, Column], Column], to_src: Message | None = None, to_dst: Message | None = None,
    merge: str | Callable = "sum", max_iterations: int | None = None, direction: str = "either", many: bool = False,
) -> PropertyGraph:
    """First vprog(id, attr, initial) runs everywhere and every edge sends. Then, while
    there are messages and at most ``max_iterations`` times, vprog runs where messages
    came in, and edges send whose source ('out'), target ('in'), either or both ends had
    one. A superstep's vertices are written to the shared folder, which cuts the plan.
    """
    from gridgraph.graph import PropertyGraph

    if direction not in ("out", "in", "both", "either"):
        raise ValueError(f"direction {direction!r} is none of out, in, both, either")
    t = Triplet()
    sent = [(side, f(t)) for side, f in (("src", to_src), ("dst", to_dst)) if f is not None]
    reads = {"src": t.reads_src or direction != "in", "dst": t.reads_dst or direction != "out"}
    edges = cut(g.edges)
    attr = vprog(F.col("id"), F.col("attr"), initial)
    state = cut(g.vertices.select("id", attr.alias("attr"), F.lit(True).alias("active")))
    done = 0
    while max_iterations is None or done < max_iterations:
        e = edges
        for side, wanted in reads.items():
            if wanted:
                # Where the direction needs this side to be active, only active vertices are
                # joined: few of them, so that late supersteps need not shuffle all edges.
                v = state.filter("active") if direction in NEEDED[side] else state
                e = e.join(v.select(F.col("id").alias(side), F.col("attr").alias(f"{side}_attr"), F.col("active").alias(f"{side}_active")), side)
        if direction == "either" and done:
            e = active_edges(e, direction)
        received = receive(e, sent, merge, many).select("id", F.col("attr").alias("message"), F.lit(True).alias("got"))
        joined = state.join(received, "id", "left")
        new = F.when(F.col("got"), vprog(F.col("id"), F.col("attr"), F.col("message"))).otherwise(F.col("attr"))
        after = cut(joined.select("id", new.alias("attr"), F.coalesce("got", F.lit(False)).alias("active")))
        if after.filter("active").isEmpty():
            break
        state, done = after, done + 1
    return PropertyGraph(state.select("id", "attr"), edges)
