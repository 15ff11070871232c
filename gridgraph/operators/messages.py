"""Messages along edges, merged at their receivers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgraph.operators import joins
from gridgraph.operators.expressions import Triplet, merged
from gridgraph.operators.filters import active_edges

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph

Message = Callable[[Triplet], Column]


def aggregate_messages(
    g: PropertyGraph, to_src: Message | None = None, to_dst: Message | None = None, merge: str | Callable = "sum",
    active: DataFrame | None = None, direction: str | None = None, many: bool = False,
) -> DataFrame:
    """``(id, attr)``: for each vertex that gets a message, all of its messages merged.

    A message is a Column of the triplet; null sends none, and with ``many`` it is an
    array of messages. ``active(id)`` and ``direction`` restrict which edges send. Merges
    by name or by an aggregate Column are summed before the shuffle. Messages to ids
    that are no vertices are dropped.
    """
    t = Triplet()
    sent = [(side, f(t)) for side, f in (("src", to_src), ("dst", to_dst)) if f is not None]
    if not sent:
        raise ValueError("one of to_src and to_dst has to send")
    e = g.edges
    if direction is not None and active is None:
        raise ValueError("a direction needs an active set")
    ids = None if active is None or direction is None else active.select("id").distinct()
    for side, reads in (("src", t.reads_src), ("dst", t.reads_dst)):
        if reads:
            e = e.join(g.vertices.select(F.col("id").alias(side), F.col("attr").alias(f"{side}_attr")), side)
    if ids is not None:
        # A direction that needs one side is a semi-join; 'either' has to flag both.
        if direction in ("out", "in", "both"):
            for side, wanted in (("src", direction != "in"), ("dst", direction != "out")):
                if wanted:
                    e = e.join(ids.select(F.col("id").alias(side)), side, "left_semi")
        else:
            for side in ("src", "dst"):
                e = e.join(ids.select(F.col("id").alias(side), F.lit(True).alias(f"{side}_active")), side, "left")
            e = active_edges(e.fillna(False, ["src_active", "dst_active"]), direction)
    out = receive(e, sent, merge, many)
    if all({"src": t.reads_src, "dst": t.reads_dst}[side] for side, _ in sent):
        return out  # the receivers were joined as vertices
    return out.join(g.vertices.select("id"), "id", "left_semi")


def aggregate_messages_in_python(g: PropertyGraph, send: Callable[[Iterator], Iterator], message_type: str, merge: str | Callable = "sum") -> DataFrame:
    """As aggregate_messages, for messages that Columns can't express: ``send`` makes of an
    iterator of pandas frames of triplets (src, dst, attr, src_attr, dst_attr) one of frames
    of (id, m), any number of rows for each triplet. Rows pass through Python in Arrow
    batches; null messages are none, and merging stays in the JVM."""
    sent = joins.triplets(g).mapInPandas(send, f"id bigint, m {message_type}")
    out = sent.filter("id is not null and m is not null").groupBy("id").agg(merged(merge, F.col("m")).alias("attr"))
    return out.join(g.vertices.select("id"), "id", "left_semi")


def receive(edges: DataFrame, sent: list[tuple[str, Column]], merge: str | Callable, many: bool = False) -> DataFrame:
    """Messages of ``edges``, given as (receiving side, Column), merged by receiver."""
    if len(sent) == 1:
        side, message = sent[0]
        out = edges.select(F.col(side).alias("id"), message.alias("m"))
    else:
        # One pass over the edges, not a union of two.
        out = edges.select(F.explode(F.array(*[F.struct(F.col(s).alias("id"), m.alias("m")) for s, m in sent])).alias("x")).select("x.id", "x.m")
    if many:
        out = out.select("id", F.explode("m").alias("m"))
    return out.filter("m is not null").groupBy("id").agg(merged(merge, F.col("m")).alias("attr"))
