"""Iterative graph algorithms. Loops run on the driver, rows never do: each round is one
plan over whole tables, cut in the shared folder."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.operators.neighbours import convert_to_canonical_edges, out_degrees
from gridgraph.plans.lineage import cut
from gridgraph.plans.pregel import pregel

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph

RESET = 0.15


def _graph(vertices, edges) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(vertices, edges)


def transition_edges(g: PropertyGraph) -> DataFrame:
    """Edges whose attribute is one over the source's number of edges."""
    degree = out_degrees(g).withColumnRenamed("id", "src")
    return g.edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("attr"))


def _scaled(ranks: DataFrame, total: float | None = None) -> DataFrame:
    """Ranks scaled so that they sum up to ``total`` (None: to their number); all stay as
    they are if they sum to 0. The sum is one row, whatever the size of the graph."""
    whole = ranks.agg(F.coalesce(F.sum("attr"), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("n")).first()
    factor = (whole.n if total is None else total) / whole["sum"] if whole["sum"] else 1.0
    return ranks.select("id", (F.col("attr") * factor).alias("attr"))


def static_page_rank(g: PropertyGraph, iterations: int, reset: float = RESET, source: int | None = None, cut_every: int = 5) -> PropertyGraph:
    """Ranks after a number of rounds; edges carry one over the source's out-degree. Ranks
    sum to the number of vertices, or to 1 if they are personalized to ``source``."""
    edges = cut(transition_edges(g))
    start = F.lit(1.0) if source is None else F.when(F.col("id") == source, 1.0).otherwise(0.0)
    base = F.lit(reset) if source is None else F.when(F.col("id") == source, reset).otherwise(0.0)
    ranks = g.vertices.select("id", start.alias("attr"))
    for k in range(iterations):
        sent = edges.join(ranks.select(F.col("id").alias("src"), F.col("attr").alias("rank")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("attr")).alias("sum"))
        ranks = g.vertices.select("id").join(sent, "id", "left").select("id", (base + (1 - reset) * F.coalesce("sum", F.lit(0.0))).alias("attr"))
        if (k + 1) % cut_every == 0:
            ranks = cut(ranks)
    return _graph(_scaled(cut(ranks), None if source is None else 1.0), edges)


def static_personalized_page_rank(g: PropertyGraph, source: int, iterations: int, reset: float = RESET) -> PropertyGraph:
    return static_page_rank(g, iterations, reset, source)


def static_parallel_personalized_page_rank(g: PropertyGraph, sources: DataFrame, iterations: int, reset: float = RESET, cut_every: int = 5) -> DataFrame:
    """``(source, id, attr)`` for each source of ``sources(id)``: what single runs give,
    all sources in one plan. Ids without rank have no row."""
    edges = cut(transition_edges(g))
    chosen = g.vertices.select("id").join(sources.select("id").distinct(), "id", "left_semi")
    ranks = chosen.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("attr"))
    base = chosen.select(F.col("id").alias("source"), "id", F.lit(reset).alias("attr"))
    for k in range(iterations):
        sent = edges.withColumnRenamed("attr", "w").join(ranks.withColumnRenamed("id", "src"), "src").select("source", F.col("dst").alias("id"), ((1 - reset) * F.col("w") * F.col("attr")).alias("attr"))
        ranks = sent.unionByName(base).groupBy("source", "id").agg(F.sum("attr").alias("attr"))
        if (k + 1) % cut_every == 0:
            ranks = cut(ranks)
    ranks = cut(ranks)
    total = ranks.groupBy("source").agg(F.sum("attr").alias("total"))
    return ranks.join(total, "source").select("source", "id", (F.col("attr") / F.col("total")).alias("attr"))


def page_rank(g: PropertyGraph, tolerance: float, reset: float = RESET, source: int | None = None) -> PropertyGraph:
    """Ranks until no change is larger than the tolerance; scaled as static ranks are."""
    edges = transition_edges(g)
    if source is None:
        v, initial = g.vertices.select("id", F.struct(F.lit(0.0).alias("rank"), F.lit(0.0).alias("delta")).alias("attr")), F.lit(reset / (1 - reset))
    else:
        v = g.vertices.select("id", F.struct(F.lit(0.0).alias("rank"), F.when(F.col("id") == source, F.lit(float("-inf"))).otherwise(0.0).alias("delta")).alias("attr"))
        initial = F.lit(0.0)

    def program(_id, attr, message):
        rank = attr["rank"] + (1 - reset) * message
        if source is not None:
            rank = F.when(attr["delta"] == float("-inf"), 1.0).otherwise(rank)
        return F.struct(rank.alias("rank"), (rank - attr["rank"]).alias("delta"))

    out = pregel(_graph(v, edges), initial, program, to_dst=lambda t: F.when(t.src_attr["delta"] > tolerance, t.src_attr["delta"] * t.attr), merge="sum", direction="out")
    ranks = out.vertices.select("id", F.col("attr")["rank"].alias("attr"))
    return _graph(_scaled(ranks, None if source is None else 1.0), out.edges)


def personalized_page_rank(g: PropertyGraph, source: int, tolerance: float, reset: float = RESET) -> PropertyGraph:
    return page_rank(g, tolerance, reset, source)


def component_labels(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the least node of its connected
    component. Nodes may be of any type that can be ordered.

    A round hands every node the least label among its neighbours, lets labels that met
    a lesser one follow it, and replaces labels by their labels' labels; so paths shrink
    by half or more, and rounds are about logarithmic in the longest path.
    """
    both = cut(edges.filter("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("m").alias("near"))
        step = labels.join(near, "node").select("node", "m", F.least("m", "near").alias("near"))
        follow = step.groupBy(F.col("m").alias("node")).agg(F.min("near").alias("follow"))
        hooked = cut(step.join(follow, "node", "left").select("node", "m", F.least("near", F.coalesce("follow", "near")).alias("n")))
        jump = hooked.select(F.col("node").alias("n"), F.col("n").alias("root"))
        new = F.least("n", F.coalesce("root", "n"))
        moved = cut(hooked.join(jump, "n", "left").select("node", new.alias("m"), (F.col("m") != new).alias("changed")))
        labels = moved.select("node", "m")
        if moved.filter("changed").isEmpty():
            return labels.select("node", F.col("m").alias("root"))


def connected_components(g: PropertyGraph, max_iterations: int | None = None) -> PropertyGraph:
    """Each vertex with the least id that it is connected to, whatever the directions. A
    bound on iterations bounds how far ids travel; without one, labels jump."""
    if max_iterations is not None:
        start = _graph(g.vertices.select("id", F.col("id").alias("attr")), g.edges)
        out = pregel(
            start, F.lit(2**63 - 1).cast("bigint"), lambda i, a, m: F.least(a, m),
            to_src=lambda t: F.when(t.dst_attr < t.src_attr, t.dst_attr), to_dst=lambda t: F.when(t.src_attr < t.dst_attr, t.src_attr),
            merge="min", max_iterations=max_iterations, direction="either",
        )
        return _graph(out.vertices, g.edges)
    labels = component_labels(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
    return _graph(g.vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("root", "id").alias("attr")), g.edges)


def strongly_connected_components(g: PropertyGraph, iterations: int) -> PropertyGraph:
    """Each vertex with the least id of its strongly connected component.

    An iteration lets go vertices without edges in or out (their own components), colours
    the others with the least id that reaches them, and lets go those that reach their
    colour's vertex backwards within the colour. Vertices left after the last iteration
    have the least id that reaches them.
    """
    left = cut(g.edges.filter("src <> dst").select("src", "dst"))
    ids = cut(g.vertices.select("id"))
    final: list[DataFrame] = []
    colour = ids.select("id", F.col("id").alias("attr"))
    for _ in range(iterations):
        while True:  # vertices that no cycle can hold
            ends = left.select(F.col("src").alias("id")).distinct().join(left.select(F.col("dst").alias("id")).distinct(), "id")
            inside = cut(ids.join(ends, "id", "left_semi"))
            out = ids.join(inside, "id", "left_anti")
            if out.isEmpty():
                break
            final.append(cut(out.select("id", F.col("id").alias("attr"))))
            ids = inside
            left = cut(left.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if ids.isEmpty():
            colour = ids.select("id", F.col("id").alias("attr"))
            break
        start = _graph(ids.select("id", F.col("id").alias("attr")), left.withColumn("attr", F.lit(0)))
        colour = pregel(start, F.lit(2**63 - 1).cast("bigint"), lambda i, a, m: F.least(a, m), to_dst=lambda t: F.when(t.src_attr < t.dst_attr, t.src_attr), merge="min", direction="out").vertices
        own = F.struct(F.col("attr").alias("colour"), (F.col("id") == F.col("attr")).alias("back"))
        back = pregel(
            _graph(colour.select("id", own.alias("attr")), left.withColumn("attr", F.lit(0))), F.lit(False),
            lambda i, a, m: F.struct(a["colour"].alias("colour"), (a["back"] | m).alias("back")),
            to_src=lambda t: F.when(t.dst_attr["back"] & ~t.src_attr["back"] & (t.src_attr["colour"] == t.dst_attr["colour"]), F.lit(True)), merge="bool_or", direction="in",
        ).vertices
        found = cut(back.filter("attr.back").select("id", F.col("attr.colour").alias("attr")))
        final.append(found)
        ids = cut(ids.join(found, "id", "left_anti"))
        left = cut(left.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        colour = colour.join(ids, "id", "left_semi")
    for f in final:
        colour = colour.unionByName(f)
    return _graph(cut(colour), g.edges)


def triangle_count(g: PropertyGraph) -> PropertyGraph:
    """Each vertex with the number of triangles that it is a corner of, without regard to
    direction and self-edges.

    Every edge points from the end of lower degree to the other (ties by id), so that no
    vertex has more than about the square root of all edges going out, and pairs of edges
    out of a vertex stay few even at hubs.
    """
    canonical = convert_to_canonical_edges(_graph(g.vertices, g.edges.filter("src <> dst").withColumn("attr", F.lit(1))), "min").edges
    pairs = cut(canonical.select("src", "dst"))
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    ranked = pairs.join(degree.select(F.col("id").alias("src"), F.col("d").alias("sd")), "src").join(degree.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("sd") < F.col("dd")) | ((F.col("sd") == F.col("dd")) & (F.col("src") < F.col("dst")))
    out = cut(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.a") == F.col("y.a")).filter(F.col("x.b") < F.col("y.b")).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    closed = wedge.join(pairs.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
    corner = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    v = g.vertices.select("id").join(corner, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("bigint").alias("attr"))
    return _graph(v, g.edges)


def shortest_paths(g: PropertyGraph, landmarks: list[int] | DataFrame) -> PropertyGraph:
    """Each vertex with a map from landmark to the number of edges on the way to it, along
    their directions; landmarks out of reach are not in the map."""
    spark = g.edges.sparkSession
    marks = landmarks.select("id") if not isinstance(landmarks, list) else spark.createDataFrame([(x,) for x in landmarks], "id bigint")
    edges = cut(g.edges.select("src", F.col("dst").alias("id")))
    edge_of = g.vertices.select("id").join(marks.distinct(), "id", "left_semi")
    known = cut(edge_of.select("id", F.col("id").alias("landmark"), F.lit(0).alias("hops")))
    last, hops = known, 0
    while not last.isEmpty():
        hops += 1
        reached = last.join(edges, "id").select(F.col("src").alias("id"), "landmark").distinct()
        last = cut(reached.join(known, ["id", "landmark"], "left_anti").select("id", "landmark", F.lit(hops).alias("hops")))
        known = known.unionByName(last)
        if hops % 10 == 0:
            known = cut(known)
    maps = known.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("landmark", "hops")))).alias("attr"))
    none = F.create_map().cast("map<bigint,int>")
    return _graph(g.vertices.select("id").join(maps, "id", "left").select("id", F.coalesce("attr", none).alias("attr")), g.edges)


def weighted_shortest_paths(g: PropertyGraph, source: int) -> PropertyGraph:
    """Each vertex with the least sum of edge attributes (not negative) on a way from the
    source; infinity if there is none."""
    far = F.lit(float("inf"))
    start = _graph(g.vertices.select("id", F.when(F.col("id") == source, 0.0).otherwise(far).alias("attr")), g.edges.select("src", "dst", F.col("attr").cast("double").alias("attr")))
    return pregel(start, far, lambda i, a, m: F.least(a, m), to_dst=lambda t: F.when(t.src_attr + t.attr < t.dst_attr, t.src_attr + t.attr), merge="min", direction="out")


def top_ranked(g: PropertyGraph, k: int) -> DataFrame:
    """The k vertices of highest attribute, ties to the smaller id."""
    return g.vertices.orderBy(F.desc("attr"), "id").limit(k)
