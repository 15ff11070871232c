"""Direction-sensitive values on a graph of nine edges, and the rules of every operator."""

import pytest
from gridgraph import PropertyGraph
from gridgraph.operators import joins
from pyspark.sql import functions as F

EDGES = [(1, 2, 10), (2, 3, 20), (3, 1, 30), (3, 4, 40), (4, 5, 50), (5, 4, 60), (6, 7, 70), (7, 7, 80), (1, 3, 15)]


@pytest.fixture(scope="module")
def g(spark):
    v = spark.createDataFrame([(i, 20 * i) for i in range(1, 9)], "id bigint, attr bigint").repartition(5)
    e = spark.createDataFrame(EDGES, "src bigint, dst bigint, attr bigint").repartition(6)
    return PropertyGraph(v.cache(), e.cache())


def rows(df):
    return sorted(map(tuple, df.collect()))


def attrs(g):
    return dict(rows(g.vertices))


def pairs(g):
    return {(s, d): a for s, d, a in rows(g.edges)}


def close(g, want, digits=8):
    assert {k: round(v, digits) for k, v in attrs(g).items()} == {k: round(v, digits) for k, v in want.items()}


def test_triplets_and_maps(g):
    assert rows(g.triplets()) == sorted((s, d, a, 20 * s, 20 * d) for s, d, a in EDGES)
    assert g.triplets(dst=False).columns == ["src", "dst", "attr", "src_attr"]
    assert attrs(g.map_vertices(lambda i, a: a + i)) == {i: 21 * i for i in range(1, 9)}
    assert pairs(g.map_edges(lambda s, d, a: a * 2)) == {(s, d): 2 * a for s, d, a in EDGES}
    assert pairs(g.map_triplets(lambda t: t.attr + t.src_attr - t.dst_attr)) == {(s, d): a + 20 * (s - d) for s, d, a in EDGES}
    assert pairs(g.reverse()) == {(d, s): a for s, d, a in EDGES}
    assert rows(g.reverse().reverse().edges) == rows(g.edges)


def test_map_triplets_joins_only_ends_that_are_read(g):
    plan = g.map_triplets(lambda t: t.attr + t.src_attr).edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_map_edge_partitions(g):
    def double(_pid, frames):
        for f in frames:
            yield f.assign(attr=f["attr"] * 2)

    assert pairs(g.map_edge_partitions(double, "bigint")) == {(s, d): 2 * a for s, d, a in EDGES}


def test_degrees(g):
    assert dict(rows(g.in_degrees())) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1, 7: 2}
    assert dict(rows(g.out_degrees())) == {1: 2, 2: 1, 3: 2, 4: 1, 5: 1, 6: 1, 7: 1}
    assert dict(rows(g.degrees())) == {1: 3, 2: 2, 3: 4, 4: 3, 5: 2, 6: 1, 7: 3}
    assert sum(n for _, n in rows(g.degrees())) == 2 * len(EDGES)


def test_neighbours(g):
    ids = {d: dict(rows(g.collect_neighbor_ids(d))) for d in ("in", "out", "either")}
    assert ids["in"] == {1: [3], 2: [1], 3: [1, 2], 4: [3, 5], 5: [4], 6: [], 7: [6, 7], 8: []}
    assert ids["out"] == {1: [2, 3], 2: [3], 3: [1, 4], 4: [5], 5: [4], 6: [7], 7: [7], 8: []}
    assert ids["either"] == {1: [2, 3, 3], 2: [1, 3], 3: [1, 1, 2, 4], 4: [3, 5, 5], 5: [4, 4], 6: [7], 7: [6, 7, 7], 8: []}
    assert {k: [tuple(x) for x in v] for k, v in rows(g.collect_neighbors("in"))}[3] == [(1, 20), (2, 40)]
    edges = {k: [(x.src, x.dst) for x in v] for k, v in rows(g.collect_edges("in"))}
    assert edges == {1: [(3, 1)], 2: [(1, 2)], 3: [(1, 3), (2, 3)], 4: [(3, 4), (5, 4)], 5: [(4, 5)], 7: [(6, 7), (7, 7)]}
    assert [(x.src, x.dst) for x in dict(rows(g.collect_edges("either")))[7]] == [(6, 7), (7, 7), (7, 7)]
    for collect in (g.collect_neighbor_ids, g.collect_neighbors, g.collect_edges):
        with pytest.raises(ValueError):
            collect("both")


def test_canonical_and_self_edges(g):
    assert pairs(g.convert_to_canonical_edges("sum")) == {(1, 2): 10, (1, 3): 45, (2, 3): 20, (3, 4): 40, (4, 5): 110, (6, 7): 70, (7, 7): 80}
    assert g.remove_self_edges().num_edges() == 8
    assert pairs(g.group_edges("sum")) == pairs(g)


def test_messages(g, spark):
    sums = g.aggregate_messages(to_src=lambda t: t.attr, to_dst=lambda t: t.src_attr, merge="sum")
    assert dict(rows(sums)) == {1: 85, 2: 40, 3: 130, 4: 210, 5: 140, 6: 70, 7: 340}
    active = spark.createDataFrame([(1,), (3,)], "id bigint")
    count = lambda d: dict(rows(g.aggregate_messages(to_dst=lambda t: F.lit(1), merge="sum", active=active, direction=d)))
    assert count("out") == {1: 1, 2: 1, 3: 1, 4: 1}
    assert count("in") == {1: 1, 3: 2}
    assert count("both") == {1: 1, 3: 1}
    assert count("either") == {1: 1, 2: 1, 3: 2, 4: 1}
    with pytest.raises(ValueError):
        g.aggregate_messages(to_dst=lambda t: F.lit(1), direction="out")
    many = g.aggregate_messages(to_dst=lambda t: F.array(F.lit(1), F.lit(2)), merge="sum", many=True)
    assert dict(rows(many)) == {1: 3, 2: 3, 3: 6, 4: 6, 5: 3, 7: 6}


def test_joins(g, spark):
    other = spark.createDataFrame([(1, 1), (99, 5)], "id bigint, value bigint")
    assert attrs(g.join_vertices(other, lambda i, a, u: a + u)) == {i: 20 * i + (i == 1) for i in range(1, 9)}
    assert attrs(g.outer_join_vertices(other, lambda i, a, u: F.coalesce(u, F.lit(-1)))) == {i: 1 if i == 1 else -1 for i in range(1, 9)}
    null = spark.createDataFrame([(1, None)], "id bigint, value bigint")
    assert attrs(g.join_vertices(null, lambda i, a, u: u))[1] is None
    plus = g.vertices.withColumn("attr", F.when(F.col("id") < 3, F.col("attr") + 1).otherwise(F.col("attr")))
    assert rows(joins.diff(g.vertices, plus)) == [(1, 21), (2, 41)]
    assert [r[0] for r in rows(joins.minus(g.vertices, g.vertices.filter("id < 4")))] == [4, 5, 6, 7, 8]
    assert rows(joins.inner_join_values(g.vertices, plus.filter("id < 3"), lambda i, a, b: b - a)) == [(1, 1), (2, 1)]
    assert dict(rows(joins.left_join_values(g.vertices, plus.filter("id < 3"), lambda i, a, b: b)))[5] is None


def test_edge_join_keeps_the_last_match(spark):
    # A merge that stops when one side ends would lose it.
    make = lambda ids: spark.createDataFrame([(i, i, i) for i in ids], "src bigint, dst bigint, attr bigint")
    a, b = PropertyGraph.from_edges(make([0, 1])), PropertyGraph.from_edges(make([1]))
    assert rows(a.inner_join_edges(b, lambda s, d, x, y: x + y)) == [(1, 1, 2)]
    assert rows(a.inner_join_edges(b.edges, lambda s, d, x, y: x + y)) == [(1, 1, 2)]


def test_subgraph_filter_mask(g):
    s = g.subgraph(lambda t: t.attr >= 20, lambda i, a: i != 5)
    assert sorted(attrs(s)) == [1, 2, 3, 4, 6, 7, 8]
    assert sorted(pairs(s)) == [(2, 3), (3, 1), (3, 4), (6, 7), (7, 7)]
    f = g.filter(lambda x: x.map_vertices(lambda i, a: i), lambda t: t.attr > 15, lambda i, a: a <= 4)
    assert pairs(f) == {(2, 3): 20, (3, 1): 30, (3, 4): 40}
    assert attrs(f) == {i: 20 * i for i in range(1, 5)}
    m = g.mask(g.subgraph(vpred=lambda i, a: i >= 4).map_vertices(lambda i, a: F.lit(0)))
    assert attrs(m) == {i: 20 * i for i in range(4, 9)} and sorted(pairs(m)) == [(4, 5), (5, 4), (6, 7), (7, 7)]
    assert g.pick_random_vertex(3) in range(1, 9)


def test_builders(spark, g):
    e = spark.createDataFrame([(10, 10, 10)] * 10 + [(10, 11, 3), (10, 11, 2)], "src bigint, dst bigint, attr bigint")
    made = PropertyGraph.from_edges(e, 7)
    assert pairs(made) == {(10, 10): 10, (10, 11): 2} and attrs(made) == {10: 7, 11: 7}
    v = spark.createDataFrame([(10, 1), (10, 5), (12, 2), (None, 9)], "id bigint, attr bigint")
    assert attrs(PropertyGraph.of(v, e, 0, "max")) == {10: 5, 11: 0, 12: 2}
    assert attrs(PropertyGraph.of(v, e))[11] is None
    assert pairs(PropertyGraph.from_edge_tuples(e.select("src", "dst"))) == {(10, 10): 1, (10, 11): 1}
    assert pairs(PropertyGraph.from_edge_tuples(e.select("src", "dst"), count_duplicates=True)) == {(10, 10): 10, (10, 11): 2}
    assert sorted(attrs(PropertyGraph.from_edges(g.edges, 7))) == [1, 2, 3, 4, 5, 6, 7]
    routed = {(r.id, r.pid): r.position for r in g.routing_table(F.pmod("src", F.lit(2))).collect()}
    assert routed[1, 1] == 3 and routed[7, 0] == 2 and routed[7, 1] == 3 and (8, 0) not in routed
    with pytest.raises(ValueError):
        PropertyGraph(v.drop("attr"), e)
    with pytest.raises(TypeError):
        PropertyGraph(v.withColumn("id", F.col("id").cast("string")), e)


def test_updates(spark, g):
    new = spark.createDataFrame([(1, 0), (9, 180)], "id bigint, attr bigint")
    assert attrs(g.add_vertices(new)) == {i: 20 * i for i in range(1, 10)} | {1: 0}
    gone = g.remove_vertices(spark.createDataFrame([(3,), (50,)], "id bigint"))
    assert 3 not in attrs(gone) and sorted(pairs(gone)) == [(1, 2), (4, 5), (5, 4), (6, 7), (7, 7)]
    more = spark.createDataFrame([(1, 2, 99), (8, 9, 5)], "src bigint, dst bigint, attr bigint")
    added = g.add_edges(more, default_attr=-1)
    assert pairs(added) == pairs(g) | {(8, 9): 5} and attrs(added)[9] == -1
    assert 9 not in attrs(g.add_edges(more, complete_vertices=False))
    # Removing what was added gives the graph again; pairs out of any range alias nothing.
    fewer = added.remove_edges(spark.createDataFrame([(8, 9), (70000, 1), (0, 13)], "src bigint, dst bigint"))
    assert pairs(fewer) == pairs(g)


def test_removing_vertices_keeps_edges_of_others(spark):
    loops = PropertyGraph.from_edges(spark.createDataFrame([(i, i, 10 * i) for i in range(10)], "src bigint, dst bigint, attr bigint").repartition(4))
    assert sorted(pairs(loops.remove_vertices(spark.range(5)))) == [(i, i) for i in range(5, 10)]


def test_empty_graphs(spark):
    v = spark.createDataFrame([], "id bigint, attr bigint")
    e = spark.createDataFrame([], "src bigint, dst bigint, attr bigint")
    none = PropertyGraph(v, e)
    assert none.num_vertices() == none.num_edges() == 0
    assert none.max_vertex_id() is None and none.pick_random_vertex() is None
    for out in (none.connected_components(), none.triangle_count(), none.static_page_rank(2), none.page_rank(0.1), none.strongly_connected_components(2), none.shortest_paths([1]), none.add_edges(e), none.subgraph(lambda t: t.attr > 1)):
        assert out.num_edges() == 0 and rows(out.vertices) == []


def test_storage(spark, g):
    kept = g.checkpoint()
    assert kept.is_checkpointed() and not g.is_checkpointed() and len(kept.checkpoint_files()) == 2 and g.checkpoint_files() == []
    assert pairs(kept) == pairs(g)
    h = PropertyGraph(g.vertices.filter("id > 0"), g.edges.filter("src > 0")).persist()
    assert h.vertices.storageLevel.useMemory and h.edges.storageLevel.useDisk
    h.unpersist()
    assert not h.edges.storageLevel.useMemory
    assert g.set_name("name") is g


PR01 = {1: 0.5495099026, 2: 0.3981196625, 3: 0.6355945489, 4: 1.8717611462, 5: 1.5555896983, 6: 0.2793822192, 7: 2.4306606030, 8: 0.2793822192}
PR0001 = {1: 0.4505119637, 2: 0.3596348845, 3: 0.6640477447, 4: 2.1340037607, 5: 1.9815884624, 6: 0.1685379294, 7: 2.0731373251, 8: 0.1685379294}
STATIC5 = {1: 0.5357616149, 2: 0.4021243772, 3: 0.7571171438, 4: 2.0384494209, 5: 1.8609530376, 6: 0.1678321678, 7: 2.0699300699, 8: 0.1678321678}
PPR = {1: 0.2259241660, 2: 0.0959611667, 3: 0.1773466106, 4: 0.2707447282, 5: 0.2300233285, 6: 0, 7: 0, 8: 0}
SPPR = {1: 0.2604804102, 2: 0.0989182520, 3: 0.2183565332, 4: 0.2409819727, 5: 0.1812628320, 6: 0, 7: 0, 8: 0}


def test_page_rank(g):
    close(g.page_rank(0.1), PR01)
    close(g.page_rank(0.001), PR0001)
    close(g.static_page_rank(5), STATIC5)
    assert round(pairs(g.static_page_rank(1))[1, 2], 3) == 0.5


def test_personalized_page_rank(spark, g):
    close(g.personalized_page_rank(1, 0.001), PPR)
    close(g.static_personalized_page_rank(1, 5), SPPR)
    both = g.static_parallel_personalized_page_rank(spark.createDataFrame([(1,), (6,)], "id bigint"), 5)
    found = {(s, i): round(x, 8) for s, i, x in rows(both)}
    assert {i: found.get((1, i), 0) for i in range(1, 9)} == {k: round(v, 8) for k, v in SPPR.items()}
    assert round(sum(x for (s, _), x in found.items() if s == 6), 6) == 1


def test_components(g):
    assert attrs(g.connected_components()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8}
    assert attrs(g.connected_components(1)) == {1: 1, 2: 1, 3: 1, 4: 3, 5: 4, 6: 6, 7: 6, 8: 8}
    assert attrs(g.strongly_connected_components(5)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def test_long_path_is_one_component(spark):
    n = 300
    e = spark.range(n - 1).select(((F.col("id") * 7919) % n).alias("src"), (((F.col("id") + 1) * 7919) % n).alias("dst"), F.lit(1).alias("attr"))
    assert set(attrs(PropertyGraph.from_edges(e).connected_components()).values()) == {0}


def test_triangles_paths_and_top(g):
    assert attrs(g.triangle_count()) == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}
    assert attrs(g.shortest_paths([4, 1])) == {1: {1: 0, 4: 2}, 2: {1: 2, 4: 2}, 3: {1: 1, 4: 1}, 4: {4: 0}, 5: {4: 1}, 6: {}, 7: {}, 8: {}}
    inf = float("inf")
    assert attrs(g.weighted_shortest_paths(1)) == {1: 0, 2: 10, 3: 15, 4: 55, 5: 105, 6: inf, 7: inf, 8: inf}
    assert [r.id for r in g.top_ranked(3).collect()] == [8, 7, 6]


@pytest.mark.parametrize("direction", ["out", "both", "in", "either"])
def test_pregel_directions(g, direction):
    start = g.map_vertices(lambda i, a: F.when(i == 1, 1).otherwise(0))
    out = start.pregel(F.lit(0), lambda i, a, m: a + m, to_dst=lambda t: F.lit(1), merge="sum", max_iterations=2, direction=direction)
    want = {1: 3, 2: 2, 3: 4, 4: 4, 5: 2, 6: 0, 7: 3 if direction in ("out", "both") else 4, 8: 0}
    assert attrs(out) == want


def test_messages_to_no_vertices_are_dropped(spark):
    v = spark.createDataFrame([(1, 5), (2, 6)], "id bigint, attr bigint")
    e = spark.createDataFrame([(1, 2, 10), (1, 9, 20), (8, 2, 30)], "src bigint, dst bigint, attr bigint")
    g = PropertyGraph(v, e)
    assert dict(rows(g.aggregate_messages(to_dst=lambda t: t.attr))) == {2: 40}
    assert dict(rows(g.aggregate_messages(to_dst=lambda t: t.src_attr))) == {2: 5}
    assert dict(rows(g.aggregate_messages(to_src=lambda t: t.attr, to_dst=lambda t: t.attr))) == {1: 30, 2: 40}
    plan = g.aggregate_messages(to_dst=lambda t: t.dst_attr)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_messages_of_a_python_function(g, spark):
    def send(frames):
        for f in frames:
            yield f.assign(id=f["dst"], m=f["src_attr"])[["id", "m"]]
            yield f.assign(id=f["src"], m=f["attr"])[["id", "m"]]
            yield f.assign(id=99, m=1)[["id", "m"]]

    assert dict(rows(g.aggregate_messages_in_python(send, "bigint"))) == {1: 85, 2: 40, 3: 130, 4: 210, 5: 140, 6: 70, 7: 340}


def test_null_ends_and_ids_are_left_out(spark):
    v = spark.createDataFrame([(1, 1), (None, 2)], "id bigint, attr bigint")
    e = spark.createDataFrame([(1, 2, 1), (None, 2, 2), (1, None, 3), (None, None, 4)], "src bigint, dst bigint, attr bigint")
    for g in (PropertyGraph.of(v, e, 0), PropertyGraph.from_edges(e, 0), PropertyGraph.from_edge_tuples(e.select("src", "dst"), 0), PropertyGraph.from_edge_tuples(e.select("src", "dst"), 0, count_duplicates=True), PropertyGraph.of(v, e.limit(0), 0).add_edges(e, 0)):
        assert sorted(attrs(g)) == [1, 2] and list(pairs(g)) == [(1, 2)]


def test_repeated_ids_do_not_multiply_vertices(g, spark):
    other = spark.createDataFrame([(1, 7), (1, 3), (1, None), (2, None)], "id bigint, value bigint")
    assert attrs(g.outer_join_vertices(other, lambda i, a, u: u)) == {1: 3} | dict.fromkeys(range(2, 9))
    assert attrs(g.outer_join_vertices(other, lambda i, a, u: u, merge="sum"))[1] == 10
    assert attrs(g.join_vertices(other, lambda i, a, u: u)) == {1: 3, 2: None} | {i: 20 * i for i in range(3, 9)}


def test_pregel_needs_a_direction(g):
    with pytest.raises(ValueError):
        g.pregel(F.lit(0), lambda i, a, m: a, to_dst=lambda t: F.lit(1), direction="up")


def test_late_supersteps_join_active_vertices_alone(spark):
    n = 40
    v = spark.range(n).withColumn("attr", F.when(F.col("id") == 0, 0).otherwise(1000))
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("attr"))
    for direction, graph in (("out", PropertyGraph(v, e)), ("in", PropertyGraph(v, e).reverse())):
        send = {"to_dst" if direction == "out" else "to_src": (lambda t: F.when(t.src_attr + 1 < t.dst_attr, t.src_attr + 1)) if direction == "out" else (lambda t: F.when(t.dst_attr + 1 < t.src_attr, t.dst_attr + 1))}
        out = graph.pregel(F.lit(1000), lambda i, a, m: F.least(a, m), merge="min", max_iterations=6, direction=direction, **send)
        assert attrs(out) == {i: i if i <= 6 else 1000 for i in range(n)}


def test_no_local_folder_on_a_cluster(spark):
    from gridgraph.plans import lineage

    class Conf:
        def get(self, _key, default=None):
            return default

    class Context:
        master, set_to = "yarn", None

        def getConf(self):
            return Conf()

        def setCheckpointDir(self, path):
            self.set_to = path

        @property
        def _jsc(self):
            return self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return self

        def isEmpty(self):
            return self.set_to is None

        def get(self):
            return self.set_to

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        lineage.ensure_checkpoint_dir(Session)
    Session.sparkContext.master = "local[3]"
    assert lineage.ensure_checkpoint_dir(Session)
