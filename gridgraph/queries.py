"""One query for each operator family, over whole tables, and the SQL with the same rows.

Attributes are whole numbers wherever possible, repeated rows are merged by minimum or
sum, arrays are sorted and joined to strings, and ranks are rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgraph.functions import bitset, k2
from gridgraph.graph import PropertyGraph
from gridgraph.operators import joins, partitioning
from gridgraph.plans import algorithms
from gridgraph.plans.lineage import ensure_checkpoint_dir
from gridgraph.sources import builders
from gridgraph.sources.edge_list import random_edges as draw
from gridgraph.sources.edge_list import read_edge_list, write_edge_list
from gridgraph.testgraphs import PART, buys_edges, flow, flow_edges, geo, supply, supply_edges, supply_vertices, table

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

# The graphs again, in SQL.
_CTES = {
    "se": f"se AS (SELECT l_suppkey AS src, l_partkey + {PART} AS dst, CAST(sum(l_quantity) AS BIGINT) AS attr FROM lineitem GROUP BY ALL)",
    "sv": f"sv AS (SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS attr FROM supplier UNION ALL SELECT p_partkey + {PART}, CAST(p_size AS BIGINT) FROM part)",
    "be": f"be AS (SELECT o_custkey AS src, l_partkey + {PART} AS dst, count(*) AS attr FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)",
    "fe": "fe AS (SELECT src, dst, count(*) AS attr FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst FROM lineitem) WHERE dst IS NOT NULL GROUP BY ALL)",
    "fv": "fv AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS attr FROM part)",
    "ce": "ce AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS attr FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL)",
    "ge": "ge AS (SELECT CAST(n_regionkey AS BIGINT) * 4 AS src, CAST(n_nationkey AS BIGINT) * 4 + 1 AS dst FROM nation UNION ALL SELECT CAST(c_nationkey AS BIGINT) * 4 + 1, c_custkey * 4 + 2 FROM customer UNION ALL SELECT CAST(s_nationkey AS BIGINT) * 4 + 1, s_suppkey * 4 + 3 FROM supplier)",
    "gv": "gv AS (SELECT CAST(r_regionkey AS BIGINT) * 4 AS id FROM region UNION ALL SELECT dst FROM ge)",
}


def _sql(names: str, body: str, recursive: bool = False) -> str:
    ctes = ", ".join(_CTES[n] for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{', ' if body.lstrip().startswith('+') else ' '}{body.lstrip().removeprefix('+')}"


def query(name: str, ctes: str = "", sql: str | None = None, recursive: bool = False) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = _sql(ctes, sql, recursive) if ctes else sql
        return f

    return add


def shared(spark, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _joined(column: str, sep: str = ","):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


# Flagship: weighted in-strength of every part that is supplied.
@query("aggregate_messages_sum", "se", "SELECT dst AS id, CAST(sum(attr) AS BIGINT) AS attr FROM se GROUP BY dst")
def aggregate_messages_sum(spark, d):
    return supply(spark, d).aggregate_messages(to_dst=lambda t: t.attr, merge="sum")


# Construction
@query("build_vertices", "se sv", "SELECT id, min(attr) AS attr FROM sv GROUP BY id UNION ALL SELECT DISTINCT id, 0::BIGINT FROM (SELECT src AS id FROM se UNION ALL SELECT dst FROM se) WHERE id NOT IN (SELECT id FROM sv)")
def build_vertices(spark, d):
    return PropertyGraph.of(supply_vertices(spark, d), supply_edges(spark, d), 0).vertices


@query("build_edges_dedup", sql=f"SELECT l_suppkey AS src, l_partkey + {PART} AS dst, max(l_linenumber) AS attr FROM lineitem GROUP BY ALL")
def build_edges_dedup(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART).alias("dst"), F.col("l_linenumber").alias("attr"))
    return builders.distinct_edges(raw, "max")


@query("from_edges_default", "fe", "SELECT DISTINCT unnest([src, dst]) AS id, 7 AS attr FROM fe")
def from_edges_default(spark, d):
    return PropertyGraph.from_edges(flow_edges(spark, d), 7).vertices


@query("from_edge_tuples", sql="SELECT o_custkey AS src, o_orderkey AS dst, CAST(count(*) AS INTEGER) AS attr FROM orders GROUP BY ALL")
def from_edge_tuples(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    return PropertyGraph.from_edge_tuples(pairs, count_duplicates=True).edges


@query("vertex_merge", sql="SELECT o_custkey AS id, max(o_totalprice) AS attr FROM orders GROUP BY ALL")
def vertex_merge(spark, d):
    return builders.distinct_vertices(table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("attr")), "max")


@query("routing_table", "fe", "SELECT id, CAST(pid AS INTEGER) AS pid, CAST(bit_or(p) AS INTEGER) AS position FROM (SELECT (src + dst) % 8 AS pid, unnest([src, dst]) AS id, unnest([1, 2]) AS p FROM fe) GROUP BY ALL")
def routing_table(spark, d):
    return flow(spark, d).routing_table((F.col("src") + F.col("dst")) % 8)


# Triplets and maps
@query("triplets", "se sv", "SELECT se.src, se.dst, se.attr, s.attr AS src_attr, t.attr AS dst_attr FROM se JOIN sv s ON se.src = s.id JOIN sv t ON se.dst = t.id")
def triplets(spark, d):
    return supply(spark, d).triplets()


@query("map_vertices", "sv", "SELECT id, attr * 2 + id AS attr FROM sv")
def map_vertices(spark, d):
    return supply(spark, d).map_vertices(lambda i, a: a * 2 + i).vertices


@query("map_edges", "se", "SELECT src, dst, attr * 2 AS attr FROM se")
def map_edges(spark, d):
    return supply(spark, d).map_edges(lambda s, t, a: a * 2).edges


@query("map_edge_partitions", "se", "SELECT src, dst, attr + 1 AS attr FROM se")
def map_edge_partitions(spark, d):
    def plus_one(_pid, frames):
        for f in frames:
            yield f.assign(attr=f["attr"] + 1)

    return supply(spark, d).map_edge_partitions(plus_one, "bigint").edges


@query("map_triplets", "se sv", "SELECT se.src, se.dst, se.attr + s.attr AS attr FROM se JOIN sv s ON se.src = s.id")
def map_triplets(spark, d):
    return supply(spark, d).map_triplets(lambda t: t.attr + t.src_attr).edges


@query("reverse", "se", "SELECT dst AS src, src AS dst, attr FROM se")
def reverse(spark, d):
    return supply(spark, d).reverse().edges


# Filters
_SUB = (lambda t: (t.attr > 30) & (t.dst_attr > 10), lambda i, a: a < 40)


@query("subgraph_vertices", "sv", "SELECT id, attr FROM sv WHERE attr < 40")
def subgraph_vertices(spark, d):
    return supply(spark, d).subgraph(*_SUB).vertices


@query("subgraph_edges", "se sv", "SELECT se.src, se.dst, se.attr FROM se JOIN sv s ON se.src = s.id AND s.attr < 40 JOIN sv t ON se.dst = t.id AND t.attr < 40 WHERE se.attr > 30 AND t.attr > 10")
def subgraph_edges(spark, d):
    return supply(spark, d).subgraph(*_SUB).edges


@query("graph_filter", "fe fv", "+ o AS (SELECT src AS id, count(*) AS n FROM fe GROUP BY src), p AS (SELECT fv.id, coalesce(o.n, 0) AS n FROM fv LEFT JOIN o ON fv.id = o.id) SELECT fe.src, fe.dst, fe.attr FROM fe JOIN p s ON fe.src = s.id JOIN p t ON fe.dst = t.id WHERE s.n >= 20 AND t.n >= 20 AND fe.attr >= 1")
def graph_filter(spark, d):
    g = flow(spark, d)
    degrees = lambda x: x.outer_join_vertices(x.out_degrees(), lambda i, a, n: F.coalesce(n, F.lit(0)), "degree")
    return g.filter(degrees, lambda t: t.attr >= 1, lambda i, n: n >= 20).edges


@query("remove_self_edges", "fe", "SELECT src, dst, attr FROM fe WHERE src <> dst")
def remove_self_edges(spark, d):
    return flow(spark, d).remove_self_edges().edges


@query("vertex_minus", "se sv", "SELECT id, attr FROM sv WHERE id NOT IN (SELECT src FROM se)")
def vertex_minus(spark, d):
    g = supply(spark, d)
    return joins.minus(g.vertices, g.edges.select(F.col("src").alias("id")))


@query("pick_random_vertex", "fv", "SELECT 6::BIGINT AS members, true AS varied, true AS repeatable FROM (SELECT count(*) FROM fv)")
def pick_random_vertex(spark, d):
    """Vertices by six seeds: all are of the graph, they differ, and a seed repeats itself."""
    g = flow(spark, d)
    picked = [g.pick_random_vertex(seed) for seed in range(6)]
    told = spark.createDataFrame([(i,) for i in picked], "id bigint").join(g.vertices, "id")
    return told.agg(F.count(F.lit(1)).alias("members"), (F.countDistinct("id") > 2).alias("varied"), F.lit(g.pick_random_vertex(0) == picked[0]).alias("repeatable"))


# Joins
@query("mask_edges", "se be", "SELECT a.src, a.dst, a.attr FROM se a WHERE EXISTS (SELECT 1 FROM be b WHERE a.src = b.src AND a.dst = b.dst)")
def mask_edges(spark, d):
    other = PropertyGraph.from_edges(buys_edges(spark, d))
    return supply(spark, d).mask(other).edges


@query("mask_vertices", "sv be", "SELECT id, attr FROM sv WHERE id IN (SELECT unnest([src, dst]) FROM be)")
def mask_vertices(spark, d):
    return supply(spark, d).mask(PropertyGraph.from_edges(buys_edges(spark, d))).vertices


@query("edge_inner_join", "se be", "SELECT a.src, a.dst, a.attr * 1000 + b.attr AS attr FROM se a JOIN be b ON a.src = b.src AND a.dst = b.dst")
def edge_inner_join(spark, d):
    return supply(spark, d).inner_join_edges(buys_edges(spark, d), lambda s, t, a, b: a * 1000 + b)


_BOUGHT = f"b AS (SELECT l_partkey + {PART} AS id, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)"


def _bought(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R'")
    return lines.groupBy((F.col("l_partkey") + PART).alias("id")).agg(F.sum("l_quantity").cast("bigint").alias("value"))


@query("outer_join_vertices", "sv", f"+ {_BOUGHT} SELECT sv.id, coalesce(b.n, -1) AS attr FROM sv LEFT JOIN b ON sv.id = b.id")
def outer_join_vertices(spark, d):
    return supply(spark, d).outer_join_vertices(_bought(spark, d), lambda i, a, n: F.coalesce(n, F.lit(-1))).vertices


@query("join_vertices", "sv", f"+ {_BOUGHT} SELECT sv.id, CASE WHEN b.id IS NOT NULL THEN sv.attr + b.n ELSE sv.attr END AS attr FROM sv LEFT JOIN b ON sv.id = b.id")
def join_vertices(spark, d):
    return supply(spark, d).join_vertices(_bought(spark, d), lambda i, a, n: a + n).vertices


@query("vertex_diff", "sv", f"+ {_BOUGHT} SELECT sv.id, b.n AS attr FROM sv JOIN b ON sv.id = b.id WHERE sv.attr IS DISTINCT FROM b.n")
def vertex_diff(spark, d):
    return joins.diff(supply_vertices(spark, d), _bought(spark, d).withColumnRenamed("value", "attr"))


@query("vertex_inner_join", "sv", f"+ {_BOUGHT} SELECT sv.id, sv.attr + b.n AS attr FROM sv JOIN b ON sv.id = b.id")
def vertex_inner_join(spark, d):
    return joins.inner_join_values(supply_vertices(spark, d), _bought(spark, d).withColumnRenamed("value", "attr"), lambda i, a, b: a + b)


@query("vertex_left_join", "sv", f"+ {_BOUGHT} SELECT sv.id, b.n AS attr FROM sv LEFT JOIN b ON sv.id = b.id")
def vertex_left_join(spark, d):
    return joins.left_join_values(supply_vertices(spark, d), _bought(spark, d).withColumnRenamed("value", "attr"), lambda i, a, b: b)


# Messages
@query("aggregate_messages_min", "se sv", "SELECT se.dst AS id, min(s.attr) AS attr FROM se JOIN sv s ON se.src = s.id GROUP BY ALL")
def aggregate_messages_min(spark, d):
    return supply(spark, d).aggregate_messages(to_dst=lambda t: t.src_attr, merge="min")


@query("aggregate_messages_max", "se sv", "SELECT se.src AS id, max(t.attr * 100 + se.attr) AS attr FROM se JOIN sv t ON se.dst = t.id GROUP BY ALL")
def aggregate_messages_max(spark, d):
    return supply(spark, d).aggregate_messages(to_src=lambda t: t.dst_attr * 100 + t.attr, merge="max")


@query("aggregate_messages_both_ways", "fe", "SELECT id, CAST(sum(m) AS BIGINT) AS attr FROM (SELECT src AS id, attr AS m FROM fe UNION ALL SELECT dst, 1000 * attr FROM fe) GROUP BY ALL")
def aggregate_messages_both_ways(spark, d):
    return flow(spark, d).aggregate_messages(to_src=lambda t: t.attr, to_dst=lambda t: t.attr * 1000, merge="sum")


@query("aggregate_messages_python", "se sv", "SELECT id, CAST(sum(m) AS BIGINT) AS attr FROM (SELECT se.src AS id, se.attr % 7 AS m FROM se WHERE se.attr % 2 = 1 UNION ALL SELECT se.dst, s.attr FROM se JOIN sv s ON se.src = s.id) GROUP BY id")
def aggregate_messages_python(spark, d):
    """Messages from a Python function: to the source for odd edges, to the target always."""

    def send(frames):
        for f in frames:
            odd = f[f["attr"] % 2 == 1]
            yield odd.assign(id=odd["src"], m=odd["attr"] % 7)[["id", "m"]]
            yield f.assign(id=f["dst"], m=f["src_attr"])[["id", "m"]]

    return supply(spark, d).aggregate_messages_in_python(send, "bigint")


def _active(direction: str, condition: str) -> None:
    @query(f"aggregate_messages_active_{direction}", "fe fv", f"+ a AS (SELECT id FROM fv WHERE attr <= 10) SELECT dst AS id, CAST(sum(attr) AS BIGINT) AS attr FROM fe WHERE {condition} GROUP BY dst")
    def run(spark, d):
        g = flow(spark, d)
        return g.aggregate_messages(to_dst=lambda t: t.attr, merge="sum", active=g.vertices.filter("attr <= 10"), direction=direction)


_active("out", "src IN (FROM a)")
_active("in", "dst IN (FROM a)")
_active("both", "src IN (FROM a) AND dst IN (FROM a)")
_active("either", "src IN (FROM a) OR dst IN (FROM a)")


# Degrees and neighbourhoods
@query("in_degrees", "fe", "SELECT dst AS id, count(*) AS degree FROM fe GROUP BY dst")
def in_degrees(spark, d):
    return flow(spark, d).in_degrees()


@query("out_degrees", "fe", "SELECT src AS id, count(*) AS degree FROM fe GROUP BY src")
def out_degrees(spark, d):
    return flow(spark, d).out_degrees()


@query("degrees", "fe", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM fe UNION ALL SELECT dst FROM fe) GROUP BY id")
def degrees(spark, d):
    return flow(spark, d).degrees()


_ENDS = {
    "in": "n AS (SELECT dst AS id, src AS other, src, dst, attr FROM fe)",
    "out": "n AS (SELECT src AS id, dst AS other, src, dst, attr FROM fe)",
    "either": "n AS (SELECT dst AS id, src AS other, src, dst, attr FROM fe UNION ALL SELECT src, dst, src, dst, attr FROM fe)",
}


def _neighbourhood(direction: str, ends: str) -> None:
    @query(f"neighbor_ids_{direction}", "fe fv", f"+ {ends} SELECT fv.id, coalesce(string_agg(CAST(n.other AS VARCHAR), ',' ORDER BY n.other), '') AS neighbors FROM fv LEFT JOIN n ON fv.id = n.id GROUP BY fv.id")
    def ids(spark, d):
        return flow(spark, d).collect_neighbor_ids(direction).select("id", _joined("neighbors").alias("neighbors"))

    @query(f"neighbors_{direction}", "fe fv", f"+ {ends}, m AS (SELECT n.id, n.other, o.attr FROM n JOIN fv o ON n.other = o.id) SELECT fv.id, coalesce(string_agg(m.other || ':' || m.attr, ',' ORDER BY m.other, m.attr), '') AS neighbors FROM fv LEFT JOIN m ON fv.id = m.id GROUP BY fv.id")
    def neighbors(spark, d):
        pairs = F.transform("neighbors", lambda x: F.concat_ws(":", x["id"], x["attr"]))
        return flow(spark, d).collect_neighbors(direction).select("id", F.array_join(pairs, ",").alias("neighbors"))

    @query(f"collect_edges_{direction}", "fe", f"+ {ends} SELECT id, string_agg(src || '>' || dst || ':' || attr, ',' ORDER BY src, dst, attr) AS edges FROM n GROUP BY id")
    def edges(spark, d):
        told = F.transform("edges", lambda x: F.concat(x["src"], F.lit(">"), x["dst"], F.lit(":"), x["attr"]))
        return flow(spark, d).collect_edges(direction).select("id", F.array_join(told, ",").alias("edges"))


for _direction, _ends in _ENDS.items():
    _neighbourhood(_direction, _ends)


@query("canonical_edges", "fe", "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, CAST(sum(attr) AS BIGINT) AS attr FROM fe GROUP BY ALL")
def canonical_edges(spark, d):
    return flow(spark, d).convert_to_canonical_edges("sum").edges


@query("group_edges", sql="SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS attr FROM lineitem GROUP BY ALL")
def group_edges(spark, d):
    raw = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit(1).cast("bigint").alias("attr"))
    return PropertyGraph(supply_vertices(spark, d), raw).group_edges("sum").edges


@query("graph_counts", "se sv", "SELECT (SELECT count(*) FROM sv) AS num_vertices, (SELECT count(*) FROM se) AS num_edges, (SELECT max(id) FROM sv) AS max_id")
def graph_counts(spark, d):
    g = supply(spark, d)
    return spark.createDataFrame([(g.num_vertices(), g.num_edges(), g.max_vertex_id())], "num_vertices bigint, num_edges bigint, max_id bigint")


# Updates
@query("add_vertices", "sv", "+ n AS (SELECT c_custkey AS id, 1000 + CAST(c_nationkey AS BIGINT) AS attr FROM customer) SELECT coalesce(n.id, sv.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.attr ELSE sv.attr END AS attr FROM sv FULL JOIN n ON sv.id = n.id")
def add_vertices(spark, d):
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey").cast("bigint") + 1000).alias("attr"))
    return supply(spark, d).add_vertices(new).vertices


@query("remove_vertices", "fe fv", "+ k AS (SELECT id FROM fv WHERE attr > 25) SELECT src, dst, attr FROM fe WHERE src IN (FROM k) AND dst IN (FROM k)")
def remove_vertices(spark, d):
    g = flow(spark, d)
    return g.remove_vertices(g.vertices.filter("attr <= 25")).edges


@query("add_edges", "se be", "SELECT src, dst, attr FROM se UNION ALL SELECT src, dst, attr FROM be b WHERE NOT EXISTS (SELECT 1 FROM se a WHERE a.src = b.src AND a.dst = b.dst)")
def add_edges(spark, d):
    return supply(spark, d).add_edges(buys_edges(spark, d), 0).edges


@query("add_edges_vertices", "sv be", "SELECT id, attr FROM sv UNION ALL SELECT DISTINCT id, 0::BIGINT FROM (SELECT unnest([src, dst]) AS id FROM be) WHERE id NOT IN (SELECT id FROM sv)")
def add_edges_vertices(spark, d):
    return supply(spark, d).add_edges(buys_edges(spark, d), 0).vertices


@query("remove_edges", "se be", "SELECT src, dst, attr FROM se a WHERE NOT EXISTS (SELECT 1 FROM be b WHERE a.src = b.src AND a.dst = b.dst)")
def remove_edges(spark, d):
    return supply(spark, d).remove_edges(buys_edges(spark, d)).edges


# Ranks, triangles
def _rounds(n: int, edges: str, base: str) -> str:
    out = []
    for k in range(n):
        out.append(f"r{k + 1} AS (SELECT v.id, {base} + 0.85::DOUBLE * coalesce(sum(r.attr * w.w), 0) AS attr FROM v LEFT JOIN w ON w.dst = v.id LEFT JOIN r{k} r ON r.id = w.src GROUP BY v.id)")
    return ", ".join(out)


_W = "w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM fe), v AS (SELECT id FROM fv)"


@query("static_pagerank", "fe fv", f"+ {_W}, r0 AS (SELECT id, 1.0::DOUBLE AS attr FROM v), {_rounds(4, 'fe', '0.15::DOUBLE')} SELECT id, round(attr * (SELECT count(*) FROM v) / (SELECT sum(attr) FROM r4), 6) AS attr FROM r4")
def static_pagerank(spark, d):
    return flow(spark, d).static_page_rank(4).vertices.select("id", F.round("attr", 6).alias("attr"))


_BASE = "CASE WHEN v.id = 0 THEN 0.15::DOUBLE ELSE 0 END"


@query("personalized_static", "fe fv", f"+ {_W}, r0 AS (SELECT id, CASE WHEN id = 0 THEN 1.0::DOUBLE ELSE 0 END AS attr FROM v), {_rounds(3, 'fe', _BASE)} SELECT id, round(attr / (SELECT sum(attr) FROM r3), 6) AS attr FROM r3")
def personalized_static(spark, d):
    return flow(spark, d).static_personalized_page_rank(0, 3).vertices.select("id", F.round("attr", 6).alias("attr"))


@query("personalized_parallel", "fe fv", f"+ {_W}, r0 AS (SELECT id, CASE WHEN id = 0 THEN 1.0::DOUBLE ELSE 0 END AS attr FROM v), {_rounds(2, 'fe', _BASE)} SELECT 0::BIGINT AS source, id, round(attr / (SELECT sum(attr) FROM r2), 6) AS attr FROM r2 WHERE attr > 0")
def personalized_parallel(spark, d):
    ranks = flow(spark, d).static_parallel_personalized_page_rank(spark.createDataFrame([(0,)], "id bigint"), 2)
    return ranks.select("source", "id", F.round("attr", 6).alias("attr"))


def _until(tolerance: float, start: str, rounds: int) -> str:
    """Ranks that send on changes above the tolerance. After enough rounds no change is, and
    further ones change nothing."""
    out = [f"s0 AS MATERIALIZED (SELECT id, {start} AS rank, {start} AS delta FROM v)"]
    for k in range(rounds):
        sent = f"SELECT w.dst AS id, 0.85::DOUBLE * sum(s.delta * w.w) AS d FROM w JOIN s{k} s ON s.id = w.src WHERE s.delta > {tolerance} GROUP BY w.dst"
        out.append(f"s{k + 1} AS MATERIALIZED (SELECT s.id, s.rank + coalesce(m.d, 0) AS rank, coalesce(m.d, 0) AS delta FROM s{k} s LEFT JOIN ({sent}) m ON m.id = s.id)")
    return ", ".join(out)


@query("pagerank_tol", "fe fv", f"+ {_W}, {_until(0.1, '0.15::DOUBLE', 40)} SELECT id, round(rank * (SELECT count(*) FROM v) / (SELECT sum(rank) FROM s40), 6) AS attr FROM s40")
def pagerank_tol(spark, d):
    return flow(spark, d).page_rank(0.1).vertices.select("id", F.round("attr", 6).alias("attr"))


@query("personalized_tol", "fe fv", f"+ {_W}, {_until(0.01, 'CASE WHEN id = 0 THEN 1.0::DOUBLE ELSE 0 END', 40)} SELECT id, round(rank / (SELECT sum(rank) FROM s40), 6) AS attr FROM s40")
def personalized_tol(spark, d):
    return flow(spark, d).personalized_page_rank(0, 0.01).vertices.select("id", F.round("attr", 6).alias("attr"))


@query("triangle_count", "fe fv", "+ c AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM fe WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM c x JOIN c y ON x.b = y.a JOIN c z ON z.a = x.a AND z.b = y.b), n AS (SELECT unnest([a, b, c]) AS id FROM t) SELECT fv.id, count(n.id) AS attr FROM fv LEFT JOIN n ON fv.id = n.id GROUP BY fv.id")
def triangle_count(spark, d):
    return flow(spark, d).triangle_count().vertices


# Components, paths, and Pregel to its fixed point
_REACHED = "SELECT id, min(m) AS attr FROM r GROUP BY id"


@query("connected_components", "ge gv", f"+ u AS (SELECT src AS a, dst AS b FROM ge UNION ALL SELECT dst, src FROM ge), r AS (SELECT id, id AS m FROM gv UNION SELECT u.b, r.m FROM r JOIN u ON r.id = u.a) {_REACHED}", recursive=True)
def connected_components(spark, d):
    """The trees of the regions."""
    return geo(spark, d).connected_components().vertices


@query("connected_components_whole", "fe fv", f"+ u AS (SELECT DISTINCT unnest([src, dst]) AS a, unnest([dst, src]) AS b FROM fe), r AS (SELECT id, id AS m FROM fv UNION SELECT r.id, u.b FROM r JOIN u ON r.m = u.a) {_REACHED}", recursive=True)
def connected_components_whole(spark, d):
    return flow(spark, d).connected_components().vertices


@query("connected_components_bounded", "fe fv", "+ u AS (SELECT src AS a, dst AS b FROM fe UNION SELECT dst, src FROM fe), r1 AS (SELECT id, least(fv.id, coalesce(min(u.b), fv.id)) AS m FROM fv LEFT JOIN u ON u.a = fv.id GROUP BY fv.id), r2 AS (SELECT r1.id, least(r1.m, coalesce(min(o.m), r1.m)) AS m FROM r1 LEFT JOIN u ON u.a = r1.id LEFT JOIN r1 o ON o.id = u.b GROUP BY r1.id, r1.m) SELECT id, m AS attr FROM r2")
def connected_components_bounded(spark, d):
    return flow(spark, d).connected_components(2).vertices


@query("scc", "fe fv", "+ r AS (SELECT id, id AS m FROM fv UNION SELECT r.id, fe.dst FROM r JOIN fe ON r.m = fe.src) SELECT a.id, min(a.m) AS attr FROM r a JOIN r b ON a.id = b.m AND a.m = b.id GROUP BY a.id", recursive=True)
def scc(spark, d):
    return flow(spark, d).strongly_connected_components(20).vertices


@query("shortest_paths", "ge gv", "+ u AS (SELECT src AS a, dst AS b FROM ge UNION ALL SELECT dst, src FROM ge), r AS (SELECT id AS landmark, id, 0 AS hops FROM gv WHERE id IN (0, 4) UNION SELECT r.landmark, u.a, r.hops + 1 FROM r JOIN u ON u.b = r.id WHERE r.hops < 6), m AS (SELECT id, landmark, min(hops) AS hops FROM r GROUP BY ALL) SELECT gv.id, coalesce(string_agg(m.landmark || ':' || m.hops, ',' ORDER BY m.landmark), '') AS attr FROM gv LEFT JOIN m ON gv.id = m.id GROUP BY gv.id", recursive=True)
def shortest_paths(spark, d):
    g = geo(spark, d)
    both = PropertyGraph(g.vertices, g.edges.unionByName(g.reverse().edges))
    told = F.transform(F.array_sort(F.map_entries("attr")), lambda x: F.concat_ws(":", x["key"], x["value"]))
    return both.shortest_paths([0, 4]).vertices.select("id", F.array_join(told, ",").alias("attr"))


def _relaxed(rounds: int) -> str:
    """Least sums of attributes on ways from vertex 0 of up to so many edges."""
    out = ["d0 AS MATERIALIZED (SELECT id, CASE WHEN id = 0 THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END AS attr FROM fv)"]
    for k in range(rounds):
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT o.id, least(o.attr, coalesce(n.attr, o.attr)) AS attr FROM d{k} o LEFT JOIN (SELECT fe.dst AS id, min(d.attr + fe.attr) AS attr FROM fe JOIN d{k} d ON d.id = fe.src GROUP BY fe.dst) n ON n.id = o.id)")
    return ", ".join(out)


@query("sssp", "fe fv", f"+ {_relaxed(40)} SELECT id, attr FROM d40")
def sssp(spark, d):
    return flow(spark, d).weighted_shortest_paths(0).vertices


def _pregel_whole(direction: str, edges: str) -> None:
    @query(f"pregel_{direction}", "fe fv", f"+ x AS ({edges}), r AS (SELECT id, id AS m FROM fv UNION SELECT x.b, r.m FROM r JOIN x ON r.id = x.a) SELECT id, max(m) AS attr FROM r GROUP BY id", recursive=True)
    def run(spark, d):
        """Each vertex with the greatest id that reaches it, to the fixed point."""
        g = flow(spark, d).map_vertices(lambda i, a: i)
        along = None if direction == "in" else lambda t: F.when(t.src_attr > t.dst_attr, t.src_attr)
        against = None if direction == "out" else lambda t: F.when(t.dst_attr > t.src_attr, t.dst_attr)
        return g.pregel(F.lit(-1).cast("bigint"), lambda i, a, m: F.greatest(a, m), to_src=against, to_dst=along, merge="max", direction=direction).vertices


_pregel_whole("out", "SELECT src AS a, dst AS b FROM fe")
_pregel_whole("in", "SELECT dst AS a, src AS b FROM fe")
_pregel_whole("either", "SELECT src AS a, dst AS b FROM fe UNION SELECT dst, src FROM fe")


@query("pregel_hops", "fe fv", "+ r0 AS (SELECT id, CASE WHEN id = 0 THEN 0 ELSE 1000000 END AS m FROM fv), r1 AS (SELECT fv.id, least(any_value(o.m), coalesce(min(r.m + 1), 1000000)) AS m FROM fv JOIN r0 o ON o.id = fv.id LEFT JOIN fe ON fe.dst = fv.id LEFT JOIN r0 r ON r.id = fe.src AND r.m < 1000000 GROUP BY fv.id), r2 AS (SELECT fv.id, least(any_value(o.m), coalesce(min(r.m + 1), 1000000)) AS m FROM fv JOIN r1 o ON o.id = fv.id LEFT JOIN fe ON fe.dst = fv.id LEFT JOIN r1 r ON r.id = fe.src AND r.m < 1000000 GROUP BY fv.id) SELECT id, CAST(m AS INTEGER) AS attr FROM r2")
def pregel_hops(spark, d):
    g = flow(spark, d).map_vertices(lambda i, a: F.when(i == 0, 0).otherwise(1000000))
    return g.pregel(F.lit(1000000), lambda i, a, m: F.least(a, m), to_dst=lambda t: F.when(t.src_attr + 1 < t.dst_attr, t.src_attr + 1), merge="min", max_iterations=2, direction="out").vertices


@query("top_ranked", "fe fv", "SELECT dst AS id, count(*) AS attr FROM fe GROUP BY dst ORDER BY attr DESC, id LIMIT 25")
def top_ranked(spark, d):
    g = flow(spark, d)
    return algorithms.top_ranked(PropertyGraph(g.in_degrees().withColumnRenamed("degree", "attr"), g.edges), 25)


# Partitions
_GRID = "m AS (SELECT max(id) AS size FROM fv), b AS (SELECT greatest(1, size // 3) AS b, greatest(0, size // greatest(1, size // 3) - 1) AS last FROM m)"


@query("grid_partition_sizes", "fe fv", f"+ {_GRID} SELECT CAST((least(abs(src) // b, last) * 3 + least(abs(dst) // b, last)) % 7 AS INTEGER) AS pid, count(*) AS n FROM fe, b GROUP BY ALL")
def grid_partition_sizes(spark, d):
    placed = flow(spark, d).partition_by_grid(7)
    return placed.edges.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))


def _mixed_sql(c: str, n: int) -> str:
    w = "18446744073709551616"
    word = f"(({c}::HUGEINT * {partitioning.MIXING_PRIME}::HUGEINT) % {w}::HUGEINT)"
    return f"(least({word}, {w}::HUGEINT - {word}) % {n})"


@query("edge_partition_1d", "fe", f"SELECT CAST({_mixed_sql('src', 6)} AS INTEGER) AS pid, count(*) AS n FROM fe GROUP BY ALL")
def edge_partition_1d(spark, d):
    return flow(spark, d).edges.groupBy(partitioning.edge_partition_1d(6).alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query("edge_partition_2d", "fe", f"SELECT CAST(({_mixed_sql('src', 3)} * 3 + {_mixed_sql('dst', 3)}) % 9 AS INTEGER) AS pid, count(*) AS n FROM fe GROUP BY ALL")
def edge_partition_2d(spark, d):
    placed = flow(spark, d).partition_by(partitioning.edge_partition_2d, 9)
    return placed.edges.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))


@query("canonical_cut", "fe", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, 1::BIGINT AS partitions FROM fe GROUP BY ALL")
def canonical_cut(spark, d):
    """How many partitions each unordered pair is in: always one."""
    pid = partitioning.canonical_random_vertex_cut(8)
    return flow(spark, d).edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), pid.alias("pid")).groupBy("a", "b").agg(F.countDistinct("pid").alias("partitions"))


@query("random_vertex_cut", "fe", "SELECT count(*) AS n, 8::BIGINT AS partitions, true AS even, true AS together FROM fe")
def random_vertex_cut(spark, d):
    """Edges, each of which stands twice before: equal pairs meet, so one is left of two; all
    partitions are used, none by more than twice its share; edges are where they belong."""
    g = flow(spark, d)
    twice = PropertyGraph(g.vertices, g.edges.unionAll(g.edges))
    at = twice.partition_by(partitioning.random_vertex_cut, 8).edges.withColumn("at", F.spark_partition_id())
    sizes = at.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("at") == partitioning.random_vertex_cut(8)).alias("right"))
    total = F.sum("n")
    return sizes.agg(total.alias("n"), F.count(F.lit(1)).alias("partitions"), (F.max("n") * 4 < total).alias("even"), F.bool_and("right").alias("together"))


# K2-trees: blocks of 64 x 64 cells of the flow's matrix
_BLOCK, _K = 64, 2
_Z = " + ".join(f"((line >> {i}) % 2 * 2 + (col >> {i}) % 2) * {4**i}" for i in range(6))
_CELLS = f"cells AS (SELECT src // 64 AS row_block, dst // 64 AS col_block, src % 64 AS line, dst % 64 AS col FROM fe), z AS (SELECT row_block, col_block, line, col, {_Z} AS z FROM cells)"
_TREE = (
    f"{_CELLS}, p AS (SELECT DISTINCT row_block, col_block, level, z // CAST(power(4, 6 - level) AS BIGINT) AS prefix FROM z, range(1, 7) l(level)), "
    "n AS (SELECT row_block, col_block, level, prefix // 4 AS parent, string_agg(b, '' ORDER BY j) AS bits FROM (SELECT q.row_block, q.col_block, q.level, q.parent * 4 + j AS prefix, j, CASE WHEN p.prefix IS NULL THEN '0' ELSE '1' END AS b "
    "FROM (SELECT DISTINCT row_block, col_block, level, prefix // 4 AS parent FROM p) q CROSS JOIN range(4) r(j) LEFT JOIN p ON p.row_block = q.row_block AND p.col_block = q.col_block AND p.level = q.level AND p.prefix = q.parent * 4 + j) GROUP BY ALL), "
    "t AS (SELECT row_block, col_block, string_agg(bits, '' ORDER BY level, parent) AS bits FROM n GROUP BY ALL)"
)


def _cells(spark, d) -> DataFrame:
    e = flow_edges(spark, d)
    block = lambda c: F.expr(f"{c} div {_BLOCK}L")
    return e.select(block("src").alias("row_block"), block("dst").alias("col_block"), (F.col("src") % _BLOCK).alias("line"), (F.col("dst") % _BLOCK).alias("col"))


_BY = ["row_block", "col_block"]


def _trees(spark, d) -> DataFrame:
    return k2.encode(_cells(spark, d), _K, _BLOCK, _BY)


@query("k2_index", "fe", f"+ {_CELLS} SELECT row_block, col_block, line, col, z FROM z")
def k2_index(spark, d):
    return _cells(spark, d).withColumn("z", k2.k2_index(F.col("line"), F.col("col"), _K, k2.height_of(_K, _BLOCK)))


@query("k2_sort_rank", "fe", f"+ {_CELLS} SELECT row_block, col_block, line, col, CAST(row_number() OVER (PARTITION BY row_block, col_block ORDER BY z) AS INTEGER) - 1 AS ordinal FROM z")
def k2_sort_rank(spark, d):
    return k2.decode(_trees(spark, d), _BY)


@query("k2_order", "fe", "SELECT count(*) AS n, 0::BIGINT AS inversions, 0::BIGINT AS overlaps FROM fe")
def k2_order(spark, d):
    """The flow in ranges of K2 order: within a partition positions go up, and the next
    partition begins behind the last position of the one before."""
    g = flow(spark, d)
    size = (g.max_vertex_id() or 0) + 1
    z = k2.k2_index(F.col("src"), F.col("dst"), _K, k2.height_of(_K, size))
    at = partitioning.k2_ranged(g.edges, _K, size, 6).select(z.alias("z"), F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("place"))
    at = at.withColumn("before", F.lag("z").over(Window.partitionBy("pid").orderBy("place")))
    parts = at.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("z") <= F.col("before")).cast("bigint")).alias("down"), F.min("z").alias("low"), F.max("z").alias("high"))
    # Six rows, one for each partition.
    parts = parts.withColumn("last", F.lag("high").over(Window.orderBy("pid")))
    return parts.agg(F.sum("n").alias("n"), F.coalesce(F.sum("down"), F.lit(0)).cast("bigint").alias("inversions"), F.coalesce(F.sum((F.col("low") <= F.col("last")).cast("bigint")), F.lit(0)).cast("bigint").alias("overlaps"))


@query("k2_tree_bits", "fe", f"+ {_TREE} SELECT row_block, col_block, bits FROM t")
def k2_tree_bits(spark, d):
    return _trees(spark, d).select(*_BY, "bits")


@query("k2_tree_decode", "fe", f"+ {_CELLS} SELECT row_block * 64 + line AS src, col_block * 64 + col AS dst FROM cells")
def k2_tree_decode(spark, d):
    return k2.decode(_trees(spark, d), _BY).select((F.col("row_block") * _BLOCK + F.col("line")).alias("src"), (F.col("col_block") * _BLOCK + F.col("col")).alias("dst"))


@query("k2_tree_stats", "fe", f"+ {_TREE}, c AS (SELECT row_block, col_block, count(*) AS edges FROM cells GROUP BY ALL) SELECT t.row_block, t.col_block, CAST(length(t.bits) AS BIGINT) AS length, 6 AS height, c.edges, false AS is_empty FROM t JOIN c ON t.row_block = c.row_block AND t.col_block = c.col_block")
def k2_tree_stats(spark, d):
    return k2.stats(_trees(spark, d), _BY)


# Bitsets: per customer, the nations' suppliers, as words of 64 bits
@query("bitset_rank", "fe", "SELECT src AS id, count(*) FILTER (dst BETWEEN 10 AND 700) AS between_10_700, count(*) AS cardinality, coalesce(min(dst) FILTER (dst >= 100), -1) AS next_from_100 FROM fe GROUP BY src")
def bitset_rank(spark, d):
    words = _bitsets(spark, d)
    return words.select("id", bitset.count("words", 10, 700).cast("bigint").alias("between_10_700"), bitset.cardinality("words").cast("bigint").alias("cardinality"), bitset.next_set_bit("words", 100).alias("next_from_100"))


def _dense(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """For each ``a`` the set of its ``b`` as words without gaps: the words that have bits,
    with as many empty ones before each as are missing."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(b) % 64).cast("int"))
    words = edges.groupBy(F.col(a).alias("id"), F.expr(f"{b} div 64L").cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    held = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    before = F.concat(F.array(F.lit(-1)), F.transform("w", lambda x: x["word"]))
    filled = F.transform("w", lambda x, i: F.concat(F.array_repeat(F.lit(0).cast("bigint"), x["word"] - F.get(before, i) - 1), F.array(x["bits"])))
    return held.select("id", F.flatten(filled).alias(name))


def _bitsets(spark, d) -> DataFrame:
    """Each part with the set of parts that follow it."""
    return _dense(flow_edges(spark, d), "src", "dst", "words")


@query(
    "bitset_changes", "fe",
    "SELECT src AS id, count(*) FILTER (dst >= 130) + 130 AS after_set, count(*) FILTER (dst >= 130) AS after_clear, CAST(bool_or(dst = 70) AS BOOLEAN) AS has_70, count(*) + CASE WHEN bool_or(dst = 3) THEN 0 ELSE 1 END AS with_3, "
    "count(*) - CASE WHEN bool_or(dst = 70) THEN 1 ELSE 0 END AS without_70, greatest(max(dst) // 64 + 1, 16) * 64 AS grown, greatest(max(dst) // 64 + 1, 16) * 64 - 1 - max(dst) AS first_reversed FROM fe GROUP BY src",
)
def bitset_changes(spark, d):
    """Bits set, taken out, asked for, and mirrored, in sets with room for 1,024 at least."""
    w = _bitsets(spark, d).select("id", bitset.grow("words", 1024).alias("words"))
    size = lambda x: bitset.cardinality(x).cast("bigint")
    return w.select(
        "id", size(bitset.set_until("words", 130)).alias("after_set"), size(bitset.clear_until("words", 130)).alias("after_clear"), bitset.get_bit("words", 70).alias("has_70"),
        size(bitset.set_bit("words", 3)).alias("with_3"), size(bitset.unset_bit("words", 70)).alias("without_70"),
        bitset.capacity("words").cast("bigint").alias("grown"), bitset.next_set_bit(bitset.reverse("words"), 0).alias("first_reversed"),
    )


@query(
    "bitset_ops", "fe",
    "+ b AS (SELECT dst AS src, src AS dst FROM fe), "
    "i AS (SELECT a.src, count(*) AS n FROM fe a JOIN b ON a.src = b.src AND a.dst = b.dst GROUP BY ALL), na AS (SELECT src, count(*) AS n FROM fe GROUP BY ALL), nb AS (SELECT src, count(*) AS n FROM b GROUP BY ALL) "
    "SELECT na.src AS id, coalesce(i.n, 0) AS both, na.n + nb.n - coalesce(i.n, 0) AS any, na.n + nb.n - 2 * coalesce(i.n, 0) AS one, na.n - coalesce(i.n, 0) AS first_only FROM na JOIN nb ON na.src = nb.src LEFT JOIN i ON i.src = na.src",
)
def bitset_ops(spark, d):
    e = flow_edges(spark, d)
    sets = lambda a, b: _dense(e, a, b, f"to_{b}")
    both = sets("src", "dst").join(sets("dst", "src"), "id")
    size = lambda w: bitset.cardinality(w).cast("bigint")
    return both.select(
        "id", size(bitset.bits_and("to_dst", "to_src")).alias("both"), size(bitset.bits_or("to_dst", "to_src")).alias("any"),
        size(bitset.bits_xor("to_dst", "to_src")).alias("one"), size(bitset.bits_and_not("to_dst", "to_src")).alias("first_only"),
    )


@query("mtx_roundtrip", "fe", "SELECT src, dst, CAST(attr AS INTEGER) AS attr FROM fe")
def mtx_roundtrip(spark, d):
    """The flow written as text lines and read again."""
    path = shared(spark, "edges")
    write_edge_list(flow_edges(spark, d), path)
    return read_edge_list(spark, path, header=False)[1]


@query("mtx_header", sql="SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS INTEGER) * -3 ELSE 0 END AS attr FROM nation")
def mtx_header(spark, d):
    """Nations and regions as a file with comments, a header, blanks and tabs, and values
    that are left out, read again."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("b"))
    lines = n.select("a", F.concat_ws("\t", "a", "b", F.when(F.col("a") % 2 == 0, F.col("a") * -3)).alias("value"))
    top = spark.createDataFrame([(-4, "% comment"), (-3, "# another"), (-2, "25  5 25"), (-1, "%% a comment below the header")], "a bigint, value string")
    path = shared(spark, "edges")
    top.unionByName(lines).repartition(1).sortWithinPartitions("a").select("value").write.text(path)
    return read_edge_list(spark, path)[1]


@query("random_edges", sql="SELECT true AS expected, true AS inside, true AS unique, true AS repeatable, true AS spread")
def random_edges(spark, d):
    """A synthetic matrix has about as many cells as its density says, all different and
    inside it, with attribute 0; a seed draws the same again, and all columns are hit."""
    e = draw(spark, 400, 0.1)
    both = e.withColumn("x", F.lit(1)).unionAll(draw(spark, 400, 0.1).withColumn("x", F.lit(2))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    n = F.count(F.lit(1))
    told = e.agg(n.between(16000 - 720, 16000 + 720).alias("expected"), F.bool_and(F.col("src").between(0, 399) & F.col("dst").between(0, 399) & (F.col("attr") == 0)).alias("inside"), (n == F.countDistinct("src", "dst")).alias("unique"), (F.countDistinct("dst") == 400).alias("spread"))
    return told.crossJoin(both.agg(F.bool_and(F.col("n") == 2).alias("repeatable"))).select("expected", "inside", "unique", "repeatable", "spread")
