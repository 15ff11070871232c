"""The graph itself. Operators live in ``gridgraph.operators`` and are methods here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridgraph.operators import filters, joins, maps, messages, neighbours, partitioning, updates
from gridgraph.plans import algorithms, lineage, pregel
from gridgraph.sources import builders


class PropertyGraph:
    """An immutable directed simple graph.

    ``vertices`` has ``id`` (bigint, unique, not null) and ``attr``; ``edges`` has ``src``,
    ``dst`` (bigint, unique as a pair) and ``attr``. Attributes are of any type. Every
    operator gives a new graph and leaves this one as it is.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        for df, names in ((vertices, ("id", "attr")), (edges, ("src", "dst", "attr"))):
            if missing := [n for n in names if n not in df.columns]:
                raise ValueError(f"columns {missing} are missing")
            for n in names[:-1]:
                if not isinstance(df.schema[n].dataType, T.IntegralType):
                    raise TypeError(f"{n} has to be a whole number")
        self.vertices = vertices.select(F.col("id").cast("bigint").alias("id"), "attr")
        self.edges = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "attr")
        self._checkpointed = False

    # Construction (S2-S9)
    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, default_attr: object = None, merge_vertices: str | Callable = "min", merge_edges: str | Callable = "min") -> PropertyGraph:
        """A graph of rows that may repeat ids or pairs and lack end points. Rows with a
        null id or end are left out."""
        e = builders.distinct_edges(edges, merge_edges)
        v = builders.distinct_vertices(vertices, merge_vertices)
        return PropertyGraph(builders.with_endpoints(v, e, default_attr), e)

    @staticmethod
    def from_edges(edges: DataFrame, default_attr: object = None, merge_edges: str | Callable = "min") -> PropertyGraph:
        e = builders.distinct_edges(edges, merge_edges)
        return PropertyGraph(builders.vertices_of(e, default_attr), e)

    @staticmethod
    def from_edge_tuples(pairs: DataFrame, default_attr: object = None, count_duplicates: bool = False) -> PropertyGraph:
        """A graph of ``(src, dst)`` rows; the edge attribute is 1, or how often a pair stands."""
        if count_duplicates:
            e = builders.whole(pairs).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("int").alias("attr"))
        else:
            e = builders.whole(pairs).select("src", "dst").distinct().withColumn("attr", F.lit(1))
        return PropertyGraph(builders.vertices_of(e, default_attr), e)

    def routing_table(self, partition: Column | None = None) -> DataFrame:
        return builders.routing_table(self.edges, partition)

    # Storage and actions (K1-K10)
    def triplets(self, src: bool = True, dst: bool = True) -> DataFrame:
        return joins.triplets(self, src, dst)

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def persist(self, vertex_level: StorageLevel = StorageLevel.MEMORY_AND_DISK, edge_level: StorageLevel | None = None) -> PropertyGraph:
        self.vertices.persist(vertex_level)
        self.edges.persist(edge_level or vertex_level)
        return self

    cache = persist

    def unpersist(self, blocking: bool = False) -> PropertyGraph:
        self.edges.unpersist(blocking)
        return self.unpersist_vertices(blocking)

    def unpersist_vertices(self, blocking: bool = False) -> PropertyGraph:
        self.vertices.unpersist(blocking)
        return self

    def checkpoint(self) -> PropertyGraph:
        """This graph with both tables written to the shared checkpoint folder."""
        out = PropertyGraph(lineage.cut(self.vertices), lineage.cut(self.edges))
        out._checkpointed = True
        return out

    def is_checkpointed(self) -> bool:
        return self._checkpointed

    def checkpoint_files(self) -> list[str]:
        """The files that hold a checkpointed graph; none otherwise."""
        if not self._checkpointed:
            return []
        files = [df._jdf.queryExecution().analyzed().collectLeaves().head().rdd().getCheckpointFile() for df in (self.vertices, self.edges)]
        return [f.get() for f in files if f.isDefined()]

    def set_name(self, name: str) -> PropertyGraph:
        """Describes the jobs that follow in Spark's own pages."""
        self.edges.sparkSession.sparkContext.setJobDescription(name)
        return self

    def foreach_edge(self, f: Callable) -> None:
        self.edges.foreach(f)

    # Maps (P1-P9)
    map_vertices = maps.map_vertices
    map_edges = maps.map_edges
    map_edge_partitions = maps.map_edge_partitions
    map_triplets = maps.map_triplets
    reverse = maps.reverse

    # Filters (F1-F9)
    subgraph = filters.subgraph
    filter = filters.filter_graph
    remove_self_edges = filters.remove_self_edges
    pick_random_vertex = filters.pick_random_vertex

    # Joins (J1-J10)
    outer_join_vertices = joins.outer_join_vertices
    join_vertices = joins.join_vertices
    mask = joins.mask
    inner_join_edges = joins.inner_join_edges

    # Messages and aggregates (A1-A13)
    aggregate_messages = messages.aggregate_messages
    aggregate_messages_in_python = messages.aggregate_messages_in_python
    group_edges = neighbours.group_edges
    convert_to_canonical_edges = neighbours.convert_to_canonical_edges
    in_degrees = neighbours.in_degrees
    out_degrees = neighbours.out_degrees
    degrees = neighbours.degrees
    collect_neighbor_ids = neighbours.collect_neighbor_ids
    collect_neighbors = neighbours.collect_neighbors
    collect_edges = neighbours.collect_edges
    max_vertex_id = neighbours.max_vertex_id

    # Updates (U1-U5)
    add_vertices = updates.add_vertices
    remove_vertices = updates.remove_vertices
    add_edges = updates.add_edges
    remove_edges = updates.remove_edges

    # Partitioning (R1-R6)
    partition_by = partitioning.partition_by
    partition_by_grid = partitioning.partition_by_grid

    # Iterative plans (G1-G9)
    pregel = pregel.pregel
    page_rank = algorithms.page_rank
    static_page_rank = algorithms.static_page_rank
    personalized_page_rank = algorithms.personalized_page_rank
    static_personalized_page_rank = algorithms.static_personalized_page_rank
    static_parallel_personalized_page_rank = algorithms.static_parallel_personalized_page_rank
    connected_components = algorithms.connected_components
    strongly_connected_components = algorithms.strongly_connected_components
    triangle_count = algorithms.triangle_count
    shortest_paths = algorithms.shortest_paths
    weighted_shortest_paths = algorithms.weighted_shortest_paths
    top_ranked = algorithms.top_ranked
