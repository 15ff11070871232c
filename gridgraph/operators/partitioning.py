"""Placement of edges: partition numbers as Columns, and exact repartitioning."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridgraph.functions.k2 import height_of, k2_index

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph

#: Fixed value: the prime by which ids are mixed, so that results equal those of the
#: usual 1-D and 2-D edge partitioners.
MIXING_PRIME = 1125899906842597
_WORD = 2**64


def mixed(column: Column) -> Column:
    """abs(id * prime), where the product wraps as 64-bit integers do. Decimals hold the
    whole product, so the result is right whether or not overflow is an error."""
    product = column.cast("decimal(19,0)") * F.lit(MIXING_PRIME).cast("decimal(17,0)")
    word = F.pmod(product, F.lit(str(_WORD)).cast("decimal(20,0)"))
    return F.least(word, F.lit(str(_WORD)).cast("decimal(20,0)") - word).cast("decimal(20,0)")


def _mod(value: Column, n: int | Column) -> Column:
    return (value % (F.lit(n) if isinstance(n, int) else n).cast("decimal(20,0)")).cast("bigint")


def edge_partition_1d(n: int, src: str = "src") -> Column:
    """All edges of a source together."""
    return _mod(mixed(F.col(src)), n).cast("int")


def edge_partition_2d(n: int, src: str = "src", dst: str = "dst") -> Column:
    """A vertex's edges in at most 2 * ceil(sqrt(n)) partitions."""
    side = math.ceil(math.sqrt(n))
    if side * side == n:
        pid = (_mod(mixed(F.col(src)), side) * side + _mod(mixed(F.col(dst)), side)) % n
    else:
        rows = (n + side - 1) // side
        last_rows = n - rows * (side - 1)
        col = F.floor(_mod(mixed(F.col(src)), n) / rows)
        row = F.when(col < side - 1, _mod(mixed(F.col(dst)), rows)).otherwise(_mod(mixed(F.col(dst)), last_rows))
        pid = col * rows + row
    return pid.cast("int")


def random_vertex_cut(n: int, src: str = "src", dst: str = "dst") -> Column:
    """Equal pairs together, other pairs anywhere."""
    return F.pmod(F.xxhash64(src, dst), F.lit(n)).cast("int")


def canonical_random_vertex_cut(n: int, src: str = "src", dst: str = "dst") -> Column:
    """Both directions of a pair together."""
    return F.pmod(F.xxhash64(F.least(src, dst), F.greatest(src, dst)), F.lit(n)).cast("int")


def grid_partition(n: int, size: int, src: str = "src", dst: str = "dst") -> Column:
    """The cell of a grid over the adjacency matrix, cells numbered row by row."""
    side = math.ceil(math.sqrt(n))
    block = max(1, size // side)
    last = max(0, size // block - 1)
    row, col = (F.least(F.expr(f"abs({c}) div {block}L"), F.lit(last)) for c in (src, dst))
    return ((row * side + col) % n).cast("int")


def partition_by(g: PropertyGraph, partition: Callable[[int], Column] | Column, n: int, merge: str | Callable = "min") -> PropertyGraph:
    """The graph with its edges in exactly the partitions that an expression gives (or a
    strategy of this module for n). Pairs that meet are merged."""
    from gridgraph.graph import PropertyGraph
    from gridgraph.sources.builders import distinct_edges

    pid = partition(n) if callable(partition) else partition
    placed = distinct_edges(g.edges, merge).withColumn("pid", pid).repartitionById(n, "pid")
    return PropertyGraph(g.vertices, placed.drop("pid"))


def partition_by_grid(g: PropertyGraph, n: int | None = None) -> PropertyGraph:
    """partition_by over the grid up to the largest vertex id, in as many partitions as
    shuffles have if ``n`` is not given."""
    n = n or int(g.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = g.max_vertex_id() or 0
    return partition_by(g, grid_partition(n, size), n)


def k2_sorted(edges: DataFrame, k: int, size: int) -> DataFrame:
    """Edges sorted by matrix position in K2 (Z-) order within their partitions."""
    return edges.sortWithinPartitions(k2_index(F.col("src"), F.col("dst"), k, height_of(k, size)))


def k2_ranged(edges: DataFrame, k: int, size: int, n: int) -> DataFrame:
    """Edges in n ranges of K2 order: neighbouring cells of the matrix stand together, so
    that row groups of a file cover small rectangles."""
    z = k2_index(F.col("src"), F.col("dst"), k, height_of(k, size))
    return edges.withColumn("z", z).repartitionByRange(n, "z").sortWithinPartitions("z").drop("z")
