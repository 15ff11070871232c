"""Small timings of single operators on synthetic matrices, in one partition.

    python -m gridgraph.bench.micro --output PATH

Sizes are numbers of cells of a square matrix; ``density`` is the share that is filled.
Each timing is the median of some runs after one that warms up; plans are forced whole.
"""

from __future__ import annotations

import argparse
import json
import math
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgraph.bench.harness import stored_bytes
from gridgraph.functions import k2
from gridgraph.graph import PropertyGraph
from gridgraph.plans.lineage import cut
from gridgraph.sources.edge_list import random_edges, write_report


def _forced(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def _median_ms(f: Callable[[], object], runs: int) -> float:
    times = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        f()
        times.append((time.perf_counter() - began) * 1000)
    return round(statistics.median(times[1:]), 1)


class Base:
    """A cached matrix of about ``size`` cells, as edges and as blocks of K2-trees."""

    def __init__(self, spark: SparkSession, size: int, density: float = 1.0):
        self.side = max(1, math.isqrt(size))
        self.edges = random_edges(spark, self.side, density).coalesce(1).cache()
        self.n = self.edges.count()
        self.graph = PropertyGraph.from_edges(self.edges, 1)

    def trees(self, k: int) -> DataFrame:
        cells = self.edges.select((F.col("src") % 64).alias("line"), (F.col("dst") % 64).alias("col"), F.expr("src div 64").alias("a"), F.expr("dst div 64").alias("b"))
        return k2.encode(cells, k, 64, ["a", "b"])

    def close(self) -> None:
        self.edges.unpersist(True)


def _new_edges(spark: SparkSession, base: Base, n: int) -> DataFrame:
    """Edges that the matrix does not have, behind its last row."""
    return spark.range(n).select((F.col("id") % base.side + base.side).alias("src"), F.expr(f"id div {base.side}").alias("dst"), F.lit(0).alias("attr"))


def build(base: Base, k: int) -> Callable:
    return lambda: _forced(base.trees(k))


def iterate(base: Base, k: int) -> Callable:
    trees = cut(base.trees(k))
    return lambda: _forced(k2.decode(trees, ["a", "b"]))


def add_edges(base: Base, n: int) -> Callable:
    new = _new_edges(base.edges.sparkSession, base, n)
    return lambda: _forced(base.graph.add_edges(new, 1).edges)


def remove_edges(base: Base, n: int) -> Callable:
    gone = base.edges.limit(n).select("src", "dst")
    return lambda: _forced(base.graph.remove_edges(gone).edges)


def aggregate_messages(base: Base, share: float | None) -> Callable:
    """All vertices active, or a share of them by a semi-join at the source."""
    if share is None:
        return lambda: _forced(base.graph.aggregate_messages(to_dst=lambda t: F.lit(1)))
    active = base.graph.vertices.filter(F.col("id") < int(base.side * share))
    return lambda: _forced(base.graph.aggregate_messages(to_dst=lambda t: F.lit(1), active=active, direction="out"))


def memory(spark: SparkSession, base: Base, k: int) -> dict:
    """Bytes of the cached edges, and of the bits of their trees."""
    bits = base.trees(k).agg(F.sum(F.length("bits"))).first()[0] or 0
    return {"cached_bytes": stored_bytes(spark), "tree_bytes": -(-bits // 8)}


def run(spark: SparkSession, sizes: list[int], ks: list[int], runs: int = 3) -> dict:
    """Of the largest size: added and removed edges, active shares, poor locality."""
    told: dict = {"build_ms": [], "iterate_ms": [], "memory": [], "aggregate_ms": [], "sparse_memory": [], "add_edges_ms": [], "remove_edges_ms": [], "active_ms": []}
    for size in sizes:
        base = Base(spark, size)
        for k in ks:
            told["build_ms"].append({"size": size, "k": k, "ms": _median_ms(build(base, k), runs)})
            told["iterate_ms"].append({"size": size, "k": k, "ms": _median_ms(iterate(base, k), runs)})
            told["memory"].append({"size": size, "k": k, "edges": base.n, **memory(spark, base, k)})
        told["aggregate_ms"].append({"size": size, "ms": _median_ms(aggregate_messages(base, None), runs)})
        if size == sizes[-1]:
            for tenth in (1, 5, 10):
                told["add_edges_ms"].append({"new": size * tenth // 100, "ms": _median_ms(add_edges(base, size * tenth // 100), runs)})
                told["remove_edges_ms"].append({"gone": size * tenth // 1000, "ms": _median_ms(remove_edges(base, size * tenth // 1000), runs)})
                told["active_ms"].append({"share": tenth / 10, "ms": _median_ms(aggregate_messages(base, tenth / 10), runs)})
        base.close()
    for density in (0.1, 0.5, 1.0):
        base = Base(spark, sizes[-1], density)
        told["sparse_memory"] += [{"density": density, "k": k, "edges": base.n, **memory(spark, base, k)} for k in ks]
        base.close()
    return told


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser()
    p.add_argument("--sizes", type=int, nargs="+", default=[100_000, 500_000, 1_000_000])
    p.add_argument("--ks", type=int, nargs="+", default=[2, 4, 8])
    p.add_argument("--runs", type=int, default=3)
    p.add_argument("--output", default="")
    o = p.parse_args(args)
    spark = SparkSession.builder.appName("gridgraph-micro").getOrCreate()
    told = run(spark, o.sizes, o.ks, o.runs)
    if o.output:
        write_report(spark, told, o.output)
    return told


if __name__ == "__main__":
    print(json.dumps(main()))
