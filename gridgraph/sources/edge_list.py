"""Text edge lists, synthetic graphs, and Parquet in matrix order."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgraph.operators.partitioning import k2_ranged

if TYPE_CHECKING:
    from gridgraph.graph import PropertyGraph


def read_edge_list(spark: SparkSession, path: str, header: bool = True, trim: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of lines ``src dst [attr]``, parted by white space.

    Lines that begin with % or # are comments; with ``header`` the first other line is
    skipped. A missing attribute is 0. A line of fewer than two fields, or one with white
    space before the first unless ``trim``, ends the job with an error. Vertices are all
    end points, with attribute 1. Edges may repeat.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line") if trim else F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    lines = lines.filter(~F.col("line").startswith("%") & ~F.col("line").startswith("#"))
    if header:
        first = lines.agg(F.min("at")).first()[0]
        lines = lines.filter(F.col("at") != (first if first is not None else -1))
    fields = F.split("line", r"\s+")
    checked = F.when(F.size(fields) >= 2, fields).otherwise(F.raise_error(F.concat(F.lit("fewer than two fields: "), F.col("line"))))
    part = lines.select(checked.alias("f"))
    third = F.when((F.size("f") > 2) & (F.get("f", F.lit(2)) != ""), F.get("f", F.lit(2)).cast("int")).otherwise(F.lit(0))
    edges = part.select(F.get("f", F.lit(0)).cast("bigint").alias("src"), F.get("f", F.lit(1)).cast("bigint").alias("dst"), third.alias("attr"))
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("attr", F.lit(1).cast("bigint"))
    return vertices, edges


def write_edge_list(edges: DataFrame, path: str) -> None:
    """Edges as lines ``src dst attr``; each file begins with a header line only if it is
    the one file of a single partition, so read back with header=False."""
    edges.select(F.concat_ws(" ", "src", "dst", "attr")).write.text(path)


def random_edges(spark: SparkSession, size: int, density: float, seed: int = 42) -> DataFrame:
    """Cells of a size x size matrix, each with a chance of ``density``; attribute 0.

    Matrix rows are dealt out. For each, how many cells it has is drawn first and then
    where they are, from its own seed: time and rows go with the cells that there are, and
    a task that runs again draws the same.
    """
    if not 0 <= density <= 1:
        raise ValueError("a density is from 0 to 1")

    def told(rows: list[int], cells: list[np.ndarray]) -> pa.RecordBatch:
        src = np.repeat(np.array(rows, np.int64), [len(c) for c in cells])
        dst = np.concatenate([np.zeros(0, np.int64), *cells])
        return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(np.zeros(len(src), np.int32))], names=["src", "dst", "attr"])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells, n = [], [], 0
            for row in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed & 0xFFFFFFFF, row])
                if many := rng.binomial(size, density):
                    rows.append(row)
                    cells.append(np.sort(rng.choice(size, many, replace=False, shuffle=False)).astype(np.int64))
                    n += many
                if n > 100_000:
                    yield told(rows, cells)
                    rows, cells, n = [], [], 0
            yield told(rows, cells)

    return spark.range(size).mapInArrow(draw, "src bigint, dst bigint, attr int")


def write_matrix_parquet(edges: DataFrame, path: str, k: int, size: int, n: int) -> None:
    """Edges in n files of K2 order: min and max of row groups then skip cells on read."""
    k2_ranged(edges, k, size, n).write.parquet(path)


def read_graph(spark: SparkSession, path: str) -> PropertyGraph:
    from gridgraph.graph import PropertyGraph

    return PropertyGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def write_graph(g: PropertyGraph, path: str) -> None:
    g.vertices.write.parquet(f"{path}/vertices")
    g.edges.write.parquet(f"{path}/edges")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A benchmark report as one JSON file on whatever store the path is in."""
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(path)
