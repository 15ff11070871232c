"""K2-trees of adjacency matrices: positions, encoding and decoding.

A tree of arity k halves (k-ths) rows and columns at each level. Level 1 has the k*k
bits of the root; a set bit has a node of k*k bits on the next level. The bits of all
levels, in order, are the tree. Structure only: attributes stand beside it in K2 order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def height_of(k: int, size: int) -> int:
    """Levels of a tree for a matrix of ``size`` rows: the least h >= 1 with k**h >= size,
    in whole numbers."""
    h = 1
    while k**h < size:
        h += 1
    return h


def padded_size(k: int, size: int) -> int:
    return k ** height_of(k, size)


def k2_index(line: Column, col: Column, k: int, height: int) -> Column:
    """The position of a cell in K2 order: base-k digits of line and column interleaved."""
    if k ** (2 * height) > 2**63:
        raise ValueError("positions need more than 63 bits: index blocks of the matrix")
    def digit(c: Column, i: int) -> Column:
        if k & (k - 1) == 0:
            return F.shiftright(c.cast("bigint"), (k.bit_length() - 1) * i).bitwiseAND(F.lit(k - 1).cast("bigint"))
        return F.call_function("div", c.cast("bigint"), F.lit(k**i).cast("bigint")) % k

    out = F.lit(0).cast("bigint")
    for i in range(height):
        out = out + (digit(line, i) * k + digit(col, i)) * F.lit(k ** (2 * i)).cast("bigint")
    return out


def encode(edges: DataFrame, k: int, size: int, by: list[str] | None = None, line: str = "line", col: str = "col") -> DataFrame:
    """The tree of each group of cells: the ``by`` columns, k, size (padded), bits,
    internal (bits above the last level) and leaves (cells). Cells may repeat.

    Every level is a set of distinct prefixes of positions; a node is the bits that its
    children set. A group is one block of a matrix: its tree is gathered in one row. Without
    groups, no cells give one tree without bits.
    """
    by = by or []
    k2, h = k * k, height_of(k, size)
    cells = edges.select(*by, k2_index(F.col(line), F.col(col), k, h).alias("z")).distinct()
    weights = F.array(*[F.lit(k2 ** (h - level)).cast("bigint") for level in range(1, h + 1)])
    prefix = F.expr("z div weight")
    levels = cells.select(*by, "z", F.posexplode(weights).alias("level", "weight")).select(*by, "level", prefix.alias("prefix")).distinct()
    nodes = levels.groupBy(*by, "level", F.expr(f"prefix div {k2}L").alias("parent")).agg(F.collect_set((F.col("prefix") % k2).cast("int")).alias("children"), F.count(F.lit(1)).alias("set"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k2 - 1)), lambda j: F.when(F.array_contains("children", j), "1").otherwise("0")), "")
    node = F.struct("level", "parent", bits.alias("bits"))
    out = nodes.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(node)), lambda n: n["bits"]), "").alias("bits"),
        F.sum(F.when(F.col("level") == h - 1, F.col("set")).otherwise(0)).alias("leaves"),
        F.count(F.when(F.col("level") < h - 1, 1)).alias("inner"),
    )
    return out.select(*by, F.lit(k).alias("k"), F.lit(k**h).cast("bigint").alias("size"), "bits", (F.col("inner") * k2).cast("bigint").alias("internal"), F.coalesce("leaves", F.lit(0)).cast("bigint").alias("leaves"))


def decode_bits(bits: str, k: int, size: int) -> list[tuple[int, int]]:
    """Cells (line, col) of a tree, in K2 order, level by level."""
    line, col = _cells(bits, k, size)
    return list(zip(line.tolist(), col.tolist(), strict=True))


def _cells(bits: str, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and columns of a tree's cells: a level's nodes are read all at once."""
    set_bits = np.frombuffer(bits.encode(), np.uint8) == ord("1")
    line = col = np.zeros(1 if bits else 0, np.int64)
    at = 0
    for _ in range(height_of(k, size)):
        node, child = np.nonzero(set_bits[at : at + len(line) * k * k].reshape(len(line), k * k))
        at += len(line) * k * k
        line, col = line[node] * k + child // k, col[node] * k + child % k
    return line, col


def decode(trees: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per cell of each tree of ``encode``: the ``by`` columns, ``ordinal`` (from 0,
    in K2 order), line and col. Levels are read in order, so it is a pandas UDF. A tree is one
    value: a large matrix is encoded and decoded ``by`` blocks."""
    by = by or []
    kind = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("col", T.LongType())]))

    @F.pandas_udf(kind)
    def cells(bits: pd.Series, k: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([[{"line": a, "col": b} for a, b in decode_bits(x, kk, s)] for x, kk, s in zip(bits, k, size, strict=True)], dtype=object)

    return trees.select(*by, F.posexplode(cells("bits", "k", "size")).alias("ordinal", "cell")).select(*by, "ordinal", "cell.line", "cell.col")


def stats(trees: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Length in bits, height, cells and bits per cell of each tree."""
    h = F.round(F.log("size") / F.log("k")).cast("int")
    return trees.select(*(by or []), F.length("bits").cast("bigint").alias("length"), h.alias("height"), F.col("leaves").alias("edges"), (F.col("leaves") == 0).alias("is_empty"))
