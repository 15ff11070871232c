"""Verified links between the members of buckets, without a row for any candidate pair.

A similarity join deals its texts into buckets so that similar ones share one. From
there on this module does the rest: buckets with the same members are verified once, a
bucket of many members is split into blocks and a task holds two blocks at most, and a
pair that shares several buckets counts in the least of them alone. What leaves a task
is, for each text, its number of links there and one edge to the root of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgraph.llm.common import as_bytes, bound_batches, sliced
from gridgraph.plans.algorithms import component_labels
from gridgraph.plans.lineage import cut

#: Members of a block, and their weight in all; a task holds two blocks.
BLOCK, WEIGHT = 256, 2_000_000


def shared_buckets(members: DataFrame, block: int = BLOCK, weight: int = WEIGHT) -> DataFrame:
    """From ``members(bucket, id, weight)`` (distinct rows): for each id that shares a
    bucket, ``buckets``, the sorted array of (bucket, blocks) in which it is to be
    verified. ``weight`` is about the length of the member's text.

    Buckets are compared by size, least id and two sums over their members' hashes, so
    no bucket's members are ever gathered.
    """
    told = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"),
        F.sum("weight").alias("weight"),
    )
    blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.max("weight") / weight)).cast("int")
    kept = told.filter("size > 1").groupBy("size", "least", "x", "y").agg(F.min("bucket").alias("bucket"), blocks.alias("blocks")).select("bucket", "blocks")
    return members.join(kept, "bucket").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bucket", "blocks"))).alias("buckets"))


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Rows of a sorted partition, by runs of equal first columns."""
    now, rows = None, []
    for batch in sliced(batches, 500):
        columns = [as_bytes(c) if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:n_keys] != now:
                if rows:
                    yield rows
                now, rows = row[:n_keys], []
            rows.append(row)
    if rows:
        yield rows


def link(rows: DataFrame, key: str, buckets: str, data: str, prepare: Callable, linked: Callable) -> DataFrame:
    """``links(key, links, root)`` from rows of a key (string), its buckets (of
    ``shared_buckets``) and its text: one row for each unit of work in which the key has
    links. A key in no row has none.

    ``prepare(texts)`` makes a unit's texts ready once, and ``linked(ready, i, js)`` gives
    those of the positions js whose texts are similar to the one at i.
    """
    bound_batches(rows.sparkSession, 500)
    dealt = (
        rows.select(F.col(key).alias("k"), F.col(data).cast("binary").alias("d"), F.transform(buckets, lambda b: b["bucket"]).alias("all"), F.explode(buckets).alias("u"))
        .select("k", "d", "all", F.col("u.bucket").alias("bucket"), F.col("u.blocks").alias("n"))
        .withColumn("own", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "k", "own", "all", "d")
    )
    schema = "key string, links bigint, root string"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for unit in groups(batches, 3):
            out += _unit(unit, prepare, linked)
            if len(out) > 5000:
                yield _links(out)
                out = []
        yield _links(out)

    return dealt.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "k").mapInArrow(verify, schema)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "links", "root"])


def _unit(rows: list[tuple], prepare: Callable, linked: Callable) -> list[tuple]:
    bucket, a, b = rows[0][:3]
    rows = [r for k, r in enumerate(rows) if not k or r[3] != rows[k - 1][3]]  # a key once
    if len(rows) < 2:
        return []
    ready = prepare([r[6] for r in rows])
    count, root = [0] * len(rows), list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sets = [set(r[5]) for r in rows]
    own = np.array([r[4] for r in rows])
    # Most members of a large group share their least bucket, and their pairs are its.
    first = np.array([min(r[5]) for r in rows])
    for i in range(len(rows) - 1):
        js = (first[i + 1 :] != first[i]) | (first[i] == bucket)
        if a != b:
            js &= own[i + 1 :] != own[i]  # pairs of one block are in that block's own unit
        js = np.flatnonzero(js) + i + 1
        if first[i] != bucket:
            js = [j for j in js.tolist() if min(sets[i] & sets[j]) == bucket]
        for j in linked(ready, i, np.asarray(js, np.int64)) if len(js) else ():
            count[i] += 1
            count[j] += 1
            root[top(i)] = top(j)
    least: dict[int, str] = {}
    for i in range(len(rows)):
        if count[i]:
            least[top(i)] = min(least.get(top(i), rows[i][3]), rows[i][3])
    return [(rows[i][3], count[i], least[top(i)]) for i in range(len(rows)) if count[i]]


def classes(links: DataFrame) -> DataFrame:
    """``(key, n_links, root)`` from ``links``: the sum of links of each key, and the least
    key of its connected component."""
    links = cut(links)
    roots = component_labels(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    return links.groupBy("key").agg(F.sum("links").alias("n_links")).join(roots.withColumnRenamed("node", "key"), "key")
