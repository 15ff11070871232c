"""Exact top-k inner products by elimination over a table of pivot distances.

Distances from every vector to ``PIVOTS`` pivots, chosen far from one another, are
computed once. For a query q and a vector v, the greatest difference of their distances
to a pivot is a lower bound of their own distance d, and as ``2 q.v = |q|^2 + |v|^2 -
d^2``, an upper bound of their inner product. Candidates are evaluated in order of that
bound, and evaluation stops when the bound falls below the k-th score: no other
candidate can enter the result.

Vectors are dealt into blocks by their nearest pivot and the distance to it. First every
query is answered within its own block, which gives a threshold. A block's ranges of
pivot distances then bound all its members at once: only blocks whose bound reaches the
threshold are dealt the query, and in these the threshold is where elimination begins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridgraph.llm.common import sliced, table, written

PIVOTS = 32
#: Vectors of which the pivots are chosen, at most. Any choice gives the same result.
SAMPLE = 1024
#: Rows of a block, queries that meet it in one task, and blocks that are bounded in one.
BLOCK, QUERY_BLOCK, BOUNDED = 4096, 2048, 1024
#: Candidates evaluated before the first look at the bound; each step has four times as many.
STEP = 32
#: Distances are kept in 32 bits; bounds are widened by far more than that and any rounding.
SLACK = 1e-6
#: Components have to be smaller than this, so that scores are 64-bit numbers.
LARGEST = 1 << 28

_IN = ["size", "cell", "ring", "sub"]
_FOUND = "query bigint, query_id bigint, key bigint, no_id boolean, score bigint"


def integer_vectors(rows: DataFrame, vec_col: str, scale: float = 64.0) -> DataFrame:
    """``rows`` whose vectors are not null and all finite, with v = floor(scale * x)."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    small = lambda x: F.when(F.abs(x) < LARGEST, x).otherwise(F.raise_error(F.lit("a vector's component is too large for 64-bit scores")).cast("double"))
    v = F.transform(vec_col, lambda x: F.floor(small(F.lit(scale) * x.cast("double"))).cast("bigint"))
    return rows.filter(F.col(vec_col).isNotNull() & finite).withColumn("v", v)


def far_apart(sample: list[list[int]], n: int) -> dict[int, np.ndarray]:
    """For each length of vectors, up to n of them, each as far as can be from those
    before it; the first is the farthest from the mean."""
    out = {}
    for size in sorted({len(v) for v in sample} - {0}):
        x = np.array(sorted(v for v in sample if len(v) == size), np.float64)
        chosen, far = [], ((x - x.mean(axis=0)) ** 2).sum(axis=1)
        while len(chosen) < n and far.max() > 0:
            chosen.append(int(far.argmax()))
            to = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
            far = to if len(chosen) == 1 else np.minimum(far, to)
        out[size] = x[chosen]
    return out


def _packed(v: np.ndarray) -> bytes:
    most = np.abs(v).max(initial=0)
    kind = "h" if most < 1 << 15 else "i"
    return kind.encode() + v.astype(f"<i{2 if kind == 'h' else 4}").tobytes()


def _matrix(packed: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of 64-bit floats, which hold them exactly."""
    return np.array([np.frombuffer(b, "<i2" if b[0] == 104 else "<i4", offset=1) for b in packed], np.float64)


def _far(packed: pd.Series) -> np.ndarray:
    return np.array([np.frombuffer(b, "<f4") for b in packed])


def _placed(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Vectors with their pivot distances, the nearest pivot and how far it is."""
    schema = "row bigint, id bigint, asks boolean, v binary, far binary, norm double, size int, cell int, own double"

    def run(batches):
        for batch in sliced(batches, 2000):
            values, offsets = batch.column(3).flatten().to_numpy(), np.append(0, np.cumsum(batch.column(3).value_lengths().to_numpy()))
            v, far, norms, sizes, cells, own = [], [], [], [], [], []
            for a, b in zip(offsets, offsets[1:], strict=False):
                x = values[a:b]
                exact = x.astype(np.float64)
                p = pivots.get(len(x))
                d = np.sqrt(((p - exact) ** 2).sum(axis=1)) if p is not None and len(p) else np.zeros(1)
                v.append(_packed(x))
                far.append(d.astype("<f4").tobytes())
                norms.append(float(exact @ exact))
                sizes.append(len(x))
                cells.append(int(d.argmin()))
                own.append(float(d.min()))
            kinds = [pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x, t) for x, t in zip((v, far, norms, sizes, cells, own), kinds, strict=True)]], names=[x.split()[0] for x in schema.split(", ")])

    return vectors.select(F.monotonically_increasing_id().alias("row"), "id", "asks", "v").mapInArrow(run, schema)


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Vectors with the block that they are in: cells, cut into rings of distance to their
    pivot, cut further where a ring has many rows."""
    cells = placed.groupBy("size", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rings"), F.min("own").alias("low"), F.max("own").alias("high"))
    at = F.floor((F.col("own") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("rings")).cast("int")
    rings = placed.join(cells, ["size", "cell"]).withColumn("ring", F.when(F.col("high") > F.col("low"), F.least(at, F.col("rings") - 1)).otherwise(0)).drop("rings", "low", "high")
    subs = rings.groupBy("size", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).alias("subs"))
    return rings.join(subs, ["size", "cell", "ring"]).withColumn("sub", F.pmod(F.xxhash64("row"), "subs").cast("int")).drop("subs", "own")


def _ranges(dealt: DataFrame) -> DataFrame:
    """Each block's least and greatest distances to the pivots, and greatest norm. A task
    passes on one row for each block that it has; no vector is shuffled."""
    schema = "size int, cell int, ring int, sub int, low binary, high binary, norm double"

    def of(rows: pd.DataFrame, low: str, high: str) -> pd.DataFrame:
        out = []
        for key, some in rows.groupby(_IN):
            out.append((*key, np.array([np.frombuffer(b, "<f4") for b in some[low]]).min(axis=0).tobytes(), np.array([np.frombuffer(b, "<f4") for b in some[high]]).max(axis=0).tobytes(), some["norm"].max()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    def partly(frames):
        for f in frames:
            yield of(f, "far", "far")

    return dealt.select(*_IN, "far", "norm").mapInPandas(partly, schema).groupBy(*_IN).applyInPandas(lambda rows: of(rows, "low", "high"), schema)


def upper_bound(q_norm: float, norms: np.ndarray, low: np.ndarray, reach: float) -> np.ndarray:
    """The greatest inner product of a query with vectors at a distance of ``low`` or more;
    ``reach`` is the largest distance that went into ``low``."""
    low = np.maximum(low - SLACK * (1 + reach), 0)
    both = q_norm + norms
    return (both - low * low) / 2 + SLACK * (1 + SLACK * both)


def best_of_block(
    q: np.ndarray, q_far: np.ndarray, q_norm: float, c: np.ndarray, c_far: np.ndarray, norms: np.ndarray, tie: np.ndarray, k: int, least: float = -np.inf, own: int = -1
) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions and scores of the k best candidates of ``least`` or more, and how many
    were evaluated. Ties go to the smaller ``tie``; ``own`` is a position that takes no part."""
    low = np.abs(c_far - q_far).max(axis=1)
    bound = upper_bound(q_norm, norms, low, max(q_far.max(), c_far.max()))
    if own >= 0:
        bound[own] = -np.inf
    order = np.flatnonzero((bound >= least) & (bound > -np.inf))
    order = order[np.argsort(-bound[order])]
    found, scores, at, step = np.zeros(0, np.int64), np.zeros(0), 0, STEP
    while at < len(order) and bound[order[at]] >= least:
        some = order[at : at + step]
        at += len(some)
        step *= 4
        s = c[some] @ q
        good = np.flatnonzero(s >= least)
        if not len(good):
            continue
        found, scores = np.append(found, some[good]), np.append(scores, s[good])
        if len(scores) > k:
            keep = np.lexsort((tie[found], -scores))[:k]
            found, scores = found[keep], scores[keep]
        if len(scores) == k:
            least = scores.min()
    return found, scores, at


def _answers(asks: pd.DataFrame, rows: pd.DataFrame, k: int, inside: bool) -> pd.DataFrame:
    """The best of a block for each query; ``inside`` says that the queries stand in it."""
    rows = rows.sort_values("row", ignore_index=True)
    key, no_id = rows["key"].to_numpy(), rows["no_id"].to_numpy()
    tie = np.empty(len(rows), np.int64)
    tie[np.lexsort((no_id, key))] = np.arange(len(rows))
    c, c_far, norms, numbers = _matrix(rows["v"]), _far(rows["far"]), rows["norm"].to_numpy(), rows["row"].to_numpy()
    places, all_scores, sizes = [], [], []
    for number, v, far, norm, least in zip(asks["row"], _matrix(asks["v"]), _far(asks["far"]), asks["norm"], asks["least"], strict=True):
        own = int(np.searchsorted(numbers, number)) if inside else -1
        found, scores, _ = best_of_block(v, far, norm, c, c_far, norms, tie, k, least, own)
        places.append(found)
        all_scores.append(scores)
        sizes.append(len(found))
    at = np.concatenate(places)
    asked = pd.arrays.IntegerArray(np.repeat(asks["key"].to_numpy(), sizes), np.repeat(asks["no_id"].to_numpy(), sizes))
    return pd.DataFrame({"query": np.repeat(asks["row"].to_numpy(), sizes), "query_id": asked, "key": key[at], "no_id": no_id[at], "score": np.concatenate(all_scores).astype(np.int64)})


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({x.split()[0]: pd.Series(dtype="bool" if "boolean" in x else "int64") for x in _FOUND.split(", ")})


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "no_id", "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which ``queries`` holds,
    its k highest integer inner products among all other rows; all, if fewer.

    Vectors that are null or hold a null or a component that is not finite take no part;
    vectors of a length other than the query's are no candidates for it, empty ones have
    a score of 0 with each other. Ids are whole numbers and may be null or repeat: every
    row is a query or a candidate of its own, and ties go to the smaller id, null last.
    """
    spark = rows.sparkSession
    vectors = integer_vectors(rows.withColumn("asks", F.coalesce(queries, F.lit(False))), vec_col).select(F.col(id_col).cast("bigint").alias("id"), "asks", "v")
    sample = [r.v for r in vectors.orderBy(F.xxhash64("id", "v"), "v").limit(SAMPLE).select("v").collect()]
    placed = written(_placed(vectors, far_apart(sample, pivots)), "vectors")
    told = placed.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("asked")).first()
    parallel = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _blocks(placed, max(BLOCK // 16, min(BLOCK, -(-told.n // parallel)))).select(
        "row", F.coalesce("id", F.lit(2**63 - 1)).alias("key"), F.col("id").isNull().alias("no_id"), "asks", "v", "far", "norm", *_IN
    )

    def within(group: pd.DataFrame) -> pd.DataFrame:
        asks = group[group["asks"]]
        return _answers(asks.assign(least=-np.inf), group, k, True) if len(asks) else _nothing()

    first = _ranked(written(dealt.groupBy(*_IN).applyInPandas(within, _FOUND), "own-block"), k)
    least = first.groupBy(F.col("query").alias("row")).agg(F.max(F.when(F.col("rank") == k, F.col("score"))).cast("double").alias("least"))
    asks = dealt.filter("asks").join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    # Queries in groups meet blocks in groups, as ranges of distances only.
    ranges = written(_ranges(dealt), "block-ranges")
    sides = [max(1, -(-told.asked // QUERY_BLOCK)), max(1, -(-ranges.count() // BOUNDED))]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asks.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(sides[0])).cast("int")).select("*", every(sides[1]).alias("h"))
    b = ranges.withColumnRenamed("norm", "most").withColumn("h", F.pmod(F.xxhash64(*_IN), F.lit(sides[1])).cast("int")).select("*", every(sides[0]).alias("g"))
    query = ["row", "key", "no_id", "v", "far", "norm", "least"]
    pair = "size int, cell int, ring int, sub int, row bigint, key bigint, no_id boolean, v binary, far binary, norm double, least double"

    def reached(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, some in asked.groupby("size"):
            near = blocks[blocks["size"] == size].reset_index(drop=True)
            if not len(near):
                continue
            low, high, most = _far(near["low"]), _far(near["high"]), near["most"].to_numpy()
            places, own = near[_IN].to_numpy(), some[_IN].to_numpy()
            far, norms, least = _far(some["far"]), some["norm"].to_numpy(), some["least"].to_numpy()
            blocks_of = []
            for n in range(len(some)):
                gap = np.maximum(low - far[n], far[n] - high).max(axis=1)
                good = upper_bound(norms[n], most, gap, max(far[n].max(), high.max())) >= least[n]
                blocks_of.append(np.flatnonzero(good & (places != own[n]).any(axis=1)))
            each, at = np.repeat(np.arange(len(some)), [len(x) for x in blocks_of]), np.concatenate(blocks_of)
            out.append(pd.concat([pd.DataFrame(places[at], columns=_IN), some[query].iloc[each].reset_index(drop=True)], axis=1))
        return pd.concat(out) if out else pd.DataFrame(columns=[*_IN, *query])

    pairs = a.groupBy("g", "h").cogroup(b.groupBy("g", "h")).applyInPandas(reached, pair)
    pairs = written(pairs.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(sides[0])).cast("int")), "block-queries")
    there = dealt.join(pairs.select(*_IN, F.col("chunk").alias("part")).distinct(), _IN)

    def across(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _answers(asked, block, k, False) if len(asked) and len(block) else _nothing()

    then = pairs.groupBy(*_IN, "chunk").cogroup(there.groupBy(*_IN, "part")).applyInPandas(across, _FOUND)
    best = _ranked(first.drop("rank").unionAll(then), k)
    return best.select("query_id", "rank", F.when(~F.col("no_id"), F.col("key")).alias("vec_id"), "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM k WHERE k <= 20
"""
