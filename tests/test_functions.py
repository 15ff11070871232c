"""K2-trees, bitsets and partition numbers against fixed values."""

import itertools
import random

import pytest
from gridgraph import PropertyGraph
from gridgraph.functions import bitset, k2
from gridgraph.operators import partitioning
from pyspark.sql import functions as F

TREES = [
    (2, 4, [(1, 0), (1, 1), (0, 2), (2, 1), (3, 0), (3, 3)], "1111 0011 1000 0110 0001"),
    (2, 8, [(0, 0), (1, 0), (6, 6), (7, 7)], "1001 1000 0001 1010 1001"),
    (2, 8, [(1, 0), (1, 1), (1, 2), (2, 1), (3, 0), (2, 5), (6, 2), (6, 6)], "1111 1110 0010 0001 0001 0011 0010 0110 0100 1000 1000"),
    (2, 5, [(1, 0), (1, 1), (1, 2), (2, 1), (3, 0), (2, 5), (6, 2), (6, 6)], "1111 1110 0010 0001 0001 0011 0010 0110 0100 1000 1000"),
    (2, 16, [(3, 3), (1, 12), (13, 2), (8, 11)], "1111 1000 0100 0010 1000 0001 1000 0100 0100 0001 0010 0010 0100"),
    (4, 16, [(0, 0), (1, 12), (8, 11), (13, 2)], "1001000000101000 1000000000000000 0000100000000000 0001000000000000 0000001000000000"),
    (2, 4, list(itertools.product(range(4), range(4))), "1" * 20),
    (4, 4, [(0, 2), (1, 0), (1, 1), (2, 1), (3, 0), (3, 3)], "0010110001001001"),
]


def cells(spark, pairs):
    return spark.createDataFrame(pairs, "line bigint, col bigint").repartition(4)


@pytest.mark.parametrize(("k", "size", "pairs", "bits"), TREES)
def test_trees(spark, k, size, pairs, bits):
    row = k2.encode(cells(spark, pairs + pairs[:1]), k, size).first()
    assert row.bits == bits.replace(" ", "") and row.leaves == len(pairs) and row["size"] == k2.padded_size(k, size)
    assert sorted(k2.decode_bits(row.bits, k, size)) == sorted(pairs)
    told = k2.stats(k2.encode(cells(spark, pairs), k, size)).first()
    assert (told.length, told.height, told.edges, told.is_empty) == (len(row.bits), k2.height_of(k, size), len(pairs), False)


def test_encode_then_decode(spark):
    rng = random.Random(4)
    for k, size in ((2, 37), (3, 50), (8, 513)):
        pairs = sorted({(rng.randrange(size), rng.randrange(size)) for _ in range(200)})
        found = k2.decode(k2.encode(cells(spark, pairs), k, size)).orderBy("ordinal").collect()
        assert sorted((r.line, r.col) for r in found) == pairs
        z = lambda p: sum(((p[0] // k**i % k) * k + p[1] // k**i % k) * k ** (2 * i) for i in range(12))  # noqa: B023, E731
        assert [(r.line, r.col) for r in found] == sorted(pairs, key=z)
    none = k2.encode(cells(spark, []), 2, 4)
    assert tuple(none.first()) == (2, 4, "", 0, 0) and k2.decode(none).isEmpty() and k2.stats(none).first().is_empty
    assert k2.decode_bits("", 2, 4) == []


def test_heights_are_exact():
    assert [k2.height_of(8, 8**n) for n in (1, 3, 6, 7)] == [1, 3, 6, 7] and k2.height_of(64, 64**3) == 3
    assert k2.height_of(2, 0) == k2.height_of(2, 1) == 1 and k2.height_of(2, 5) == 3


def test_index(spark):
    z = lambda k, h, *p: cells(spark, [p]).select(k2.k2_index(F.col("line"), F.col("col"), k, h)).first()[0]
    assert z(2, 3, 3, 3) == 15 and z(2, 3, 4, 4) == z(2, 4, 4, 4)
    assert z(2, 3, 3, 3) < z(2, 3, 4, 4) > z(2, 3, 4, 3)
    assert sorted(z(2, 2, a, b) for a in range(4) for b in range(4)) == list(range(16))
    assert z(8, 10, 20, 2425151) < z(8, 10, 298385420, 294846486)
    with pytest.raises(ValueError):
        k2.k2_index(F.lit(1), F.lit(1), 2, 41)


BITS = [0, 10, 20, 30, 63, 64, 70, 80, 89, 90, 100, 127, 128, 140, 141, 191]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def made(bits, size=192):
    out = bitset.empty(size)
    for b in bits:
        out = bitset.set_bit(out, b)
    return out


@pytest.fixture(scope="module")
def held(spark):
    words = [0] * 3
    for b in BITS:
        words[b // 64] |= 1 << b % 64
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    return spark.createDataFrame([(signed, [3])], "w array<bigint>, o array<bigint>")


def test_rank(held):
    want = {(0, -1): 0, (0, 0): 1, (0, 10): 2, (0, 63): 5, (0, 64): 6, (0, 89): 9, (0, 191): 16, (10, 191): 15, (63, 64): 2, (63, 127): 8, (63, 128): 9, (63, 191): 12, (64, 191): 11}
    got = held.select(*[bitset.count("w", a, b).alias(f"{a},{b}") for a, b in want]).first().asDict()
    assert got == {f"{a},{b}": n for (a, b), n in want.items()}


def test_bit_operations(spark, held):
    one = lambda c: held.select(c.alias("x")).first().x
    assert one(bitset.positions("w")) == BITS and one(bitset.cardinality("w")) == 16
    assert [one(bitset.next_set_bit("w", n)) for n in (0, 1, 64, 142, 192)] == [0, 10, 64, 191, -1]
    assert one(bitset.get_bit("w", 63)) and not one(bitset.get_bit("w", 62)) and not one(bitset.get_bit("w", 500))
    assert one(bitset.positions(bitset.unset_bit("w", 191))) == BITS[:-1]
    assert one(bitset.positions(bitset.set_bit("w", 5))) == sorted([*BITS, 5])
    assert one(bitset.positions(bitset.set_until("o", 70))) == list(range(64))
    assert one(bitset.positions(bitset.set_until("w", 12))) == [*range(12), *BITS[2:]]
    assert one(bitset.positions(bitset.clear_until("w", 64))) == BITS[5:] and one(bitset.positions(bitset.clear("w"))) == []
    assert one(bitset.positions(bitset.bits_and("w", "o"))) == [0] and one(bitset.positions(bitset.bits_xor("w", "o"))) == sorted({*BITS, 1} - {0})
    assert one(bitset.positions(bitset.bits_or("o", "w"))) == sorted({*BITS, 1}) and one(bitset.positions(bitset.bits_and_not("w", "o"))) == BITS[1:]
    assert one(bitset.positions(bitset.reverse("w"))) == sorted(191 - b for b in BITS)
    assert one(bitset.capacity("w")) == 192 and one(bitset.capacity(bitset.grow("w", 200))) == 256
    assert value(spark, bitset.cardinality(made([1, 65]))) == 2
    assert round(value(spark, bitset.log(2, F.lit(8.0))), 9) == 3


@pytest.mark.parametrize(
    ("size", "n", "pairs", "want"),
    [
        (4, 4, TREES[0][2], {0: 2, 1: 1, 2: 2, 3: 1}), (4, 2, TREES[0][2], {0: 4, 1: 2}),
        (8, 16, TREES[1][2], {0: 2, 15: 2}), (8, 10, TREES[1][2], {0: 2, 5: 2}), (1, 16, [(0, 0), (1, 1)], None), (0, 4, [(0, 0)], {0: 1}),
    ],
)
def test_grid(spark, size, n, pairs, want):
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = {r.p: r["count"] for r in e.groupBy(partitioning.grid_partition(n, size).alias("p")).count().collect()}
    assert got == want if want else all(0 <= p < n for p in got)


def test_edge_partitions(spark):
    e = spark.createDataFrame([(1, 5), (5, 1), (3, 4)], "src bigint, dst bigint")
    assert [r[0] for r in e.select(partitioning.edge_partition_2d(4)).collect()] == [3, 3, 2]
    assert [r[0] for r in e.select(partitioning.edge_partition_1d(4)).collect()] == [1, 1, 3]
    big = spark.createDataFrame([(2**62 + k, -(2**61) * k) for k in range(-2, 3)], "src bigint, dst bigint")
    for n in (4, 7):
        for f in (partitioning.edge_partition_1d, partitioning.edge_partition_2d, partitioning.random_vertex_cut, partitioning.canonical_random_vertex_cut):
            assert all(0 <= r[0] < n for r in big.select(f(n)).collect())


def test_partition_by_places_edges(spark):
    e = spark.createDataFrame([(i % 9, i % 7, i) for i in range(60)], "src bigint, dst bigint, attr int")
    g = PropertyGraph.from_edges(e)
    placed = g.partition_by(partitioning.edge_partition_2d, 9).edges.withColumn("at", F.spark_partition_id())
    assert placed.filter(F.col("at") != partitioning.edge_partition_2d(9)).isEmpty() and placed.rdd.getNumPartitions() == 9
    assert g.partition_by_grid(5).num_edges() == g.num_edges()
    assert partitioning.k2_ranged(g.edges, 2, 9, 3).count() == partitioning.k2_sorted(g.edges, 2, 9).count() == g.num_edges()


def test_bit_ranges_beyond_the_words(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        size = rng.randint(0, 5)
        held = {b for b in range(64 * size) if rng.random() < rng.choice([0.02, 0.5])}
        words = [sum(1 << b % 64 for b in held if b // 64 == k) for k in range(size)]
        a, b = rng.randint(-3, 400), rng.randint(-3, 400)
        rows.append(([w - (1 << 64) if w >> 63 else w for w in words], a, b, sum(a <= x <= b for x in held), min((x for x in held if x >= a), default=-1)))
    df = spark.createDataFrame(rows, "w array<bigint>, a bigint, b bigint, n int, first bigint")
    got = df.select("n", "first", bitset.count("w", F.col("a"), F.col("b")).alias("found"), bitset.next_set_bit("w", F.col("a")).alias("next")).collect()
    assert all((r.n, r.first) == (r.found, r.next) for r in got), got
