import json

import pyarrow.parquet as pq
import pytest
from gridgraph import PropertyGraph
from gridgraph.sources import edge_list
from gridgraph.streaming.updates import apply_stream
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edge_list(spark, tmp_path):
    path = tmp_path / "edges.txt"
    path.write_text("% comment\n# comment\n4 4 3\n1 2 7\n2\t3\n3 1 -5\n")
    vertices, edges = edge_list.read_edge_list(spark, str(path))
    assert rows(edges) == [(1, 2, 7), (2, 3, 0), (3, 1, -5)] and rows(vertices) == [(1, 1), (2, 1), (3, 1)]
    assert edge_list.read_edge_list(spark, str(path), header=False)[1].count() == 4
    path.write_text("h\n 1 2\n")
    assert rows(edge_list.read_edge_list(spark, str(path), trim=True)[1]) == [(1, 2, 0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cast"):
        edge_list.read_edge_list(spark, str(path))[1].collect()
    path.write_text("h\n1\n")
    with pytest.raises(Exception, match="fewer than two fields"):
        edge_list.read_edge_list(spark, str(path))[1].collect()
    path.write_text("")
    assert edge_list.read_edge_list(spark, str(path))[1].isEmpty()


def test_written_and_read_again(spark, tmp_path):
    e = spark.createDataFrame([(i, i * i % 11, i) for i in range(11)], "src bigint, dst bigint, attr int").repartition(3)
    edge_list.write_edge_list(e, str(tmp_path / "text"))
    assert rows(edge_list.read_edge_list(spark, str(tmp_path / "text"), header=False)[1]) == rows(e)
    edge_list.write_matrix_parquet(e, str(tmp_path / "z"), 2, 11, 2)
    assert rows(spark.read.parquet(str(tmp_path / "z"))) == rows(e)
    edge_list.write_report(spark, {"a": [1]}, str(tmp_path / "report"))
    assert json.loads(spark.read.text(str(tmp_path / "report")).first().value) == {"a": [1]}
    drawn = edge_list.random_edges(spark, 50, 0.2)
    assert 300 < drawn.count() < 700 and drawn.distinct().count() == drawn.count()


def test_stream_of_edges(spark, tmp_path):
    base = str(tmp_path / "graph")
    schema = "src bigint, dst bigint, attr bigint"
    edge_list.write_graph(PropertyGraph.from_edges(spark.createDataFrame([(1, 2, 5)], schema), 0), f"{base}/0")
    spark.createDataFrame([(2, 3, 1), (1, 2, 9)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = apply_stream(stream, base, str(tmp_path / "ck"), lambda g, new: g.add_edges(new, 0))
    assert q.awaitTermination(120)
    assert rows(edge_list.read_graph(spark, f"{base}/1").edges) == [(1, 2, 5), (2, 3, 1)]


def test_files_of_matrix_order_cover_small_rectangles(spark, tmp_path):
    """Row groups of a Z-ordered file can be skipped on either end of an edge."""
    e = spark.range(64 * 64).select((F.col("id") % 64).alias("src"), F.expr("id div 64").alias("dst"), F.lit(1).alias("attr")).repartition(5)

    def covered(path):
        area = 0
        for f in path.glob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                ends = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(3)}
                area += (ends["src"].max - ends["src"].min + 1) * (ends["dst"].max - ends["dst"].min + 1)
        return area

    edge_list.write_matrix_parquet(e, str(tmp_path / "z"), 2, 64, 16)
    e.repartition(16).write.parquet(str(tmp_path / "any"))
    assert covered(tmp_path / "z") < 4 * 64 * 64 and covered(tmp_path / "any") > 12 * 64 * 64
    found = spark.read.parquet(str(tmp_path / "z")).filter("src < 8 and dst < 8")
    assert found.count() == 64 and "PushedFilters: [IsNotNull(src), IsNotNull(dst), LessThan(src,8), LessThan(dst,8)]" in found._jdf.queryExecution().toString()


def test_random_matrices(spark):
    assert edge_list.random_edges(spark, 30, 1.0).count() == 900 and edge_list.random_edges(spark, 30, 0.0).isEmpty() and edge_list.random_edges(spark, 0, 0.5).isEmpty()
    a, b, c = (rows(edge_list.random_edges(spark, 40, 0.3, seed)) for seed in (1, 1, 2))
    assert a == b != c and len(set(a)) == len(a) and 300 < len(a) < 660
    # Rows without an end in sight: a matrix of a billion rows and columns, of which few are looked at.
    assert edge_list.random_edges(spark, 1_000_000_000, 1e-9).limit(3).count() == 3
    with pytest.raises(ValueError):
        edge_list.random_edges(spark, 10, 1.5)
