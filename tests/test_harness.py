import json

from gridgraph.bench import micro
from gridgraph.bench.harness import Measure, Options, run


def test_options_and_means():
    o = Options.parse(["--workloads", "map", "--samples", "3", "--no-cpu"])
    assert (o.workloads, o.samples, o.cpu, o.memory) == ("map", 3, False, True)
    assert Measure("x").mean == 0 and Measure("x", [1, 2]).mean == 1


def test_report(spark, tmp_path):
    (tmp_path / "tiny.mtx").write_text("% c\n3 3 4\n1 2\n2 3\n3 1\n3 4 5\n")
    (tmp_path / "other.txt").write_text("no dataset")
    o = Options(dataset_dir=str(tmp_path), samples=2, warmup=0, workloads="map|triangle", output=str(tmp_path / "out"))
    told = run(spark, o)
    assert [t["implementation"] for t in told] == ["plain", "zorder"] and all(t["edges"] == 4 and t["memory_bytes"] > 0 for t in told)
    assert [m["workload"] for m in told[0]["iteration_ms"]] == ["map", "triangleCount"] and len(told[0]["cpu_ms"][0]["values"]) == 2
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["results"] == told


def test_micro_timings(spark, tmp_path):
    told = micro.main(["--sizes", "100", "400", "--ks", "2", "8", "--runs", "1", "--output", str(tmp_path / "micro")])
    assert [(m["size"], m["k"]) for m in told["build_ms"]] == [(100, 2), (100, 8), (400, 2), (400, 8)]
    assert {m["edges"] for m in told["memory"]} == {100, 400} and all(m["tree_bytes"] > 0 for m in told["memory"])
    assert [m["share"] for m in told["active_ms"]] == [0.1, 0.5, 1.0] and len(told["sparse_memory"]) == 6
    assert json.loads(spark.read.text(str(tmp_path / "micro")).first().value) == told
    base = micro.Base(spark, 100)
    assert base.graph.add_edges(micro._new_edges(spark, base, 25), 1).num_edges() == 125
