"""The benchmark harness of graph workloads: options, measurements, report.

    python -m gridgraph.bench.harness --dataset-dir DIR --output PATH

A dataset is an edge list ``DIR/NAME.mtx``. Each layout (plain rows, or Z-ordered ones) is
built and cached, and each workload is timed on it after some warm-up runs.
"""

from __future__ import annotations

import argparse
import os
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridgraph.graph import PropertyGraph
from gridgraph.operators.partitioning import k2_ranged
from gridgraph.sources.edge_list import read_edge_list, write_report


@dataclass
class Options:
    implementations: str = ".*"
    workloads: str = ".*"
    datasets: str = ".*"
    dataset_dir: str = "datasets"
    warmup: int = 0
    samples: int = 1
    memory: bool = True
    build: bool = True
    iteration: bool = True
    throughput: bool = True
    cpu: bool = True
    output: str = ""

    @staticmethod
    def parse(args: list[str] | None = None) -> Options:
        p = argparse.ArgumentParser()
        for name, value in asdict(Options()).items():
            flag = "--" + name.replace("_", "-")
            if isinstance(value, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
            else:
                p.add_argument(flag, type=type(value), default=value)
        return Options(**vars(p.parse_args(args)))


@dataclass
class Measure:
    """Values of all samples, with their mean in whole numbers; 0 without any."""

    workload: str
    values: list[int] = field(default_factory=list)

    @property
    def mean(self) -> int:
        return sum(self.values) // len(self.values) if self.values else 0

    def told(self) -> dict:
        return {"workload": self.workload, "values": self.values, "mean": self.mean}


def _done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


#: Workloads force their whole result, so that times hold all of the work.
WORKLOADS: dict[str, Callable[[PropertyGraph], None]] = {
    "map": lambda g: _done(g.map_edges(lambda s, d, a: a * 2).edges),
    "pageRank": lambda g: _done(g.page_rank(0.1).vertices),
    "triangleCount": lambda g: _done(g.triangle_count().vertices),
    "connectedComponents": lambda g: _done(g.connected_components().vertices),
    "shortestPath": lambda g: _done(g.shortest_paths([g.pick_random_vertex()]).vertices),
}

LAYOUTS: dict[str, Callable[[PropertyGraph], PropertyGraph]] = {
    "plain": lambda g: g,
    "zorder": lambda g: PropertyGraph(g.vertices, k2_ranged(g.edges, 8, (g.max_vertex_id() or 0) + 1, int(g.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))),
}


def stored_bytes(spark: SparkSession) -> int:
    """What cached tables take in memory and on disk."""
    return sum(x.memSize() + x.diskSize() for x in spark.sparkContext._jsc.sc().getRDDStorageInfo())


def _timed(f: Callable[[], object]) -> int:
    began = time.perf_counter()
    f()
    return int((time.perf_counter() - began) * 1000)


def _process_cpu_ms(spark: SparkSession) -> int:
    """CPU time of the driver's JVM, which holds the executors in local mode, from the
    system's process table; 0 where there is none."""
    stat = Path(f"/proc/{spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()}/stat")
    if not stat.exists():
        return 0
    fields = stat.read_text().rpartition(")")[2].split()
    return (int(fields[11]) + int(fields[12])) * 1000 // os.sysconf("SC_CLK_TCK")


def run(spark: SparkSession, o: Options) -> list[dict]:
    report = []
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(o.dataset_dir)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(base)
    paths = [str(f.getPath()) for f in files if str(f.getPath()).endswith(".mtx") and re.search(o.datasets, PurePosixPath(str(f.getPath())).stem)]
    for layout in (x for x in LAYOUTS if re.search(o.implementations, x)):
        for path in sorted(paths):
            vertices, edges = read_edge_list(spark, path)
            make = lambda v=vertices, e=edges, f=LAYOUTS[layout]: f(PropertyGraph.of(v, e, 0)).persist()
            g = make()
            g.num_vertices()
            n_edges = g.num_edges()
            told = {"implementation": layout, "dataset": PurePosixPath(path).stem, "edges": n_edges}
            if o.memory:
                told["memory_bytes"] = stored_bytes(spark)
            if o.build:
                m = Measure("build")
                for k in range(o.warmup + o.samples):
                    ms = _timed(lambda: LAYOUTS[layout](PropertyGraph.of(vertices, edges, 0)).edges.agg(F.count(F.lit(1))).collect())  # noqa: B023
                    m.values += [ms] if k >= o.warmup else []
                told["build_ms"] = m.told()
            chosen = [w for w in WORKLOADS if re.search(o.workloads, w)]
            for kind, wanted in (("iteration_ms", o.iteration), ("throughput_rows_s", o.throughput), ("cpu_ms", o.cpu)):
                for name in chosen if wanted else ():
                    if kind != "iteration_ms" and name != "map":
                        continue
                    m = Measure(name)
                    for k in range(o.warmup + o.samples):
                        cpu = _process_cpu_ms(spark)
                        ms = _timed(lambda: WORKLOADS[name](g))  # noqa: B023
                        value = {"iteration_ms": ms, "throughput_rows_s": n_edges * 1000 // max(ms, 1), "cpu_ms": _process_cpu_ms(spark) - cpu}[kind]
                        m.values += [value] if k >= o.warmup else []
                    told.setdefault(kind, []).append(m.told())
            g.unpersist(True)
            report.append(told)
    if o.output:
        write_report(spark, {"options": asdict(o), "results": report}, o.output)
    return report


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("gridgraph-bench").getOrCreate(), Options.parse()))
