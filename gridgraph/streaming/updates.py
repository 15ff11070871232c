"""An extension: streams of edges or vertices applied to a stored graph, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridgraph.sources.edge_list import read_graph, write_graph


def apply_stream(stream: DataFrame, base_path: str, checkpoint: str, update: Callable, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch makes the next version of the graph, ``base_path/<batch + 1>``,
    from the one before it (version 0 has to exist): ``update(graph, rows)`` gives the
    new graph. A batch that is run again writes the same version again, so each row
    counts once."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        path = f"{base_path}/{batch + 1}"
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        write_graph(update(read_graph(spark, f"{base_path}/{batch}"), rows), path)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
