"""What several operators of this folder need: shared storage, words, names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridgraph.plans.lineage import ensure_checkpoint_dir

#: Lower-cases A-Z and turns every ASCII byte that is not a letter or digit into a
#: blank; bytes from 0x80 on (all of UTF-8's longer sequences) stay word bytes.
_TO_WORDS = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text whose A-Z are
    lower-cased. None has no words."""
    return text.translate(_TO_WORDS).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table below the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def for_this_session(spark: SparkSession, path: str) -> None:
    """A written path is deleted when the driver's JVM ends; results may be read from it
    until then."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder: columns and row groups can be skipped
    when it is read again, which a checkpoint does not offer."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    for_this_session(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps Arrow batches small, unless the session has smaller ones. The setting is read
    when a plan is made, and results are planned by whoever uses them, so it stays; with
    Spark's default of 10,000 rows executors need half as much memory again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a worker has Python objects of few texts at
    a time. Spark's own bound (64 MB a batch) holds before."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
