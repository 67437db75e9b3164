"""Lineage cuts in the folder that the driver and all executors share, and small Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: A job's shuffle files go once its table is written, and the Arrow batches of its tasks stay small.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode (tests); a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tallyframe-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These session settings inside the block."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: The stored tables of each open ``scratch`` block.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a lineage cut that survives lost executors.

    Inside a ``scratch`` block the table goes with the block; with ``keep`` it goes with the block around that, if any.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    own = _OPEN[: -1 if keep else None]
    if own:
        own[-1].append(path)
    with settings(spark, WHILE_WRITING):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are removed at its end. What the block returns must not read them: store it with ``keep``."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN.pop()
        for path in paths:
            drop_path(spark, path)


def keep_last(spark: SparkSession) -> None:
    """Of the tables of the innermost ``scratch`` block, only the one stored last stays. Nothing may read the others any more."""
    while len(_OPEN[-1]) > 1:
        drop_path(spark, _OPEN[-1].pop(0))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that no returned DataFrame reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that only a few hundred texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_LIVE: dict[Hashable, Callable[[], object]] = {}


def claim_cache(owner: Hashable, clear: Callable[[], object]) -> None:
    """Called at the start of a task whose function keeps a cache between tasks: empties all other owners' caches.

    Python workers outlive their tasks, so the caches of all stages that a worker has seen would add up.
    """
    for other in [o for o in _LIVE if o != owner]:
        _LIVE.pop(other)()
    _LIVE[owner] = clear
