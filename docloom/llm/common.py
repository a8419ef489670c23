"""Shared folders, reread tables and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is absent and the session is of one machine (tests) is a temporary folder chosen, once for each
    session; on a cluster that would split a table over machines, so it is an error there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows of an Arrow batch at most: texts are long, and each batch is held by both sides.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """``df`` after lowering the session's Arrow batches to BATCH_ROWS rows (a smaller setting stays)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name, "10000")) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def fresh(spark: SparkSession, name: str) -> str:
    """A new path of the shared folder."""
    return f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and reread: lineage ends there and lost executors cost nothing before it."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` in this block go at its end; for blocks whose result has been written elsewhere by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


def forget(df: DataFrame) -> None:
    """Remove the table that ``written`` made of ``df``, which nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_bytes(col: str = "text"):
    """UTF-8 bytes of a text column, null as empty."""
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_slot: dict = {}


def worker_cache(owner: object, make):
    """The one cache that a worker process keeps from task to task, made by ``make``; that of another owner goes first.

    Workers live through many queries, so what each remembers would add up otherwise.
    """
    if owner not in _slot:
        if _slot:
            _slot.clear()
            release()
        _slot[owner] = make()
    return _slot[owner]


def release() -> None:
    """Give memory that has been freed back to the system, where the platform can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
