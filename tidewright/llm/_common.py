"""Helpers shared by the training-data operators: shared-folder tables, worker caches, Arrow plumbing."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); where it is unset, a temporary one for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append(tempfile.mkdtemp(prefix="tidewright-"))
        base = _OWN_FOLDER[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tidewright/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut where every executor can read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: what was made of them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def neutral(df: DataFrame) -> tuple[DataFrame, list]:
    """``df`` with columns c0, c1, ... and the columns that restore its names: extra columns can't clash with an operator's own."""
    from_ = [df[f"`{c.replace('`', '``')}`"].alias(f"c{i}") for i, c in enumerate(df.columns)]
    return df.select(*from_), [F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]


def worker_cache(name: str, owner: str | None = None) -> dict:
    """A dict that outlives a task: reused Python workers keep it between tasks.

    Caches with an owner are dropped as soon as another operator's task runs in the worker (it names itself as the owner), so
    a pipeline's stages don't pile up their caches.
    """
    holder = sys.modules.setdefault("_tidewright_worker_cache", types.ModuleType("_tidewright_worker_cache")).__dict__
    if owner is not None and holder.get("owner") != owner:
        if holder.pop("owned", None):
            give_back()
        holder["owner"], holder["owned"] = owner, {}
    return (holder if owner is None else holder["owned"]).setdefault(name, {})


def give_back() -> None:
    """Return freed memory to the system: allocators keep it otherwise, and an executor's limit counts it."""
    import ctypes
    import gc

    holder = sys.modules.get("_tidewright_worker_cache")
    if holder is not None:
        holder.__dict__.pop("powers", None)  # tables as long as the longest text; quickly made again
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 2 << 20, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of ``column`` in one piece hold about ``max_bytes`` (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(lengths):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def text_buffer(column: pa.Array):
    """UTF-8 bytes of a string column, end to end, and the offsets of its rows; null counts as empty."""
    import numpy as np

    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
