"""Shared folder, written tables and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch at most: rows may be long.
BATCH_ROWS = 1000
#: Bytes of text that a numpy pass takes at once; a longer text makes a pass of its own.
SLICE_BYTES = 1 << 20

#: Rows in a file of a table of which the size is known.
FILE_ROWS = 50_000

_own: dict[str, str] = {}  # by application
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all runs on this machine, as in tests, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _own.get(spark.sparkContext.applicationId)
        if not found:
            found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    _written.append(path)
    return path


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors lose nothing.

    rows: how many there are, about, where that is known; small tables then come in few files, whatever the number of partitions.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def unwrite(*tables: DataFrame) -> None:
    """Remove tables that written() gave and nothing reads any more, and the shuffle files of steps that are done."""
    for t in tables:
        delete(t.sparkSession, t._scratch)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove scratch folders that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _written:
            _written.remove(p)


def made() -> list[str]:
    """Scratch folders that are still there."""
    return list(_written)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for rows of any usual length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of all rows, and where each begins (one offset more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes together."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def open_file(path: str, write: bool = False):
    """A stream of a file in any store that pyarrow knows by its address."""
    store, at = _place(path)
    if write:
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at, compression=None)
    return store.open_input_stream(at, compression=None, buffer_size=1 << 20)


def open_random(path: str):
    """A file that can be read at any place."""
    store, at = _place(path)
    return store.open_input_file(at)
