"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where
    the session has none it is a temporary folder of a local master, and a
    folder of the warehouse otherwise."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(set_dir)
        return set_dir.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        current = tempfile.mkdtemp(prefix="strataframe-ckpt-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


#: Stage tables that this thread has written, in order; other threads' tables are never dropped.
_written = threading.local()


def _stages() -> list[str]:
    if not hasattr(_written, "paths"):
        _written.paths = []
    return _written.paths


def _hadoop_path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files go with ``drop_stages``, at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(at)
    _stages().append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_mark() -> int:
    """A mark for ``drop_stages``: how many stage tables this thread has written."""
    return len(_stages())


def drop_stages(spark: SparkSession, since: int, upto: int) -> None:
    """Delete the stage tables written between two marks, once nothing reads them any more."""
    for path in _stages()[since:upto]:
        at, fs = _hadoop_path(spark, path)
        fs.delete(at, True)


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ..: helper columns then clash with none."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def release_memory() -> None:
    """Give freed memory back at the end of a task; a reused worker would keep it otherwise."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffer(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of a whole string column and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    if len(col) == 0:
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    body = b"" if data is None else data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes()
    return body, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 1 << 20):
    """Parts of a batch of at most ``rows`` rows and ``size`` bytes of one column (a longer text comes alone)."""
    col = batch.column(column)
    size_of = pc.list_value_length if pa.types.is_list(col.type) else pc.binary_length
    n = pc.fill_null(size_of(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    lo = 0
    while lo < batch.num_rows:
        used = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, used + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def ascii_lower(data: bytes) -> bytes:
    """Lower-case A-Z only; never touches multi-byte sequences."""
    return data.translate(_LOWER)


def id_crc_mod(doc_id: F.Column | str, m: int):
    """crc32(doc_id as text) mod m."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % m
