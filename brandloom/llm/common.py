"""Helpers shared by the corpus operators: staging, columns, Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from brandloom.session import ship

#: Rows in one Arrow batch that a Python operator sees; with MAX_BYTES it
#: bounds a Python worker's memory whatever the partition's size.
MAX_ROWS = 1000
MAX_BYTES = 4 << 20

_scratch: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches handed to Python workers, and ship the package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MAX_BYTES))
    return ship(spark)


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in the shared place of spark.checkpoint.dir.

    Where the setting is missing, a local session gets a temporary folder; a
    cluster session is refused, since its executors share no local folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="brandloom-")
        _scratch[app] = f"{base.rstrip('/')}/brandloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may have ended before the interpreter
        return


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage, survives lost executors, and makes the result of
    order-dependent Python code final before anything joins it twice.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again; what came of them has to be staged by then."""
    for df in staged:
        _remove(df.sparkSession, df.staged_at)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_kept: dict[object, object] = {}


def keep(key: object, make: Callable[[], object]) -> object:
    """What `make` gives, built once in each Python worker, which keeps one such thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of it, and give free memory back: a worker serves the tasks of one operator after another's."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one string array in which null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = MAX_BYTES):
    """Parts of a batch with about `most` bytes of one column's text each."""
    texts = texts_of(batch.column(column))
    _, offsets = raw(texts)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, end - start), texts.slice(start, end - start)
        start = end
