"""Tables written to the folder that driver and executors share.

Operators cut lineage by writing an intermediate table there and reading it
back: a lost executor then costs a re-read, never a recomputation of the whole
history.  The folder is the one named by ``spark.checkpoint.dir``; a session on a
local master that names none (tests) gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only if it is unset and the master is local."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{_KEY} must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="strideline-")
    spark.conf.set(_KEY, folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back with its schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strideline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``stored`` that no later result reads."""
    path = getattr(df, "_strideline_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of the batches that pass between Spark and its Python workers; each task holds a few of them on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for the rest of the session, unless it has smaller ones: texts are long, and 10,000 of them are no small batch."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in small batches; a worker gives memory that it no longer uses back to the system when a task ends.

    Workers live on in later stages, and so would what their allocators keep.
    """
    small_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = _trim()
            if trim is not None:
                trim(0)

    return df.mapInArrow(lean, schema)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for temporaries that clash with none of ``df``, whatever case it uses."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out
