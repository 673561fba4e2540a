"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only if its measured size is at most this.
BROADCAST_BYTES = 32 << 20

#: Bytes of rows that a Python worker is sent at once, or one row.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of our own where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors.

    Its files stay until ``discard`` is called with it, or ``discard_all`` with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tidewell_path = path
    _written(spark).add(path)
    return out


def _written(spark: SparkSession) -> set[str]:
    """Folders that ``materialise`` has written in this session and that were not deleted."""
    context = spark.sparkContext
    if not hasattr(context, "_tidewell_written"):
        context._tidewell_written = set()
    return context._tidewell_written


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` has returned; no plan that reads them may run afterwards."""
    for df in tables:
        _delete(df.sparkSession, df.tidewell_path)
        _written(df.sparkSession).discard(df.tidewell_path)


def discard_all(spark: SparkSession) -> None:
    """Delete all that this session's operators have written in between; for use once their results are stored."""
    for path in list(_written(spark)):
        _delete(spark, path)
        _written(spark).discard(path)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where ``rows`` counted rows of ``row_bytes`` stay under the bound; else the planner decides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session, so functions that need it can be loaded there.

    Rows go to them in batches of ``BATCH_BYTES``, or one row: by Spark's own bounds, 10,000 rows of long texts and 64 MB,
    each of an executor's tasks would hold a multiple of that, in the JVM and in Python.
    """
    sc = spark.sparkContext
    if _bytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if getattr(sc, "_tidewell_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidewell-"), "tidewell_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._tidewell_shipped = True


def _bytes(value: str) -> int:
    """A size such as ``64MB``, ``4m`` or ``67108864b`` in bytes."""
    number = value.rstrip("bBkKmMgGiI ")
    return int(number) << {"k": 10, "m": 20, "g": 30}.get(value[len(number) :].strip()[:1].lower(), 0)


_held: dict = {}


def held(key, make: Callable):
    """What ``make`` gives, kept for later calls with ``key``; a process keeps one such thing, whatever operators it serves."""
    if key not in _held:
        _held.clear()
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give memory that a finished task's arrays and strings have freed back to the system; workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Have every executor's JVM collect its garbage, and so give back what its heap has grown by.

    A heap that a shuffle has grown to its bound stays there, full of garbage, beside the Python workers of later jobs.
    The executors must be idle, so that each gets its share of one task a core.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``most`` at most, or of one row."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, end
        start = end


def map_texts(df: DataFrame, columns: list[str], compute: Callable[[list[str | None]], list[pa.Array]], schema: str, most: int) -> DataFrame:
    """``columns`` of ``df``, then the arrays that ``compute`` makes of its ``text`` column.

    Texts reach ``compute`` in groups of at most ``most`` bytes, or one text, and each group's rows leave at once, so a
    worker holds one Arrow batch and one group, however long texts are.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, texts = batch.columns
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
            for start, end in chunks(sizes, most):
                made = compute(texts.slice(start, end - start).to_pylist())
                arrays = [c.slice(start, end - start) for c in others] + made
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        release()

    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
