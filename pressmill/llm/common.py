"""Shared plumbing of the training-data operators: tables, the shared folder, prefix offsets."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes that a writer holds before it writes them: small, as executors also run Python.
ROW_GROUP = 16 << 20
#: Subfolder of what is materialized, for a caller that deletes it.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized within is deleted at the end; results must be written before."""
    token = _SCRATCH.set(f"scratch-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        _delete(spark, f"{shared_dir(spark)}/pressmill/{_SCRATCH.get()}")
        _SCRATCH.reset(token)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    Cuts the lineage like a reliable checkpoint, but columnar and compressed; the files
    outlive any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/pressmill/{_SCRATCH.get()}{label}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pressmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    path = getattr(df, "_pressmill_path", None)
    if path:
        _delete(df.sparkSession, path)


def handing_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``. Python workers stay for later tasks, whatever these need: what ``run`` has freed goes back to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)

    return whole


def offsets(cells: DataFrame, order: list[str], size: str, name: str, within: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the cells before, in ``order``.

    ``cells`` is a summary whose row count is bounded by a parameter, not by the data.
    """
    w = Window.partitionBy(*(within or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))
