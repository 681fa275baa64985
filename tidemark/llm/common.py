"""What the training-data operators share: written tables in the shared folder, row keys and digests."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column, so that columns of the input never clash with them.
P = "__tm_"

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, and only on a local master, an own folder is made.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is read by columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Deletes every table that written() made. Results that still read them must have been stored before."""
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone at exit
            if path.startswith("file://") and os.path.isdir(path[7:]):
                import shutil

                shutil.rmtree(path[7:], ignore_errors=True)


atexit.register(release)


def tasks(spark: SparkSession) -> int:
    """Tasks for a CPU-heavy step over a written table, whose few files would else make few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


_settled = False


def settle() -> None:
    """For Python workers, at the start of a task: memory that earlier tasks have freed is given back, and what is
    loaded by the first one stays, so the garbage collection that Spark runs after every task needn't look at it
    again, which would take longer than many a task."""
    global _settled
    if not _settled:
        gc.collect()
        gc.freeze()
        _settled = True
    pa.default_memory_pool().release_unused()
    if trim := _libc_trim():
        trim(0)


@functools.cache
def _libc_trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def bit(n: Column) -> Column:
    """A long with bit n set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def bucket(n: int, *by: Column) -> Column:
    """0 to n - 1 by a hash of by."""
    return F.pmod(F.xxhash64(*by), F.lit(n).cast("long")).cast("int")
