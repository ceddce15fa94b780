"""Tables in the folder that the cluster shares, where long plans are cut, and bounds of what tasks hold."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of an Arrow batch sent to a Python worker. One row may exceed the bytes; a batch of many may not.
BATCH_ROWS = 1024
BATCH_BYTES = 2 << 20
#: Rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker receives at once, so that long texts cannot pile up in one batch.

    The session's bounds are lowered to these and stay so, as plans read them when they run; lower ones are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def thrifty(made: Callable) -> Callable:
    """A function for ``mapInArrow`` whose worker, which later tasks use again, returns the memory of a task at its end."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        yield from made(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:  # glibc keeps freed memory otherwise
            trim(0)

    return run


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder on whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def few(rows: DataFrame) -> DataFrame:
    """A short table marked for broadcast, which one over ``BROADCAST_ROWS`` is not."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``: Spark's own subfolder of it, once set.

    Where none is named, a local master, which is one machine, gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="versicle-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from shared, replicated storage: lineage ends here and lost executors cost nothing upstream."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _without_shuffles(df: DataFrame, run: Callable):
    """What ``run`` makes of the rows, whose shuffles are then removed where Spark can; else they stay until the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP, None)
    conf.set(_CLEAN_UP, "true")
    try:
        return run(df.select("*"))  # a new plan, which reads the setting
    finally:
        conf.unset(_CLEAN_UP) if before is None else conf.set(_CLEAN_UP, before)


def settled(df: DataFrame) -> DataFrame:
    """``cut``, and the shuffles that made the rows are removed."""
    return _without_shuffles(df, cut)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The same rows as a Parquet table in the shared folder, for what is read many times by few columns, and its folder, which the caller drops."""
    at = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _without_shuffles(df, lambda rows: rows.write.option("compression", "zstd").parquet(at))
    return df.sparkSession.read.parquet(at), at
