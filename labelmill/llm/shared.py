"""What the operators share: intermediate tables where all executors can read them, values sent to executors, folds."""

from __future__ import annotations

import ctypes
import inspect
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.storage import scratch, shared_folder, staged, unstaged

__all__ = ["bounded_batches", "crc_fold", "fits_broadcast", "given_back", "received", "scratch", "sent", "shared_folder", "staged", "tidy", "unstaged"]


def crc_fold(doc_id, n: int):
    """crc32 of the id as text, modulo n: which fold a row is in."""
    return F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(n))


def sent(spark: SparkSession, value) -> Broadcast:
    """A broadcast of a value of this package's classes, which travel with it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast):
    """The value, in a worker. The bytes that it came as aren't kept beside it."""
    value = pickle.loads(broadcast.value)
    if TaskContext.get() is not None:
        vars(broadcast).pop("_value", None)
    return value


def given_back() -> None:
    """Returns free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run, the function of a Python stage, after which a worker gives free memory back: workers are used again by other stages, beside others of their own."""

    def batches(rows: Iterator) -> Iterator:
        try:
            yield from run(rows)
        finally:
            given_back()

    def tables(*groups: pa.Table) -> pa.Table:
        try:
            return run(*groups)
        finally:
            given_back()

    return batches if inspect.isgeneratorfunction(run) else (lambda a, b: tables(a, b)) if len(inspect.signature(run).parameters) == 2 else (lambda a: tables(a))


#: Bytes of an Arrow batch.
BATCH_BYTES = 1 << 23


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts make large rows, so batches are bounded by bytes. Spark takes that from the session alone, when a plan is run; where the session has a bound of its own, that stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


#: Tables are broadcast only up to this many bytes, counted on what is sent.
BROADCAST_BYTES = 32 << 20


def fits_broadcast(table: DataFrame, *columns: Column | str) -> bool:
    """Whether a staged table is small enough to be sent to all executors, by its rows and the bytes of its columns, written as text."""
    sizes = sum((F.coalesce(F.octet_length((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(sizes), F.lit(0))).first()
    return 32 * rows + size <= BROADCAST_BYTES
