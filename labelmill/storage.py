"""Intermediate tables in a folder that the driver and all executors share, and small files on any file system."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: While this is set, Spark removes the shuffle files of a query when it has ended. Once the result of a plan is written
#: nothing needs them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the session's checkpoint folder. Only on one machine, as in tests, may both be unset: then it is a folder under the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = there.get() if there.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


#: How many writes of any thread want CLEANUP just now, and what it was before the first of them, for each session.
_writing: dict[int, list] = {}
_lock = threading.Lock()


@contextmanager
def _cleaning_up(spark: SparkSession) -> Iterator[None]:
    """CLEANUP is on as long as one thread is inside, and then as it was."""
    key = id(spark._jsparkSession)
    with _lock:
        held = _writing.setdefault(key, [0, spark.conf.get(CLEANUP, None)])
        held[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                del _writing[key]
                spark.conf.unset(CLEANUP) if held[1] is None else spark.conf.set(CLEANUP, held[1])


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/labelmill"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends at files that outlive any executor, and what isn't determined by the plan alone is settled once."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning_up(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if (inside := _open.get()) is not None:
        inside.append(out)
    return out


#: Tables staged inside the innermost scratch() of this thread or context.
_open: ContextVar[list[DataFrame] | None] = ContextVar("staged inside", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes, at its end, the tables that were staged inside by the same thread, but for those given to the function it yields: what a result reads must be kept. A scratch() around it removes these in turn, unless it keeps them too."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    around = _open.get()
    _open.set(made)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _open.set(around)
        paths = {t.staged_at for t in kept}
        unstaged(*(t for t in made if t.staged_at not in paths))
        if around is not None:
            around.extend(kept)


def released(result: DataFrame) -> int:
    """Removes the staged tables that a result reads, once it has been written or isn't wanted any more, and returns how many there were. The result can't be evaluated again."""
    spark = result.sparkSession
    top = whole_path(spark, _folder(spark)).rstrip("/") + "/"
    tables = {f"{top}{rest.split('/')[0]}" for f in result.inputFiles() for rest in [whole_path(spark, f).removeprefix(top)] if whole_path(spark, f).startswith(top)}
    for path in tables:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
    return len(tables)


def unstaged(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing reads any more."""
    for df in tables:
        fs, path = _file_system(df.sparkSession, df.staged_at)
        fs.delete(path, True)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Tables up to this size, a quarter of what Spark reads in one task, are spread.
SPREAD_BYTES = 32 << 20


def spread(table: DataFrame) -> DataFrame:
    """A small table dealt to all cores, at a MB or more for each: read from one file with one row group it would be the work of one core. A larger one, or one of more files, stays as it is."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(table.sparkSession.sparkContext.defaultParallelism, size >> 20)
    return table.repartition(n) if n > 1 and size <= SPREAD_BYTES and len(table.inputFiles()) < n else table


def whole_path(spark: SparkSession, path: str) -> str:
    """path with its file system, as Spark names the files that it reads."""
    fs, p = _file_system(spark, path)
    return fs.makeQualified(p).toString()


def write_text(spark: SparkSession, path: str, parts: Iterable[str], block: int = 1 << 20) -> None:
    """One file on any file system, of parts that needn't be held together; it appears only when all is written."""
    fs, target = _file_system(spark, path)
    _, tmp = _file_system(spark, f"{path}.tmp")
    out = fs.create(tmp, True)
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= block:
            out.write("".join(held).encode())
            held, size = [], 0
    out.write("".join(held).encode())
    out.close()
    fs.delete(target, False)
    if not fs.rename(tmp, target):
        raise OSError(f"{path} can't be written")
