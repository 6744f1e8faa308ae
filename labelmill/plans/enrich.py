"""Enrichment by an external model, in chunks that can be taken up again."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.batches import last_written, missing, restored

Client = Callable[[list[str]], list[str | None]]


class CircuitOpen(RuntimeError):
    """Too many failures in a row."""


class Breaker:
    """Counts failures in a row; a success starts anew, a limit of 0 never opens. One for each task; enriched_to counts over all tasks."""

    def __init__(self, limit: int = 30):
        self.limit, self.failures = limit, 0

    def record(self, ok: bool) -> None:
        self.failures = 0 if ok else self.failures + 1
        if self.limit and self.failures >= self.limit:
            raise CircuitOpen(f"{self.failures} failures in a row")


def retried(call: Callable, tries: int, base_seconds: float = 1.0, parse: Callable = lambda x: x, sleep: Callable = time.sleep, jitter: float = 0.0):
    """parse(call()), tried again with doubled waits, each longer by a random share of jitter; an answer that doesn't parse uses up a try. None when all failed."""
    for k in range(tries):
        try:
            return parse(call())
        except Exception:
            if k + 1 < tries:
                sleep(base_seconds * 2**k * (1 + jitter * random.random()))
    return None


def enriched(rows: DataFrame, key: str, request: str, client: Client, out: str, batch_size: int = 256, breaker: int = 30, tries: int = 1, base_seconds: float = 1.0, jitter: float = 0.0, at_once: int = 1, parse: Callable[[str], str | None] | None = None) -> DataFrame:
    """(key, out): the client's answer to each request; null where it failed.

    The client is called with batches, in each task at_once of them at a time. What fails as a whole, what it gives no
    answer to and what doesn't parse is asked for again, tries times in all, after doubled waits.
    """

    def asked(requests: list[str]) -> list[str | None]:
        answers: list[str | None] = [None] * len(requests)
        counted = True

        def once() -> None:
            nonlocal counted
            left = [i for i, a in enumerate(answers) if a is None]
            got = client([requests[i] for i in left])
            counted = len(got) == len(left)
            for i, a in zip(left, got):
                try:
                    answers[i] = parse(a) if parse and a is not None else a
                except Exception:
                    answers[i] = None
            if any(a is None for a in answers) and counted:
                raise LookupError("some requests have no answer")

        retried(once, tries, base_seconds, jitter=jitter)
        if not counted:
            raise ValueError("the client gave another number of answers")
        return answers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fuse = Breaker(breaker)
        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                parts = [batch.slice(lo, batch_size) for lo in range(0, batch.num_rows, batch_size)]
                # no more than at_once calls are ahead of what has been given on
                for lo in range(0, len(parts), at_once):
                    now = parts[lo : lo + at_once]
                    for part, answers in zip(now, pool.map(asked, [p.column(1).to_pylist() for p in now]), strict=True):
                        for x in answers:
                            fuse.record(x is not None)
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string())], names=[key, out])

    return rows.select(key, request).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out} string")


@dataclass(frozen=True)
class FailureRuns:
    """Successes and failures in a row, as far as a run of failures can be told from them: all, failures at the beginning and at the end, the longest run."""

    total: int = 0
    leading: int = 0
    trailing: int = 0
    longest: int = 0

    @classmethod
    def of(cls, answers: list[bool]) -> FailureRuns:
        out = cls()
        for ok in answers:
            out = out.then(cls(1, 0, 0, 0) if ok else cls(1, 1, 1, 1))
        return out

    def then(self, more: FailureRuns) -> FailureRuns:
        leading = self.total + more.leading if self.leading == self.total else self.leading
        trailing = self.trailing + more.total if more.trailing == more.total else more.trailing
        return FailureRuns(self.total + more.total, leading, trailing, max(self.longest, more.longest, self.trailing + more.leading))


class _Joined(AccumulatorParam):
    """The driver joins what tasks tell, in the order in which they end, and says when the limit is reached."""

    def zero(self, value: FailureRuns) -> FailureRuns:
        return FailureRuns()

    def addInPlace(self, value1: FailureRuns, value2: FailureRuns) -> FailureRuns:
        return value1.then(value2)


def enriched_to(rows: DataFrame, key: str, request: str, client: Client, out: str, folder: str, limit: int = 30, task_rows: int = 256, **how) -> DataFrame:
    """Appends (key, out) of all rows to a folder of Parquet and returns what is there. limit failures in a row, over all tasks, stop the job with CircuitOpen, and then nothing of it is seen.

    Tasks are of task_rows requests at most. Each tells the driver its runs of failures when it ends; the driver joins them,
    and cancels the job by its tag as soon as a run is long enough, wherever its failures were.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    told = context.accumulator(FailureRuns(), _Joined())
    tasks = max(1, -(-rows.count() // task_rows))
    answers = enriched(rows.repartition(tasks), key, request, client, out, breaker=limit, **how)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = FailureRuns()
        for batch in batches:
            runs = runs.then(FailureRuns.of([x.is_valid for x in batch.column(1)]))
            yield batch
        told.add(runs)

    tag, ended = f"enriched-{uuid.uuid4().hex}", threading.Event()

    def watched() -> None:
        while not ended.wait(0.05):
            if told.value.longest >= limit:
                context.cancelJobsWithTag(tag)
                return

    watcher = threading.Thread(target=watched, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        answers.mapInArrow(counted, answers.schema).write.mode("append").parquet(folder)
    except Exception as e:
        if told.value.longest >= limit or "CircuitOpen" in str(e):
            raise CircuitOpen(f"{max(limit, told.value.longest)} failures in a row over all tasks") from e
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
    return spark.read.schema(answers.schema).parquet(folder)


def enriched_with_checkpoint(rows: DataFrame, key: str, request: str, client: Client, out: str, folder: str, **how) -> DataFrame:
    """rows with out. What the folder has is not asked for again; failed or blank answers aren't saved, so the next run asks again. Keyed by key, not by place."""
    from labelmill.sources.readers import exists

    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()

    def saved() -> DataFrame:
        log = spark.read.parquet(folder) if exists(spark, folder) else spark.createDataFrame([], f"{key} {kind}, {out} string, written double")
        return last_written(log, key, out, "written")

    rest = missing(rows, saved(), key)
    answers = enriched(rest, key, request, client, out, **how).where(F.trim(F.coalesce(out, F.lit(""))) != "")
    answers.withColumn("written", F.lit(time.time())).write.mode("append").parquet(folder)
    return restored(rows, saved(), key, out)


def within_tokens(rows: DataFrame, text: str, count_tokens: Callable[[list[str]], list[int]] | None, most: int = 1024) -> DataFrame:
    """Rows whose text has at most so many tokens; all rows where the backend can't count."""
    if count_tokens is None:
        return rows
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens([x or "" for x in batch.column(at).to_pylist()]) if batch.num_rows else []
            yield batch.filter(pa.array([n <= most for n in counts], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
