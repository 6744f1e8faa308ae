"""Traces as a stream: smoothed rewards kept up to date as files arrive, folded in the order of steps."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelmill.operators.tracker import ALPHA
from labelmill.storage import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The step of the row that closes a stream: all before it are then complete. Its record id is empty.
CLOSING = 9 * 10**12
#: Groups of records whose complete steps are folded together, those of one group and batch at a time in a task. What a stream has in its checkpoint is kept by them.
SHARDS = 1024


class InOrderOfSteps(StatefulProcessor):
    """Folds the complete steps of the records of a shard into their averages.

    All complete steps of a batch come together, and those of later batches are later ones, so they are put in order
    here and folded at once. The state of a record is two numbers, read and written once for each batch that it is in.
    """

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.folded = handle.getMapState("folded", "record_id string", "ema double, cnt long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True)
        which, records = pd.factorize(table["record_id"])
        order = np.lexsort((table["step"], which))
        ends = np.cumsum(np.bincount(which))
        steps, values, counts = (table[c].to_numpy()[order].tolist() for c in ("step", "value", "counts"))
        out = []
        for record, lo, hi in zip(records, [0, *ends[:-1]], ends, strict=True):
            ema, cnt = self.folded.getValue((record,)) or (None, 0)
            for value, counted in zip(values[lo:hi], counts[lo:hi], strict=True):
                if counted:
                    ema = value if ema is None else self.alpha * value + (1 - self.alpha) * ema
                    cnt += 1
            if cnt:
                self.folded.updateValue((record,), (ema, cnt))
                out.append((record, ema, cnt, steps[hi - 1]))
        if out:
            yield pd.DataFrame(out, columns=["record_id", "ema", "cnt", "step"])

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """State with maps needs this store. It is set where the session has none of its own choice, for as long as a query is started."""
    with _lock:
        before = spark.conf.get(STORE)
        spark.conf.set(STORE, ROCKS)
        try:
            yield
        finally:
            spark.conf.set(STORE, before)


_lock = threading.Lock()


def smoothed_stream(traces: DataFrame, alpha: float = ALPHA, late_steps: int = 0, skip_all_zero: bool = True) -> DataFrame:
    """(record_id, ema, cnt, step) of each record whenever one of its steps is complete: its smoothed reward up to that step. traces: a stream of (step, record_id, reward).

    A step is complete once a batch has brought a step more than late_steps after it, in any record; until then its rows
    may come in any order, and over several batches. Rows that come later still are too late: Spark counts them as dropped
    by the watermark, so late_steps must be what the writers can differ by. Steps, from 0, are taken as milliseconds of event time (plus 1: a watermark begins at 0, and what isn't after it counts as late);
    rows without step, record or reward are left out. A row at CLOSING, with an empty record id, completes all steps.
    """
    rows = traces.where("step IS NOT NULL AND record_id IS NOT NULL AND reward IS NOT NULL")
    timed = rows.withColumn("at", F.timestamp_millis(F.col("step") + 1)).withWatermark("at", f"{late_steps + 1} milliseconds")
    # rows of a step are added up as they come; a step leaves this state once, when it is complete
    counts = F.lit(not skip_all_zero) | ~F.bool_and(F.col("reward") == 0)
    complete = timed.groupBy("at", "record_id").agg(F.avg(F.col("reward").cast("double")).alias("value"), counts.alias("counts"))
    steps = complete.select(F.pmod(F.hash("record_id"), F.lit(SHARDS)).alias("shard"), "record_id", (F.unix_millis("at") - 1).alias("step"), "value", "counts")
    out = steps.groupBy("shard").transformWithStateInPandas(InOrderOfSteps(alpha), "record_id string, ema double, cnt long, step long", "Append", "None")
    # not before: Spark would take the closing row away ahead of the watermark
    return out.where("record_id <> ''")


def trace_stream(spark: SparkSession, folder: str, fields: str = "step bigint, record_id string, reward double", files_per_batch: int = 100) -> DataFrame:
    """A stream of JSON lines that arrive in a folder."""
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch).json(folder)


def run_until_read(stream: DataFrame, folder: str) -> None:
    """Reads all that is there, keeps each batch's rows in folder with its number, and stops. A batch that is done again after a failure replaces its rows."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with _rocks(stream.sparkSession):
        query = stream.writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        # the settings of the session are taken over when the first batch is planned
        query.awaitTermination()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, ema, cnt): the last state of each record in the rows that run_until_read kept."""
    rows = spark.read.option("basePath", f"{folder}/rows").schema("record_id string, ema double, cnt long, step long, batch long").parquet(f"{folder}/rows")
    return rows.groupBy("record_id").agg(F.max_by("ema", "cnt").alias("ema"), F.max("cnt").alias("cnt"))


def replay_stream(traces: DataFrame, alpha: float = ALPHA, files: int | None = None) -> DataFrame:
    """(record_id, ema, cnt) of traces that go through the stream: written to the shared folder, read as a stream file by file or all at once, and the last state of each record taken.

    The files have no order of steps, so as many steps as there are may be late; a closing row completes them. With files, they are read in so many batches.
    """
    spark = traces.sparkSession
    folder = f"{shared_folder(spark)}/labelmill/stream-{uuid.uuid4().hex}"
    rows = traces.select("step", "record_id", "reward")
    (rows if files is None else rows.repartition(files)).write.parquet(f"{folder}/traces")
    spread = spark.read.schema(rows.schema).parquet(f"{folder}/traces").agg(F.coalesce(F.max("step") - F.min("step"), F.lit(0)).cast("long")).first()[0]
    stream = spark.readStream.schema(rows.schema)
    stream = stream if files is None else stream.option("maxFilesPerTrigger", 1)
    source = smoothed_stream(stream.parquet(f"{folder}/traces"), alpha, late_steps=spread + 1)
    if files is not None:
        # the closing row comes when all files are read
        run_until_read(source, folder)
    spark.createDataFrame([(CLOSING, "", 0.0)], rows.schema).write.mode("append").parquet(f"{folder}/traces")
    run_until_read(source, folder)
    return latest(spark, folder)
