"""Order, batches, shards, samples and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.storage import staged


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "rn") -> DataFrame:
    """df with 0, 1, 2, ... in an order, within by if given.

    Over all rows, places are the sum of the counts of the partitions before and the place inside a sorted partition; no
    task holds all rows. Which row is in which partition, and where, is written down once with the rows: a plan that is
    evaluated twice may cut its partitions in two ways. by is for groups of a size that one task can sort.
    """
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    placed = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # the number of the partition stands in the upper bits, the place inside it in the lower 33
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_inside", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each partition
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).drop("_n")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_at", "_part", "_start", "_inside")


def length_batches(df: DataFrame, length: str, ordinal: str, batch_size: int, shard_size: int) -> DataFrame:
    """df with batch and shard, in the order of length; rows of equal length keep their order."""
    placed = numbered(df, [length, ordinal])
    return placed.withColumn("batch", F.floor(F.col("rn") / batch_size).cast("long")).withColumn("shard", F.floor(F.col("rn") / shard_size).cast("long"))


def whole_batches(df: DataFrame, batch: str, size: int) -> DataFrame:
    """Rows of batches that are full."""
    return df.join(df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size).select(batch), batch, "left_semi")


def shard_order(df: DataFrame, shard: str, idx: str, seed: int, epoch: int) -> DataFrame:
    """df with position: shards in a seeded order, rows of a shard in their own."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), F.col(shard).cast("string")))
    return numbered(df.withColumn("_key", key), ["_key", shard, idx], name="position").drop("_key")


def first_rows(df: DataFrame, n: int | None, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first n rows in an order, of each group if by is given; None is all."""
    if n is None:
        return df
    if not by:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def hash_sample(df: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """An exact share of the rows, one at least, by a seeded hash of their key."""
    n = df.count()
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key).limit(min(n, max(1, int(n * fraction))))


def missing(wanted: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(saved.select(key), key, "left_anti")


def last_written(log: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """For each key the value written last; blank ones don't count."""
    filled = log.where(F.trim(F.coalesce(value, F.lit(""))) != "")
    return filled.groupBy(key).agg(F.max_by(value, position).alias(value))


def after_first(df: DataFrame, done: int, order: list[str]) -> DataFrame:
    """What a run has still to write that has written the first done rows in an order."""
    return numbered(df, order, name="_place").where(F.col("_place") >= done).drop("_place") if done else df


def restored(wanted: DataFrame, saved: DataFrame, key: str, value: str) -> DataFrame:
    """wanted with saved values, empty where there is none."""
    return wanted.join(saved.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit("")))


def replicated(df: DataFrame, n: int, name: str = "copy") -> DataFrame:
    """Each row n times, numbered from 0."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def paraphrase_union(originals: DataFrame, paraphrases: DataFrame) -> DataFrame:
    """Originals, then the first paraphrase of each, then the second: ordered by (pass, idx). originals: (idx, prompt); paraphrases: (idx, pass, prompt)."""
    base = originals.select("idx", F.lit(-1).alias("pass"), "prompt", F.lit(False).alias("is_paraphrase"))
    return base.unionByName(paraphrases.select("idx", "pass", "prompt", F.lit(True).alias("is_paraphrase")))


def span_stage(length: Column, n: int) -> Column:
    """How many of the last n places there are."""
    return F.least(length, F.lit(n))
