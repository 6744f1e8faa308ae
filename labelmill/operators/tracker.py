"""Smoothed rewards of records, and what is sampled by them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.storage import staged, unstaged

#: Weights that are searched at once when drawing: 2 ** 17.
CHUNK_BITS = 17
ALPHA, EPSILON, MAX_WEIGHT = 0.3, 0.1, 5.0


def smoothed(values: Column, alpha: float = ALPHA, start: Column | None = None) -> Column:
    """The exponential average of an array in its order; the first value, or start, is taken as it is."""
    first = F.get(values, F.lit(0)) if start is None else F.coalesce(start, F.get(values, F.lit(0)))
    rest = F.when(F.lit(start is not None) & (start.isNotNull() if start is not None else F.lit(False)), values).otherwise(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))))
    return F.aggregate(rest, first, lambda acc, x: F.lit(alpha) * x + F.lit(1.0 - alpha) * acc)


def updates(traces: DataFrame, skip_all_zero: bool = True) -> DataFrame:
    """(step, record_id, value): the mean reward of each record at each step, without groups that are all zero. judge_error isn't looked at."""
    groups = traces.groupBy("step", "record_id").agg(F.avg("reward").alias("value"), F.bool_and(F.col("reward") == 0).alias("zero"))
    return (groups.where(~F.col("zero")) if skip_all_zero else groups).select("step", "record_id", "value")


def replayed(traces: DataFrame, alpha: float = ALPHA, skip_all_zero: bool = True, state: DataFrame | None = None) -> DataFrame:
    """(record_id, ema, cnt): traces folded in the order of steps, upon an earlier state if there is one.

    An average needs all values of a record in order, so they are gathered; these are one number for each step in which
    the record came up.
    """
    by_record = updates(traces, skip_all_zero).groupBy("record_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "value"))), lambda x: x["value"]).alias("seen"))
    if state is None:
        return by_record.select("record_id", smoothed(F.col("seen"), alpha).alias("ema"), F.size("seen").cast("long").alias("cnt"))
    joined = by_record.join(state, "record_id", "full_outer")
    none = F.expr("cast(array() as array<double>)")
    seen = F.coalesce("seen", none)
    return joined.select("record_id", smoothed(seen, alpha, F.col("ema")).alias("ema"), (F.coalesce("cnt", F.lit(0)) + F.size(seen)).cast("long").alias("cnt"))


def weight(mean_reward: Column, epsilon: float = EPSILON, most: float = MAX_WEIGHT, default: float = 0.8) -> Column:
    """1 / (reward + epsilon), at most so much; rewards under 0 count as 0, a missing one is the default."""
    return F.least(1.0 / (F.greatest(F.coalesce(mean_reward, F.lit(default)), F.lit(0.0)) + epsilon), F.lit(most))


def sampling_weights(ids: DataFrame, tracker: DataFrame, epsilon: float = EPSILON, most: float = MAX_WEIGHT, default: float = 0.8) -> DataFrame:
    """ids with weight."""
    joined = ids.join(tracker.select("record_id", "ema"), "record_id", "left")
    return joined.withColumn("weight", weight(F.col("ema"), epsilon, most, default)).drop("ema")


#: Ranges that values are counted in at once.
RANGES = 4096


def exact_percentiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Percentiles of a column, linear between ranks; None without values. Null counts as no value.

    A value of a rank is found by counting: all values in RANGES ranges, then those of the range that holds the rank again,
    until a range has one value. Each pass is one aggregation; no task, nor the driver, ever sees more than ranges.
    """
    values = staged(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), "values")
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        unstaged(values)
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    wanted = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found: dict[int, float] = {}
    # (least value, greatest value): how many values are smaller, and the ranks looked for inside
    open_ = {(low, high): (0, wanted)}
    while open_:
        for (lo, hi), (_, ranks) in list(open_.items()):
            if lo == hi:
                found |= dict.fromkeys(ranks, lo)
                del open_[lo, hi]
        if not open_:
            break
        spans = list(open_)
        which, part = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (lo, hi) in enumerate(spans):
            inside = F.col("v").between(lo, hi)
            # halves first: the difference of two values may be too large for a double
            share = (F.col("v") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
            which, part = F.when(inside, F.lit(k)).otherwise(which), F.when(inside, F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).otherwise(part)
        counted = values.select("v", which.alias("span"), part.alias("part")).where("span IS NOT NULL").groupBy("span", "part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows_ = sorted(tuple(r) for r in counted.collect())
        following: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for k, span in enumerate(spans):
            before, ranks = open_[span]
            for _, _, m, lo, hi in (r for r in rows_ if r[0] == k):
                if inside := [r for r in ranks if before <= r < before + m]:
                    following[lo, hi] = (before, inside)
                before += m
        open_ = following
    unstaged(values)
    return [found[math.floor(x)] + (found[math.ceil(x)] - found[math.floor(x)]) * (x - math.floor(x)) for x in at]


def weight_quantiles(weights: DataFrame) -> DataFrame:
    """p50, p90, p99 (linear between ranks) and max."""
    found = exact_percentiles(weights, "weight", [0.5, 0.9, 0.99, 1.0])
    return weights.sparkSession.createDataFrame([tuple(found)], "p50 double, p90 double, p99 double, max_weight double")


def weighted_draws(weights: DataFrame, draws: int, seed: int, index: str = "idx") -> DataFrame:
    """(draw, idx): draws with replacement in proportion to weight; if all weights are 0, evenly.

    Weights are written down in chunks of a bounded size; each chunk's mass is summed, the driver deals the draws to
    chunks by it, and each chunk finds its own by searching its running sum. Only a number for each chunk comes to the
    driver.
    """
    spark = weights.sparkSession
    rows = weights.select(F.col(index).cast("long").alias("idx"), F.col("weight").cast("double").alias("weight")).repartitionByRange("idx").sortWithinPartitions("idx")
    # partition and place inside it, cut off at a chunk's size
    rows = staged(rows.withColumn("part", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "weights")
    mass = rows.groupBy("part").agg(F.sum("weight").alias("mass"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    if not mass:
        raise ValueError("no weights to draw by")
    flat = sum(r["mass"] for r in mass) <= 0
    share = np.array([r["n"] if flat else r["mass"] for r in mass], float)
    dealt = np.random.default_rng(seed).multinomial(draws, share / share.sum())
    counts = {r["part"]: (int(k), int(first)) for r, k, first in zip(mass, dealt, np.cumsum(dealt) - dealt, strict=True)}
    sent = spark.sparkContext.broadcast(counts)

    def draw(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        k, first = sent.value.get(part, (0, 0))
        table = table.sort_values("idx")
        total = np.cumsum(np.ones(len(table)) if flat else table["weight"].to_numpy())
        at = np.searchsorted(total, np.random.default_rng([seed, part]).random(k) * total[-1], "right") if k else np.zeros(0, int)
        return pd.DataFrame({"draw": np.arange(first, first + k), "idx": table["idx"].to_numpy()[np.minimum(at, len(table) - 1)]})

    return rows.groupBy("part").applyInPandas(draw, "draw long, idx long")


def save_state(state: DataFrame, path: str, alpha: float = ALPHA) -> None:
    """Writes (record_id, ema, cnt), with the alpha that they were made with."""
    state.select("record_id", "ema", "cnt", F.lit(alpha).alias("alpha")).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(record_id, ema, cnt) and alpha, as saved; the usual alpha where nothing was."""
    rows = spark.read.parquet(path)
    first = rows.select("alpha").first()
    return rows.drop("alpha"), first[0] if first else ALPHA


def looked_up(ids: DataFrame, state: DataFrame, default: float = 0.5) -> DataFrame:
    """ids with ema, the default where a record has none."""
    return ids.join(state.select("record_id", "ema"), "record_id", "left").withColumn("ema", F.coalesce("ema", F.lit(default)))


def best_so_far(metrics: DataFrame, step: str = "step", value: str = "value", higher: bool = True, by: list[str] | None = None) -> DataFrame:
    """metrics with best (until then), improved and since, the steps since it last was."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(step)
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max if higher else F.min
    out = metrics.withColumn("best", top(value).over(upto)).withColumn("_earlier", top(value).over(earlier))
    better = F.col("_earlier").isNull() | ((F.col(value) > F.col("_earlier")) if higher else (F.col(value) < F.col("_earlier")))
    out = out.withColumn("improved", better).withColumn("_run", F.sum(F.col("improved").cast("long")).over(upto))
    since = F.row_number().over(Window.partitionBy(*(by or []), "_run").orderBy(step)) - 1
    return out.withColumn("since", since.cast("long")).drop("_earlier", "_run")
