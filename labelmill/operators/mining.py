"""Hard examples and reports over traces and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def record_means(traces: DataFrame, min_observations: int = 1) -> DataFrame:
    """(record_id, mean_reward, n) without rows that have a judge error; records seen less often are left out."""
    good = traces.where(~_error(traces))
    return good.groupBy("record_id").agg(F.avg("reward").alias("mean_reward"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_observations)


def _error(traces: DataFrame) -> Column:
    kind = traces.schema["judge_error"].dataType.simpleString()
    return F.coalesce(F.col("judge_error"), F.lit(False)) if kind == "boolean" else F.coalesce("judge_error", F.lit("")) != ""


def hard_ids(meta: DataFrame, traces: DataFrame, threshold: float = 0.85, target: int | None = None, min_observations: int = 1, exclude_unobserved: bool = False) -> DataFrame:
    """(record_id, source, mean_reward, rank): for each source the records of least reward below the threshold, then those never observed.

    With a target each source has a share of it in proportion to all its records, rounded half to even, one at least;
    what rounding leaves isn't dealt again. meta: (record_id, source).
    """
    means = record_means(traces, min_observations).select("record_id", "mean_reward")
    pool = meta.join(means, "record_id", "inner" if exclude_unobserved else "left").where(F.col("mean_reward").isNull() | (F.col("mean_reward") < threshold))
    order = Window.partitionBy("source").orderBy(F.col("mean_reward").isNull(), "mean_reward", "record_id")
    ranked = pool.withColumn("rank", F.row_number().over(order).cast("long"))
    if target is None:
        return ranked
    totals = meta.groupBy("source").agg(F.count(F.lit(1)).alias("of_source"))
    totals = totals.withColumn("of_all", meta.agg(F.count(F.lit(1))).scalar())
    cap = F.greatest(F.lit(1), F.bround(F.lit(float(target)) * F.col("of_source") / F.col("of_all"), 0)).cast("long")
    return ranked.join(totals.select("source", cap.alias("cap")), "source").where(F.col("rank") <= F.col("cap")).drop("cap")


def breakdown(meta: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each source how many are chosen and how many there are, with shares in per cent to one decimal."""
    every = meta.groupBy("source").agg(F.count(F.lit(1)).alias("underlying"))
    some = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("selected"))
    both = every.join(some, "source", "left").withColumn("selected", F.coalesce("selected", F.lit(0)).cast("long"))
    both = both.withColumn("all", every.agg(F.sum("underlying")).scalar()).withColumn("picked", chosen.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar())
    return both.select("source", "selected", "underlying", F.round(100.0 * F.col("selected") / F.col("picked"), 1).alias("selected_pct"), F.round(100.0 * F.col("underlying") / F.col("all"), 1).alias("underlying_pct"))


def ordered_hits(hard: DataFrame, dataset: DataFrame) -> DataFrame:
    """(position, record_id, idx): the first index of each hard id in the dataset, in the order of the hard ids. hard: (position, record_id); dataset: (idx, record_id)."""
    return hard.join(dataset.groupBy("record_id").agg(F.min("idx").alias("idx")), "record_id").select("position", "record_id", "idx")


def trace_bins(traces: DataFrame, size: int = 500) -> DataFrame:
    """For each bin of steps the means of a trace's figures and shares of its rows in per cent."""
    share = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return traces.groupBy(F.floor(F.col("step") / size).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("reward").alias("reward"),
        F.avg("mean_instruction_score").alias("inst"),
        F.avg("mean_hallucination_score").alias("halluc"),
        F.avg("length_penalty").alias("penalty"),
        F.avg(F.greatest(F.coalesce(F.size("hallucination_scores"), F.lit(0)), F.lit(0)).cast("double")).alias("bullets"),
        F.avg(F.greatest(F.coalesce(F.size("instruction_scores"), F.lit(0)), F.lit(0)).cast("double")).alias("truth"),
        share(F.col("reward") < 0).alias("negative_pct"),
        share(F.col("mean_hallucination_score") > 0).alias("hallucinated_pct"),
        share(_error(traces)).alias("error_pct"),
    )


def rule_statistics(results: DataFrame) -> DataFrame:
    """For each file, and over all (file null), what became of records (source_file, rule, verdict, judged, error)."""
    failed = F.coalesce("rule", F.lit("")) != ""
    error = F.coalesce("error", F.lit(False))
    kept = ~failed & ~error & (F.coalesce("verdict", F.lit("")) != "NO")
    count = lambda c, name: F.count_if(c).alias(name)
    return results.groupingSets([["source_file"], []], "source_file").agg(
        F.count(F.lit(1)).alias("total"),
        count(kept, "kept"),
        count(failed, "rule_removed"),
        count(~failed & ~error & (F.col("verdict") == "NO"), "judge_removed"),
        count(~failed & ~error & (F.col("verdict") == "YES"), "judge_passed"),
        count(~failed & ~error & F.col("verdict").isNull(), "judge_skipped"),
        count(error, "judge_error"),
        F.round(100.0 * F.count_if(kept) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("kept_pct"),
    )


def reason_counts(reasons: DataFrame) -> DataFrame:
    """Counts by (source, reason), by source, by reason and over all, from one pass; null stands for all."""
    return reasons.groupingSets([["source_dataset", "reason"], ["source_dataset"], ["reason"], []], "source_dataset", "reason").agg(F.count(F.lit(1)).alias("n"))


def audit(records: DataFrame, required: list[str], legacy: list[str]) -> DataFrame:
    """For each source, and over all, records, ids that repeat an earlier one, and records without a required field."""
    from labelmill.operators.rules import missing_fields

    missing = F.size(missing_fields({c: F.col(c) for c in required}, [F.col(c) for c in legacy])) > 0
    return records.groupingSets([["source_dataset"], []], "source_dataset").agg(
        F.count(F.lit(1)).alias("records"),
        (F.count(F.lit(1)) - F.count_distinct(F.coalesce("id", F.lit("")))).alias("duplicate_ids"),
        F.count_if(missing).alias("bad_fields"),
    )


def id_checksum(records: DataFrame, by: list[str], position: str = "ord", id_col: str = "id") -> DataFrame:
    """For each split, SHA-256 of its ids in order with line feeds between. The digest needs all ids of a split in one value."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct(position, id_col))), lambda x: x[id_col])
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(ids, "\n"), 256).alias("checksum"))


def dense_source_ids(records: DataFrame, source: str = "source_dataset") -> DataFrame:
    """(source, source_id): distinct sources in order, numbered from 0. There are few, so one task orders them."""
    names = records.select(source).distinct()
    return names.withColumn("source_id", (F.dense_rank().over(Window.orderBy(source)) - 1).cast("long"))


def source_losses(rows: DataFrame, batch: str = "batch", source: str = "source", loss: str = "loss") -> DataFrame:
    """Mean over batches of each source's mean in the batch."""
    return rows.groupBy(batch, source).agg(F.avg(loss).alias("m")).groupBy(source).agg(F.avg("m").alias("loss"), F.count(F.lit(1)).alias("batches"))


def phase_seconds(timings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., phase, seconds, share): what phases took, from rows (phase, seconds), and their share of all."""
    keys = by or []
    sums = timings.groupBy(*keys, "phase").agg(F.sum("seconds").alias("seconds"))
    # a row for each phase
    return sums.withColumn("share", F.try_divide("seconds", F.sum("seconds").over(Window.partitionBy(*(keys or [F.lit(0)])))))


def judge_errors(traces: DataFrame, by: list[str]) -> DataFrame:
    """How many rows of each group a judge failed on."""
    return traces.groupBy(*by).agg(F.count_if(_error(traces)).alias("errors"), F.count(F.lit(1)).alias("n"))


def best_layer(metrics: DataFrame) -> DataFrame:
    """The layer of least loss in each run (run, layer, val_loss), and mean and spread of the runs' best."""
    return metrics.groupBy("run").agg(F.min_by("layer", F.struct("val_loss", "layer")).alias("layer"), F.min("val_loss").alias("val_loss"))


def validation_mean(rows: DataFrame, order: str, value: str, samples: int, batch: int) -> DataFrame:
    """Mean of the first samples rows, filled up to whole batches, and how many there were; 0 without rows."""
    n = -(-samples // batch) * batch
    return rows.orderBy(order).limit(n).agg((F.coalesce(F.sum(value), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("n"))


def masked_source_loss(tokens: DataFrame, source: str = "source", loss: str = "loss", label: str = "label", hit: str = "hit", ignored: int = -100) -> DataFrame:
    """Mean loss and share of right tokens of each source, over tokens that have a label."""
    return tokens.where(F.col(label) != ignored).groupBy(source).agg(F.avg(loss).alias("loss"), F.avg(F.col(hit).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("tokens"))


def seed_study(runs: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and sample spread of a figure over runs."""
    return runs.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev(value).alias("spread"), F.count(F.lit(1)).alias("runs"))


def chart(rows: DataFrame, group: str, series: str, value: str, names: list[str]) -> DataFrame:
    """A row for each group and one for the mean of groups (group null), a column for each series."""
    wide = rows.groupBy(group).pivot(series, names).agg(F.avg(value))
    return wide.unionByName(wide.agg(*(F.avg(n).alias(n) for n in names)).withColumn(group, F.lit(None).cast(wide.schema[group].dataType)))
