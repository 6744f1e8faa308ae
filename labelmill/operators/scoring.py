"""Scores of candidate reports, their rewards, and statistics of the groups they come in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.arrays import EPSILON, mean
from labelmill.functions.text import csv_scores, labelled_line

NO_TRUTH = "(no ground truth)"


@dataclass(frozen=True)
class RewardConfig:
    """Weights and the two-sided length term. The defaults are those of a plain call; shipped() gives those of the recipes."""

    instruction_weight: float = 0.5
    hallucination_weight: float = 0.5
    over: bool = True
    k: float = 1.5
    lam: float = 0.1
    under: bool = False
    under_k: float = 0.5
    under_lam: float = 0.15

    @staticmethod
    def shipped() -> RewardConfig:
        return RewardConfig(instruction_weight=1.0, hallucination_weight=0.4, lam=0.15, under=True)


def length_penalty(n_report: Column, n_truth: Column, over: Column | bool = True, k: Column | float = 1.5, lam: Column | float = 0.1, under: Column | bool = False, under_k: Column | float = 0.5, under_lam: Column | float = 0.15) -> Column:
    """lam for each bullet over k times the truth's, under_lam for each under under_k times; 0 without truth."""
    over, k, lam, under, under_k, under_lam = (x if isinstance(x, Column) else F.lit(x) for x in (over, k, lam, under, under_k, under_lam))
    too_many = F.when(over, lam * F.greatest(F.lit(0.0), n_report - k * n_truth)).otherwise(F.lit(0.0))
    too_few = F.when(under, under_lam * F.greatest(F.lit(0.0), under_k * n_truth - n_report)).otherwise(F.lit(0.0))
    return F.when(n_truth <= 0, F.lit(0.0)).otherwise(too_many + too_few)


def reward(instruction_scores: Column, hallucination_scores: Column, n_truth: Column, config: RewardConfig | None = None) -> Column:
    """struct(reward, mean_instruction_score, mean_hallucination_score, length_penalty). Without truth there is no penalty; an empty list has mean 0."""
    c = config or RewardConfig()
    inst, halluc = mean(instruction_scores), mean(hallucination_scores)
    penalty = length_penalty(F.size(hallucination_scores), n_truth, c.over, c.k, c.lam, c.under, c.under_k, c.under_lam)
    total = F.lit(c.instruction_weight) * inst - F.lit(c.hallucination_weight) * halluc - penalty
    return F.struct(total.alias("reward"), inst.alias("mean_instruction_score"), halluc.alias("mean_hallucination_score"), penalty.alias("length_penalty"))


def judge_scores(text: Column, n_instructions: Column, n_report: Column) -> Column:
    """struct(instruction_scores, hallucination_scores, error) of a two-line answer. An answer with neither line is an error: zero recall, and no hallucination scores."""
    inst, halluc = labelled_line(text, "INSTRUCTIONS"), labelled_line(text, "HALLUCINATIONS")
    failed = inst.isNull() & halluc.isNull()
    return F.struct(
        csv_scores(F.when(~failed, inst), n_instructions).alias("instruction_scores"),
        F.when(failed, F.expr("cast(array() as array<double>)")).otherwise(csv_scores(halluc, n_report)).alias("hallucination_scores"),
        failed.alias("error"),
    )


def with_candidates(rows: DataFrame, candidates: str) -> DataFrame:
    """One row for each candidate of a row, with candidate_idx."""
    return rows.select(*(c for c in rows.columns if c != candidates), F.posexplode(candidates).alias("candidate_idx", "candidate"))


def group_statistics(traces: DataFrame, group: list[str], value: str = "reward") -> DataFrame:
    """traces with n, group_mean, group_std (of the population) and advantage of their group."""
    w = Window.partitionBy(*group)
    # sums of centred values, so that equal rewards have no spread at all
    centred = traces.withColumn("n", F.count(F.lit(1)).over(w).cast("long")).withColumn("group_mean", F.avg(value).over(w))
    spread = F.sqrt(F.avg((F.col(value) - F.col("group_mean")) * (F.col(value) - F.col("group_mean"))).over(w))
    return centred.withColumn("group_std", spread).withColumn("advantage", (F.col(value) - F.col("group_mean")) / (F.col("group_std") + EPSILON))


def informative_groups(traces: DataFrame, group: list[str], min_std: float = 0.05, max_mean: float = 0.95, strict32: bool = False, value: str = "reward") -> DataFrame:
    """One row for each group with n, its mean and spread, and fate: kept, low_std (looked at first) or high_mean. Groups of one are kept."""
    stats = traces.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("group_mean"), F.stddev_pop(value).alias("group_std"))
    kind = "float" if strict32 else "double"
    low = F.col("group_std").cast(kind) < F.lit(min_std).cast(kind)
    high = F.col("group_mean").cast(kind) > F.lit(max_mean).cast(kind)
    return stats.withColumn("fate", F.when(F.col("n") < 2, "kept").when(low, "low_std").when(high, "high_mean").otherwise("kept"))


def preference_pairs(traces: DataFrame, group: list[str], index: str = "candidate_idx", value: str = "reward", min_margin: float = 0.25) -> DataFrame:
    """For each group the first best and the first worst candidate, where they differ by the margin."""
    best = F.max_by(F.struct(index, value), F.struct(F.col(value), -F.col(index))).alias("best")
    worst = F.min_by(F.struct(index, value), F.struct(F.col(value), F.col(index))).alias("worst")
    pairs = traces.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), best, worst)
    margin = F.col(f"best.{value}") - F.col(f"worst.{value}")
    pairs = pairs.withColumn("margin", margin).where((F.col("n") >= 2) & (F.col(f"best.{index}") != F.col(f"worst.{index}")) & (F.col("margin") >= min_margin))
    return pairs.select(*group, F.col(f"best.{index}").alias("chosen_idx"), F.col(f"worst.{index}").alias("rejected_idx"), "margin")


# Forward values of losses; gradients aren't a matter of data processing.


def k3(policy: Column, reference: Column) -> Column:
    """exp(y) - 1 - y for y = reference - policy: never negative, 0 where they agree."""
    y = reference - policy
    return F.exp(y) - 1.0 - y


def pair_losses(pairs: DataFrame, beta: float = 0.1) -> DataFrame:
    """One row: dpo_loss, pair_accuracy and ipo_loss of pairs (pi_chosen, pi_rejected, ref_chosen, ref_rejected)."""
    delta = (F.col("pi_chosen") - F.col("pi_rejected")) - (F.col("ref_chosen") - F.col("ref_rejected"))
    # -log sigmoid(x) = log(1 + exp(-x)), without overflow
    x = -beta * delta
    softplus = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    margin = delta - F.lit(1.0 / (2.0 * beta))
    return pairs.agg(F.avg(softplus).alias("dpo_loss"), F.avg((delta > 0).cast("double")).alias("pair_accuracy"), F.avg(margin * margin).alias("ipo_loss"))


def group_loss(rows: DataFrame, group: list[str], kl_weight: float, logp: str = "policy_logp", kl: str = "kl", value: str = "reward") -> DataFrame:
    """One row: -mean(advantage * log-probability) + weight * mean KL, and the metrics beside it."""
    scored = group_statistics(rows, group, value)
    return scored.agg(
        (-F.avg(F.col("advantage") * F.col(logp)) + kl_weight * F.avg(kl)).alias("loss"),
        F.avg(value).alias("reward_mean"),
        F.stddev_pop(value).alias("reward_std"),
        F.avg(F.abs("advantage")).alias("mean_abs_advantage"),
        F.count_distinct(*group).alias("n_groups"),
    )
