"""Commands over the operators: filter, mask, split, hard-ids, traces and audit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from labelmill.operators import mining, rules, splits
from labelmill.plans import manifest
from labelmill.sources import readers


def _records(spark: SparkSession, args: argparse.Namespace, empty: str = "skip"):
    return readers.dataset(spark, readers.input_files(args.inputs, args.output), policy="raise", missing="raise", empty=empty)


def run_filter(spark: SparkSession, args: argparse.Namespace) -> None:
    rule = rules.failed_rule(F.col("instruction_set"), F.col("prompt"), F.col("retrieval_prompt"))
    rows = _records(spark, args).withColumn("rule", rule)
    manifest.write_routes(rows.withColumn("route", F.when(F.col("rule") == "", "kept").otherwise("removed")), args.output)
    results = rows.select("source_file", "rule", F.lit(None).cast("string").alias("verdict"), F.lit(False).alias("error"))
    mining.rule_statistics(results).orderBy("source_file").show(100, False)


def run_mask(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = _records(spark, args, empty="raise").withColumn("reason", rules.mask_reason(F.col("instruction_set"), args.max_bullets))
    n = manifest.write_mask(rows.where("reason = 'kept'"), args.output)
    mining.reason_counts(rows).orderBy(F.desc("n")).show(100, False)
    print(f"{n} ids written")


def run_split(spark: SparkSession, args: argparse.Namespace) -> None:
    # splits depend on the order in which files are given
    rows = readers.dataset(spark, args.inputs, missing="raise")
    mask = readers.mask(spark, args.mask) if args.mask else None
    splits.split_then_mask(rows, mask, val_ratio=args.val, test_ratio=args.test, seed=args.seed, stratify_by=args.stratify_by).write.mode("overwrite").partitionBy("split").parquet(args.output)


def run_hard_ids(spark: SparkSession, args: argparse.Namespace) -> None:
    traces = readers.traces(spark, args.inputs, policy="raise")
    meta = readers.shard_meta(spark, args.meta).withColumnRenamed("source_dataset", "source")
    hard = mining.hard_ids(meta, traces, args.threshold, args.target, args.min_observations, args.exclude_unobserved)
    settings = {k: getattr(args, k) for k in ("threshold", "target", "min_observations", "exclude_unobserved")}
    print(f"{manifest.write_hard_ids(hard, mining.breakdown(meta, hard), args.output, settings)} ids written")


def run_traces(spark: SparkSession, args: argparse.Namespace) -> None:
    mining.trace_bins(readers.traces(spark, args.inputs), args.bin).orderBy("bin").show(1000, False)


def run_audit(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = readers.jsonl(spark, readers.input_files(args.inputs, args.output), readers.RECORD_FIELDS)
    mining.audit(rows, ["id", "source_dataset", "prompt", "response", "instruction_set"], ["prompt_a", "response_a", "response_b"]).orderBy("source_dataset").show(100, False)
    if args.mask:
        print(f"{splits.orphans(readers.mask(spark, args.mask), rows).count()} ids of the mask match no record")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="labelmill", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, run in (("filter", run_filter), ("mask", run_mask), ("split", run_split), ("hard-ids", run_hard_ids), ("traces", run_traces), ("audit", run_audit)):
        p = commands.add_parser(name)
        p.add_argument("inputs", nargs="+")
        p.add_argument("--output", default=f"labelmill-{name}")
        p.add_argument("--mask")
        p.set_defaults(run=run)
        if name == "mask":
            p.add_argument("--max-bullets", type=int, default=6)
        if name == "split":
            p.add_argument("--val", type=float, default=0.1)
            p.add_argument("--test", type=float, default=0.1)
            p.add_argument("--seed", type=int, default=42)
            p.add_argument("--stratify-by")
        if name == "hard-ids":
            p.add_argument("--meta", required=True)
            p.add_argument("--threshold", type=float, default=0.85)
            p.add_argument("--target", type=int)
            p.add_argument("--min-observations", type=int, default=1)
            p.add_argument("--exclude-unobserved", action="store_true")
        if name == "traces":
            p.add_argument("--bin", type=int, default=500)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(SparkSession.builder.appName(f"labelmill-{args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
