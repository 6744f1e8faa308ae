"""Manifests, phases, splits on disk: small JSON files of the driver, written whole or not at all."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import shutil
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.batches import numbered
from labelmill.storage import write_text

PHASES = ("prompts", "paraphrases", "phase1", "phase2", "done")
#: What of a checkpoint is exported, keys of its configuration that become null, the one that gets another
#: value, marks that mustn't be left in it, the keys that only a checkpoint of reward training has, and short names of models.
EXPORTED = ("config", "lora_state", "projection_state", "opt_step")
BLANKED = ("checkpoint_dir", "precomputed_dir", "resume_from", "sft_init_from", "encoder_checkpoint", "hard_ids_json", "wandb_entity")
RUN_NAME = {"wandb_run_name": "released"}
PATH_MARKS = ("/mnt/", "/home/", "/scratch/", "/groups/")
REWARD_KEYS = ("val_reward", "best_reward", "reward_tracker_state")
MODEL_TAGS = {
    "Qwen/Qwen3.5-9B": "qwen3.5-9b",
    "google/gemma-2-9b-it": "gemma-2-9b-it",
    "mistralai/Ministral-3-8B-Instruct-2512-BF16": "ministral-3-8b",
}


def write_whole(path: str, text: str) -> None:
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


@dataclass
class Manifest:
    """What an extraction was made with. Unknown keys in a file are left out when it is read."""

    model_id: str = ""
    layers: list[int] = field(default_factory=list)
    num_tokens: int = 128
    token_position: str = "last"
    dtype: str = "float32"
    val_ratio: float = 0.05
    test_ratio: float = 0.05
    split_seed: int = 42
    random_seed: int | None = None
    dataset_paths: list[str] = field(default_factory=list)
    total_records: int = 0
    train_records: int = 0
    val_records: int = 0
    test_records: int = 0
    records_per_shard: int = 256
    stratify_by: str | None = None
    status: str = "in_progress"

    @classmethod
    def load(cls, path: str) -> Manifest:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        return cls(**{f.name: raw[f.name] for f in fields(cls) if f.name in raw})

    def save(self, path: str) -> None:
        write_whole(path, json.dumps(asdict(self), indent=2, sort_keys=True))

    def critical(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("status", "stratify_by")}


def load_or_create(folder: str, wanted: Manifest) -> Manifest:
    """The complete manifest of a folder; or one in progress, if it was made alike; or a new one."""
    path = os.path.join(folder, "manifest.json")
    if os.path.exists(path):
        have = Manifest.load(path)
        if have.status == "complete":
            return have
        differ = sorted(k for k, v in wanted.critical().items() if have.critical()[k] != v)
        if differ:
            raise ValueError(f"an extraction with other settings is in progress: {', '.join(differ)}")
        return have
    for split in ("train", "val", "test"):
        os.makedirs(os.path.join(folder, split), exist_ok=True)
    wanted.save(path)
    return wanted


def finalized(folder: str, manifest: Manifest) -> Manifest:
    """The manifest marked complete; this is the last thing that is written."""
    manifest.status = "complete"
    manifest.save(os.path.join(folder, "manifest.json"))
    return manifest


def require_complete(made: Manifest, layers: list[int]) -> None:
    """Raises if an extraction isn't complete, or lacks one of the layers."""
    if made.status != "complete":
        raise ValueError(f"the extraction is {made.status}, not complete")
    gone = sorted(set(layers) - set(made.layers))
    if gone:
        raise ValueError(f"layers {gone} weren't extracted, only {made.layers}")


def may_resume(manifest: Manifest, shards_there: int, resume: bool) -> None:
    """Raises if shards are there and going on wasn't asked for, or can't give the same result."""
    if shards_there and not resume:
        raise ValueError("a partial extraction is there; ask to resume it")
    if shards_there and (manifest.token_position == "random" or manifest.stratify_by):
        raise ValueError("random positions and stratified splits can't be resumed")


class PhaseMarker:
    """The phase that a run has reached, kept in a file."""

    def __init__(self, folder: str):
        self.path = os.path.join(folder, "phase.json")
        os.makedirs(folder, exist_ok=True)

    def get(self) -> str:
        if not os.path.exists(self.path):
            return PHASES[0]
        with open(self.path, encoding="utf-8") as f:
            return json.load(f)["phase"]

    def set(self, phase: str, written: int | None = None) -> None:
        if phase not in PHASES:
            raise ValueError(f"unknown phase: {phase!r}")
        if phase == "done" and written == 0:
            raise ValueError("nothing was written; the run isn't done")
        write_whole(self.path, json.dumps({"phase": phase}))

    def reached(self, phase: str) -> bool:
        return PHASES.index(self.get()) >= PHASES.index(phase)


def run_id(settings: dict, template: str = "") -> str:
    """Twelve characters of a digest of the settings and the prompt template."""
    body = settings | {"template": hashlib.sha256(template.encode()).hexdigest()}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:12]


def sanitised_config(config: dict, project: str) -> dict:
    """A configuration for others: keys that name paths and accounts null, the tracked project and run renamed where they are given, dataset paths emptied; raises if a local path is left anywhere in it."""
    renamed = {"wandb_project": project} | RUN_NAME
    clean = {k: None if k in BLANKED else renamed.get(k, v) for k, v in config.items()}
    if "dataset_paths" in clean:
        clean["dataset_paths"] = []
    left = [k for k, v in clean.items() if any(mark in json.dumps({k: v}, default=str) for mark in PATH_MARKS)]
    if left:
        raise ValueError(f"local paths are left in: {', '.join(left)}")
    return clean


def training_method(checkpoint: Iterable[str]) -> str:
    """grpo if a checkpoint's keys have reward bookkeeping, else sft."""
    return "grpo" if any(k in REWARD_KEYS for k in checkpoint) else "sft"


def model_tag(model_id: str) -> str:
    """The short name of a model; of one that isn't known the last part of its id, in lower case."""
    return MODEL_TAGS.get(model_id, model_id.split("/")[-1].lower())


def bfloat16_bits(x: np.ndarray) -> np.ndarray:
    """float32 values rounded to bfloat16 (to even on a tie), as 16-bit patterns; what isn't a number stays so."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32)
    rounded = (bits.astype(np.uint64) + 0x7FFF + ((bits >> 16) & 1)) >> 16
    return np.where(np.isnan(x), np.uint16(0x7FC0), rounded.astype(np.uint16))


def exported(checkpoint: dict, project: str, method: str | None = None, name: str | None = None, cast: Callable = bfloat16_bits) -> tuple[str, dict]:
    """(file name, what is exported) of a training checkpoint: cleaned configuration, adapter as it is, projection cast, step; everything else is dropped."""
    gone = [k for k in ("config", "lora_state") if k not in checkpoint]
    if gone:
        raise ValueError(f"not a training checkpoint: it lacks {', '.join(gone)}")
    config = sanitised_config(checkpoint["config"], project)
    out = {"config": config, "lora_state": checkpoint["lora_state"], "opt_step": checkpoint.get("opt_step")}
    if checkpoint.get("projection_state") is not None:
        out["projection_state"] = {k: cast(v) for k, v in checkpoint["projection_state"].items()}
    return name or f"{project}-{model_tag(config.get('model_id', 'unknown'))}-{method or training_method(checkpoint)}.pt", out


def path_free(config: Column) -> Column:
    """Whether no value of a map has a local path."""
    marks = F.array(*map(F.lit, PATH_MARKS))
    return ~F.exists(F.map_values(config), lambda v: F.exists(marks, lambda m: v.contains(m)))


def write_jsonl(df: DataFrame, path: str) -> None:
    """df as JSON lines in a folder that appears only when all is written; what was there is replaced."""
    stage = f"{path}._writing"
    df.write.mode("overwrite").json(stage)
    _put_in_place(df, stage, path)


def _put_in_place(df: DataFrame, stage: str, path: str) -> None:
    spark = df.sparkSession
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (stage, path))
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(new, True)
    if not fs.rename(old, new):
        raise OSError(f"{stage} can't be renamed to {path}")


def write_routes(routed: DataFrame, path: str) -> None:
    """Kept, removed and errors of each file in folders of their own, from one pass. routed has route and source_file; files are told apart by their whole path."""
    routed.write.mode("overwrite").partitionBy("route", "source_file").json(path)


def write_kept_lines(rows: DataFrame, kept: Column, path: str) -> None:
    """The raw lines (value) of kept rows, byte for byte."""
    rows.where(kept).select("value").write.mode("overwrite").text(path)


def write_mask(ids: DataFrame, path: str, id_col: str = "id", position: str = "ord") -> int:
    """A JSON array of ids in order, written whole by the driver, which takes them one partition at a time; path may be on any file system."""
    n = 0

    def parts():
        nonlocal n
        yield "["
        for r in ids.orderBy(position).select(id_col).toLocalIterator():
            yield (", " if n else "") + json.dumps(r[0], ensure_ascii=False)
            n += 1
        yield "]"

    write_text(ids.sparkSession, path, parts())
    return n


def removal_log(routed: DataFrame, shown: int = 500) -> DataFrame:
    """What the log says of each removed record; prompts and labels are cut to so many characters."""
    return _log(routed.where("route = 'removed'"), ("id", "tier", "rule", "verdict", "reason"), shown)


def errors_log(routed: DataFrame, shown: int = 500) -> DataFrame:
    """What the log says of each record on which a judge failed, to judge it again; prompts and labels are cut to so many characters."""
    return _log(routed.where("route = 'errors'"), ("id", "judge_error", "reason"), shown)


def _log(rows: DataFrame, names: tuple[str, ...], shown: int) -> DataFrame:
    texts = [F.substring(F.coalesce(c, F.lit("")), 1, shown).alias(c) for c in ("prompt", "instruction_set") if c in rows.columns]
    return rows.select(*(c for c in names if c in rows.columns), *texts)


def write_shards(acts: DataFrame, path: str, records_per_shard: int, order: list[str] | None = None) -> None:
    """Activations as Parquet by split and layer. With an order of the records, those of a split are cut into shards of just so many, the last one shorter, each a folder; else files have so many records at most."""
    if order is None:
        acts.write.mode("overwrite").option("maxRecordsPerFile", records_per_shard).partitionBy("split", "layer").parquet(path)
        return
    placed = numbered(acts.select("split", *order).distinct(), ["split", *order])
    # a row for each split
    first = placed.groupBy("split").agg(F.min("rn").alias("_first"))
    shard = F.floor((F.col("rn") - F.col("_first")) / records_per_shard).cast("long").alias("shard")
    shards = placed.join(F.broadcast(first), "split").select("split", *order, shard)
    rows = acts.join(shards, ["split", *order])
    rows.repartition("split", "layer", "shard").sortWithinPartitions("split", "layer", "shard", *order).write.mode("overwrite").partitionBy("split", "layer", "shard").parquet(path)


def materialised(path: str, build, spark) -> DataFrame:
    """The table at path, built first if it isn't there."""
    from labelmill.sources.readers import exists

    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def overlaid(defaults: dict, env: dict[str, str], names: dict[str, str], pins: dict | None = None) -> dict:
    """Settings with values of the environment by name, typed as the defaults are, then pins; an empty string counts as unset."""
    out = dict(defaults)
    for key, name in names.items():
        raw = env.get(name, "")
        if raw != "":
            kind = type(defaults[key])
            out[key] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw) if defaults[key] is not None else raw
    return out | (pins or {})


def chosen_profile(profiles: dict[str, dict], env: dict[str, str], name: str = "PROFILE", default: str = "default") -> dict:
    """A copy of the profile that the environment names; an empty name is the default, an unknown one an error."""
    wanted = env.get(name, "") or default
    if wanted not in profiles:
        raise KeyError(f"no profile is called {wanted!r}")
    return copy.deepcopy(profiles[wanted])


def checkpoint_report(spark: SparkSession, checkpoint: dict, path: str, project: str) -> dict:
    """What goes with an exported checkpoint: its cleaned configuration, its kind, and the size and SHA-256 of its file."""
    from labelmill.sources.digests import file_digests

    row = file_digests(spark, [path]).first()
    return {"config": sanitised_config(checkpoint["config"], project), "method": training_method(checkpoint), "bytes": row["bytes"], "sha256": row["sha256"]}


def dotenv(start: str, env: dict[str, str], name: str = ".env") -> dict[str, str]:
    """env with what the first file of that name, here or in a folder above, adds; env wins."""
    folder = os.path.abspath(start)
    while True:
        path = os.path.join(folder, name)
        if os.path.exists(path):
            break
        if folder == os.path.dirname(folder):
            return dict(env)
        folder = os.path.dirname(folder)
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            line = line.strip().removeprefix("export ")
            if line and not line.startswith("#") and "=" in line:
                key, _, value = line.partition("=")
                found[key.strip()] = value.strip().strip("\"'")
    return found | env


def data_mode(cache: str | None, jsonl: list[str] | None) -> str:
    """cache or jsonl, exactly one of which must be given and be there."""
    if bool(cache) == bool(jsonl):
        raise ValueError("give a cache or JSONL files, not both")
    gone = [p for p in ([cache] if cache else jsonl) if not os.path.exists(p)]
    if gone:
        raise FileNotFoundError(", ".join(gone))
    return "cache" if cache else "jsonl"


def removed(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def append_jsonl(rows: DataFrame, path: str | None) -> None:
    """Rows added to a log of JSON lines; no path, no log."""
    if path is not None:
        rows.write.mode("append").json(path)


def write_hard_ids(hard: DataFrame, shares: DataFrame, path: str, settings: dict) -> int:
    """Hard ids in the order of source and rank, with counts of each source, as one JSON file. The list is what training reads on one machine."""
    ids = [r[0] for r in hard.orderBy("source", "rank").select("record_id").toLocalIterator()]
    counts = {r["source"]: (r["selected"], r["underlying"]) for r in shares.collect()}
    body = {"record_ids": ids, "source_breakdown": {k: v[0] for k, v in counts.items() if v[0]}, "underlying_source_totals": {k: v[1] for k, v in counts.items()}, "total": len(ids), "config": settings}
    write_text(hard.sparkSession, path, [json.dumps(body, indent=2, ensure_ascii=False)])
    return len(ids)


def cached_ids(rows: DataFrame, path: str, id_col: str = "record_id") -> DataFrame:
    """The ids of a dataset from a cache, which is made anew if it has another number of rows."""
    from labelmill.sources.readers import exists

    spark, n = rows.sparkSession, rows.count()
    if not exists(spark, f"{path}/_SUCCESS") or spark.read.parquet(path).count() != n:
        rows.select(id_col).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
