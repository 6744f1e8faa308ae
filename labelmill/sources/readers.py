"""Readers of JSONL datasets, masks, traces and shard descriptions, with a policy for bad lines."""

from __future__ import annotations

import glob
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.functions.text import blank
from labelmill.plans.manifest import Manifest, require_complete
from labelmill.sources.digests import file_digests
from labelmill.storage import whole_path

RECORD_FIELDS = "id string, source_dataset string, prompt string, response string, instruction_set string, retrieval_prompt string, metadata string, prompt_a string, response_a string, response_b string, prompt_b string"
TRACE_FIELDS = (
    "step bigint, record_id string, candidate_idx int, prompt string, response string, gt_instructions array<string>, itm_bullets array<string>, itm_report string, "
    "instruction_scores array<double>, hallucination_scores array<double>, instruction_details string, hallucination_details string, mean_instruction_score double, "
    "mean_hallucination_score double, length_penalty double, reward double, advantage double, judge_model string, judge_error string, reward_config map<string,string>"
)
SHARD_FIELDS = "record_id string, source_dataset string, prompt string, response string, instruction_set string, response_a_total_tokens int, selected_token_count int, selected_range array<int>"
ORD = "struct<rank: bigint, block: bigint, line: bigint>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Stores without a host are written with one slash or three.
_NO_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*):///"


def _uri(status) -> str:
    return re.sub(_NO_HOST, r"\1:/", status.getPath().toUri().toString())


def source_order(spark: SparkSession, paths: list[str], missing: str = "raise") -> list[str]:
    """The files that paths name, as URIs, in the order in which they are given, and as often; those of a pattern or folder in the order of their names. Files and folders whose name begins with a dot or an underscore are left out, as Spark does."""
    found: list[str] = []
    for given in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(given)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [fs.getFileStatus(p)] if fs.exists(p) else fs.globStatus(p) or []
        if not len(there) and missing == "raise":
            raise FileNotFoundError(f"no such path: {given}")
        for status in there:
            top = _uri(status)
            if not status.isDirectory():
                found.append(top)
                continue
            inside, files = [], fs.listFiles(status.getPath(), True)
            while files.hasNext():
                inside.append(_uri(files.next()))
            found += sorted(f for f in inside if not re.search(r"/[._]", f.removeprefix(top)))
    return found


def _ranked(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of files with their place and the rank of the line's file among files. A file that is named twice gives its lines twice, so what gives the ranks is a table that is joined by the file's name."""
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)).toString()) for f in dict.fromkeys(files)]
    lines = spark.read.text(literal).select("value", F.input_file_name().alias("source_file"), F.regexp_replace("_metadata.file_path", _NO_HOST, "$1:/").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    if len(files) == 1:
        return lines.withColumn("_rank", F.lit(0).cast("long"))
    order = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "_file string, _rank long")
    return lines.join(order, "_file")


def jsonl(spark: SparkSession, paths: list[str], fields: str, policy: str = "raise", missing: str = "raise", empty: str = "skip") -> DataFrame:
    """Rows of JSON lines with source_file, ord and value, the line itself.

    ord orders files as they are given and lines by place: it is a struct of the file's rank, the block of the file that the line was read
    from and a number that grows within the block, however Spark deals blocks to tasks. A path that is given twice is read
    twice; files of a pattern or folder are in the order of their names. policy: raise on a bad line, or skip it; a
    line that is JSON but no object is bad. missing: raise on a missing path, or skip it. empty: skip lines of white space, or raise on them.
    """
    if not {policy, missing, empty} <= {"raise", "skip"}:
        raise ValueError("policy, missing and empty are raise or skip")
    files = source_order(spark, paths, missing)
    schema = T._parse_datatype_string(fields)
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("source_file", T.StringType()), T.StructField("ord", T._parse_datatype_string(ORD)), T.StructField("value", T.StringType())]))
    lines = _ranked(spark, files).withColumn("_at", F.struct(F.col("_rank").alias("rank"), F.col("_block").alias("block"), F.col("_line").alias("line")))
    hollow = blank(F.col("value"))
    if empty == "skip":
        lines = lines.where(~hollow)
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("_row", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad = F.col("_row").isNull() | F.col("_row._bad").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    refused = [(bad & ~hollow, "bad JSON line in ")] if policy == "raise" else []
    refused += [(hollow, "empty line in ")] if empty == "raise" else []
    for which, what in refused:
        parsed = parsed.withColumn("value", F.when(which, F.raise_error(F.concat(F.lit(what), "source_file", F.lit(": "), F.substring("value", 1, 200)))).otherwise(F.col("value")))
    if policy == "skip":
        parsed = parsed.where(~bad | hollow)
    return parsed.select("_row.*", "source_file", F.col("_at").alias("ord"), "value").drop("_bad")


def dataset(spark: SparkSession, paths: list[str], policy: str = "skip", missing: str = "skip", require_label: bool = False, empty: str = "skip") -> DataFrame:
    """Records with current names; those without prompt or response, and if asked without label, are left out."""
    from labelmill.operators.rules import legacy_view

    rows = legacy_view(jsonl(spark, paths, RECORD_FIELDS, policy, missing, empty)).where("prompt <> '' and response <> ''")
    return rows.where("instruction_set <> ''") if require_label else rows


def traces(spark: SparkSession, paths: list[str], policy: str = "skip", typed: bool = False) -> DataFrame:
    """Trace rows; typed leaves out those without step, record or reward."""
    rows = jsonl(spark, paths, TRACE_FIELDS, policy, "skip" if typed else "raise")
    return rows.where("step is not null and record_id is not null and reward is not null") if typed else rows


def mask(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a validity mask, a JSON array in one file."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("id"))


def find_mask(spark: SparkSession, paths: list[str], name: str = "valid_record_ids.json") -> str | None:
    """The first mask beside an input, or one folder above."""
    for p in paths:
        folder = os.path.dirname(p)
        for candidate in (f"{folder}/{name}", f"{os.path.dirname(folder)}/{name}"):
            if exists(spark, candidate):
                return candidate
    return None


def input_files(patterns: list[str], output_dir: str, leave_out: tuple[str, ...] = (".removed.jsonl", ".errors.jsonl")) -> list[str]:
    """Files that patterns find, without those in the output folder and sidecar files, in order and once each. For local folders."""
    inside = os.path.abspath(output_dir) + os.sep
    found = {os.path.abspath(f) for p in patterns for f in glob.glob(p) or ([p] if os.path.exists(p) else [])}
    return sorted(f for f in found if not f.startswith(inside) and not f.endswith(leave_out))


def input_paths(spark: SparkSession, patterns: list[str], output_dir: str, leave_out: tuple[str, ...] = (".removed.jsonl", ".errors.jsonl")) -> list[str]:
    """As input_files, on any file system that Spark reads."""
    inside = whole_path(spark, output_dir).rstrip("/") + "/"
    found = set()
    for pattern in patterns:
        p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        for status in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []:
            found.add(status.getPath().toString())
    return sorted(f for f in found if not f.startswith(inside) and not f.endswith(leave_out))


def shard_meta(spark: SparkSession, pattern: str) -> DataFrame:
    """(record_id, source_dataset) of shard descriptions, JSON arrays; of a repeated id the last file and place counts."""
    rows = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SHARD_FIELDS.split(', '))}>>")).alias("pos", "row"))
    return rows.where("row.record_id <> ''").groupBy("row.record_id").agg(F.max_by("row.source_dataset", F.struct("file", "pos")).alias("source_dataset"))


def verified(spark: SparkSession, wanted: dict[str, str]) -> None:
    """Raises if a file's SHA-256 isn't the wanted one."""
    have = {r["path"]: r["sha256"] for r in file_digests(spark, list(wanted)).collect()}
    wrong = [p for p, digest in wanted.items() if have.get(whole_path(spark, p)) != digest]
    if wrong:
        raise ValueError(f"SHA-256 differs: {', '.join(wrong)}")


def activation_table(spark: SparkSession, path: str, split: str, layers: list[int], valid: DataFrame | None = None, made: Manifest | None = None) -> DataFrame:
    """Activations of a split and layers; folders of others aren't read, rows outside the mask are left out before their arrays are. With its manifest, raises for an extraction that isn't complete or lacks a layer."""
    if made is not None:
        require_complete(made, layers)
    rows = spark.read.parquet(path).where((F.col("split") == split) & F.col("layer").isin(layers))
    return rows.join(valid.select(F.col("id").alias("record_id")), "record_id", "left_semi") if valid is not None else rows


#: Bytes of a row group, and rows of a page, of a table that is looked up by record.
LOOKUP_BYTES, LOOKUP_ROWS = 16 << 20, 256
#: As many values of an IN Spark hands to Parquet one by one; of more only the range.
IN_VALUES = 10


def write_by_record(acts: DataFrame, path: str, distinct: int = 1_000_000, mode: str = "overwrite") -> None:
    """Activations (split, layer, record_id, ...) for lookups: sorted by record inside split and layer, so that row groups and pages hold few records each, with Bloom filters and page statistics of record_id. distinct: records of a file, for the size of its filter."""
    writer = acts.repartitionByRange("split", "layer", "record_id").sortWithinPartitions("split", "layer", "record_id").write.mode(mode).partitionBy("split", "layer")
    options = {"parquet.bloom.filter.enabled#record_id": "true", "parquet.bloom.filter.expected.ndv#record_id": distinct, "parquet.bloom.filter.max.bytes": 4 << 20, "parquet.block.size": LOOKUP_BYTES, "parquet.page.row.count.limit": LOOKUP_ROWS, "parquet.page.size": 1 << 20}
    writer.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def by_record(spark: SparkSession, path: str, split: str, layers: list[int], ids: list[str]) -> DataFrame:
    """Activations of some records, of a table that write_by_record wrote. Folders of other splits and layers, row groups whose statistics or filter don't have an id, and pages without one aren't read."""
    rows = spark.read.parquet(path).where((F.col("split") == split) & F.col("layer").isin(layers))
    wanted = F.lit(False)
    for lo in range(0, len(ids), IN_VALUES):
        some = F.col("record_id").isin(ids[lo : lo + IN_VALUES])
        wanted = some if not lo else wanted | some
    return rows.where(wanted)


def json_file(path: str) -> dict | list:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
