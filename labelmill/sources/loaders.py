"""Prompt sources: each gives (source, task_type, ord, prompt) from a DataFrame of the shape its data has upstream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.functions.text import strip
from labelmill.operators.batches import first_rows


@dataclass(frozen=True)
class Source:
    """A named source: how prompts come out of its rows, and what type of task they are."""

    name: str
    task_type: str
    prompts: Callable[[DataFrame, str], DataFrame]

    def read(self, rows: DataFrame, ord_col: str = "ord", most: int | None = None) -> DataFrame:
        """(source, task_type, ord, prompt), stripped, empty ones left out, the first most of them."""
        found = self.prompts(rows, ord_col).withColumn("prompt", strip(F.col("prompt"))).where("prompt <> ''")
        found = first_rows(found.select(F.col(ord_col).alias("ord"), "prompt"), most, ["ord"])
        return found.select(F.lit(self.name).alias("source"), F.lit(self.task_type).alias("task_type"), "ord", "prompt")


def _is_user(m: Column) -> Column:
    return m["role"] == "user"


def plain(rows: DataFrame, ord_col: str) -> DataFrame:
    return rows.select(ord_col, "prompt")


def first_of_each_task(rows: DataFrame, ord_col: str) -> DataFrame:
    """The first row of each task, even if it then turns out empty: definition and, where both are there, inputs."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("task_name").orderBy(ord_col))).where("_rn = 1")
    definition, inputs = strip(F.coalesce("definition", F.lit(""))), strip(F.coalesce("inputs", F.lit("")))
    prompt = F.when((definition != "") & (inputs != ""), F.concat(definition, F.lit("\n\nInput: "), inputs)).otherwise(F.concat(definition, inputs))
    return first.withColumn("prompt", prompt).where("prompt <> ''").drop("_rn")


def leading_user(rows: DataFrame, ord_col: str) -> DataFrame:
    """The prompt of conversations that a user begins."""
    return rows.where((F.size("messages") > 0) & _is_user(F.get("messages", F.lit(0)))).select(ord_col, "prompt")


def first_user(rows: DataFrame, ord_col: str) -> DataFrame:
    """The first thing a user says."""
    return rows.select(ord_col, F.get(F.filter("messages", _is_user), F.lit(0))["content"].alias("prompt")).where("prompt is not null")


REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    """Adds a source, or replaces one of that name."""
    REGISTRY[source.name] = source
    return source


register(Source("ifeval", "format_constraints", plain))
register(Source("supernatural", "task_definition", first_of_each_task))
register(Source("ultrachat", "chat", leading_user))
register(Source("if_multi_constraints", "multi_constraints", first_user))
register(Source("synthetic", "synthetic", plain))


def collected(inputs: dict[str, DataFrame], ord_col: str = "ord", most: int | None = None) -> DataFrame:
    """All prompts of the named sources, one after the other."""
    out: DataFrame | None = None
    for k, (name, rows) in enumerate(inputs.items()):
        if name not in REGISTRY:
            raise KeyError(f"no source is called {name!r}")
        part = REGISTRY[name].read(rows, ord_col, most).withColumn("source_rank", F.lit(k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out.withColumn("group_id", F.md5(F.concat_ws("|", "source", F.col("ord").cast("string"))))


def synthetic_file(spark: SparkSession, path: str) -> DataFrame:
    """(ord, prompt) of a JSONL file; bad lines are skipped, a missing file is empty."""
    from labelmill.sources.readers import ORD, exists, jsonl

    if not exists(spark, path):
        return spark.createDataFrame([], f"ord {ORD}, prompt string")
    return jsonl(spark, [path], "prompt string", policy="skip").select("ord", "prompt")
