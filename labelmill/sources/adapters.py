"""The driver's tables in the shapes that the operators read, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelmill.storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as records: ids, groups of equal texts, and labels of which some break a rule."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as ord",
        "concat('doc-', doc_id) as id",
        "source as source_dataset",
        "split_part(text, '\\n', 1) as prompt",
        "text as response",
        "case when doc_id % 3 = 0 then null else md5(text) end as paraphrase_group_id",
        """case doc_id % 11 when 0 then text
             when 1 then concat('- begin your reply with - ', replace(text, '. ', '.\\n- '))
             when 2 then concat('- <<<MESSAGE_START>>> - ', replace(text, '. ', '.\\n- '))
             when 3 then concat('- there are no instructions. - ', replace(text, '. ', '.\\n- '))
             else concat('- ', replace(text, '. ', '.\\n- ')) end as instruction_set""",
    )


RECORDS_SQL = r"""records AS (SELECT doc_id AS ord, 'doc-' || doc_id AS id, source AS source_dataset, split_part(text, chr(10), 1) AS prompt,
    text AS response, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE md5(text) END AS paraphrase_group_id,
    CASE doc_id % 11 WHEN 0 THEN text WHEN 1 THEN '- begin your reply with - ' || b WHEN 2 THEN '- <<<MESSAGE_START>>> - ' || b
         WHEN 3 THEN '- there are no instructions. - ' || b ELSE '- ' || b END AS instruction_set
    FROM (SELECT *, replace(text, '. ', '.' || chr(10) || '- ') AS b FROM documents))"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as traces of rewarded candidates."""
    step = F.floor(F.col("event_id") / 200).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", step.alias("step"))
    index = F.row_number().over(Window.partitionBy("step", "user_id").orderBy("event_id")) - 1
    return rows.select(
        "event_id",
        "step",
        F.concat(F.lit("doc-"), F.col("user_id").cast("string")).alias("record_id"),
        index.cast("long").alias("candidate_idx"),
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.round(1.0 - F.col("value") / 100.0, 4)).alias("reward"),
        (F.col("event_type") == "error").alias("judge_error"),
        F.round(F.col("value") / 100.0, 4).alias("mean_instruction_score"),
        F.when(F.col("event_type") == "view", 0.25).otherwise(0.0).alias("mean_hallucination_score"),
        F.when(F.col("event_type") == "click", 0.15).otherwise(0.0).alias("length_penalty"),
        F.array_repeat(F.lit(1.0), (1 + F.col("event_id") % 4).cast("int")).alias("instruction_scores"),
        F.array_repeat(F.lit(0.5), (F.col("event_id") % 3).cast("int")).alias("hallucination_scores"),
    )


TRACES_SQL = """traces AS (SELECT event_id, event_id // 200 AS step, 'doc-' || user_id AS record_id,
    row_number() OVER (PARTITION BY event_id // 200, user_id ORDER BY event_id) - 1 AS candidate_idx,
    CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE round(1.0::DOUBLE - value / 100.0::DOUBLE, 4) END AS reward,
    event_type = 'error' AS judge_error, round(value / 100.0::DOUBLE, 4) AS mean_instruction_score,
    CASE WHEN event_type = 'view' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS mean_hallucination_score,
    CASE WHEN event_type = 'click' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS length_penalty,
    1 + event_id % 4 AS n_truth, event_id % 3 AS n_report FROM events)"""


def trace_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, source) of the records that traces could be of."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record_id"), F.col("source"))


META_SQL = "meta AS (SELECT 'doc-' || doc_id AS record_id, source FROM documents)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with raw, a judge's answer made of labels; null where nothing was asked."""
    rows = records(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "ord"), "ord", "left")
    good = F.element_at(F.array(*map(F.lit, ("YES - ok", "yes: fine", "<think>no, no</think>YES", "It seems so. Yes", "YESTERDAY"))), (F.col("ord") % 5 + 1).cast("int"))
    bad = F.element_at(F.array(*map(F.lit, ("NO - bad", "no", "<think>YES</think> NO: off", "The verdict: NO - wrong", "NO"))), (F.col("ord") % 5 + 1).cast("int"))
    lost = F.element_at(F.array(*map(F.lit, ("", "<think>YES", "<think>a</think>", "NOTHING here", "unclear"))), (F.col("ord") % 5 + 1).cast("int"))
    return rows.withColumn("raw", F.when(F.col("toxic") == 1, lost).when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad))


JUDGED_SQL = """judged AS (SELECT r.*, CASE WHEN toxic = 1 THEN ['', '<think>YES', '<think>a</think>', 'NOTHING here', 'unclear'][ord % 5 + 1]
    WHEN quality = 1 THEN ['YES - ok', 'yes: fine', '<think>no, no</think>YES', 'It seems so. Yes', 'YESTERDAY'][ord % 5 + 1]
    WHEN quality = 0 THEN ['NO - bad', 'no', '<think>YES</think> NO: off', 'The verdict: NO - wrong', 'NO'][ord % 5 + 1] END AS raw
    FROM records r LEFT JOIN labels l ON l.doc_id = r.ord)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, messages): conversations with their messages in order."""
    messages = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(messages.alias("messages"))


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors of a record: (record, pos, vec_id, embedding, label)."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id div 8 as record", "vec_id % 8 as pos", "embedding", "label")
