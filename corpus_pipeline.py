"""From raw documents to token ids: quality rules, near duplicates, decontamination, personal data, SentencePiece."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm.decontaminate import uncontaminated
from labelmill.llm.near_dup import one_of_each
from labelmill.llm.pieces import encoded
from labelmill.llm.pii import sanitised
from labelmill.llm.quality_rules import keep_by_rules
from labelmill.llm.shared import shared_folder
from labelmill.storage import spread

PIECES_MODEL = os.environ.get("LABELMILL_PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, at a similarity of 0.8 or more of sets of five words, the document with the smallest id."""
    return one_of_each(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced by names of kinds; n_chars follows the text."""
    clean = sanitised(docs, everywhere=True, least_chars=1)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether decoding them gives the text again."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = encoded(docs.select(*kept, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), PIECES_MODEL, decoded_col="back")
    return coded.select(*kept, "ids", F.size("ids").cast("long").alias("n_ids"), (F.sha2("back", 256) == F.col("text_sha256")).alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", pieces),
]

#: Stages 1, 2 and 5 can't be said in SQL; the tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = f"{shared_folder(spark)}/labelmill/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
