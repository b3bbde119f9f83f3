"""A training-corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from mercata.llm import decontaminate, mixing, near_copies, secrets, toxicity
from mercata.llm.common import remove, shared_folder, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold. Each row is scored where it lies."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (Jaccard similarity 0.8 of five-word shingles): the one of the smallest id."""
    small_batches(spark)
    return near_copies.keep_one(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(secrets.find_secrets(docs.select(*COLUMNS)))
    changed = F.size("secret_spans") > 0
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate and number of copies under the target mix; those of no copy go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mix(docs.select(*COLUMNS), labels, domains=mixing.QUALITY_DOMAINS, targets=mixing.QUALITY_TARGETS).where("copies > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix),
]

#: Learned scores, fingerprints and fitted rates are beyond SQL; the tests plant cases for every stage and hold near copies and decontamination against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet to the shared folder and reread; a stage's table goes when the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
