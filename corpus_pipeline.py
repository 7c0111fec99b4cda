"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents, and keep further columns whatever
their names. An empty table passes through all stages as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.llm import decontamination, language_id, near_dedup, packing, pii
from inkfold.llm.common import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin, with it as their lang; others go.

    Null and empty texts and texts without a letter have no language and go. Long texts are judged whole; a tie of two
    languages has no margin. Repeated rows are judged each.
    """
    return language_id.labelled_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of the least doc_id, once if its row is repeated.

    Texts without words are no class and all stay. Long texts are compared whole. Rows without doc_id come before others.
    """
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs.

    Rows are judged one by one, so rows of one id or text don't share a verdict. Null texts have no words and stay.
    """
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text.

    Null texts stay null, with a null n_chars. Repeated rows stay repeated, with equal surrogates.
    """
    return pii.redact(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    A null text is packed as an empty one; long texts are cut into pieces; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Compression, signatures and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
