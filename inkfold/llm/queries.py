"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from inkfold.llm import ann, decontamination, language_id, near_dedup, packing, pii, secret_scan, sharding, substring_dedup, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(documents, "doc_id", sharding.shard_names()).select("doc_id", "slot", "shard")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings with the forest's verdict; values as digests."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({"length": F.length("value"), "value_sha256": F.sha2("value", 256)}).drop("value")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages under each of their documents, with the runs from which run_links() reads every pair of texts."""
    return substring_dedup.by_document(substring_dedup.passages(table(spark, sf_dir, "documents"), with_runs=True))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the SQL; items with a proximity match (n_near) are the operator's only."""
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP9_SQL = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ALPHABET}', '{ALPHABET.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words
), found AS (
  SELECT s.doc_id, s.i, x.n, x.item_id
  FROM (SELECT DISTINCT n FROM item_windows) l, starts s, item_windows x
  WHERE s.i + l.n - 1 <= len(s.w) AND x.n = l.n AND x.win = array_to_string(s.w[s.i:s.i + l.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), by_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN by_item USING (doc_id)
"""

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_pii": op4_pii,
    "op5_near_dedup": op5_near_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_ann": op7_ann,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_language_id": op10_language_id,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op1_sharding": sharding.oracle("documents", "doc_id"),
    "op9_decontamination": OP9_SQL,
}
