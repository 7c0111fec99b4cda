"""Queries over stored documents and entries; orders and lineitem stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.operators import storage


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "COMPLETED").otherwise("PENDING").alias("status"),
        F.concat_ws("-", F.lit("ledger"), F.col("o_custkey").cast("string"), F.lower("o_orderpriority")).alias("file_name"), F.md5(F.col("o_orderkey").cast("string")).alias("document_uuid"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"), (F.col("l_partkey") % 1000).alias("row_index"), (F.col("l_returnflag") == "R").alias("needs_review"),
        F.col("l_quantity").cast("int").alias("issued"), F.repeat(F.col("l_partkey").cast("string"), 20).alias("batch_no"), F.repeat(F.lit("ab"), 40).alias("entry_date_text"),
    )


DOCUMENTS = """(SELECT o_orderkey AS id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'PENDING' END AS status,
  'ledger-' || o_custkey || '-' || lower(o_orderpriority) AS file_name, md5(CAST(o_orderkey AS VARCHAR)) AS document_uuid FROM orders)"""
ENTRIES = """(SELECT l_orderkey AS document_id, l_linenumber AS page_number, l_partkey % 1000 AS row_index, l_returnflag = 'R' AS needs_review, CAST(l_quantity AS INT) AS issued,
  repeat(CAST(l_partkey AS VARCHAR), 20) AS batch_no, repeat('ab', 40) AS entry_date_text FROM lineitem)"""


def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.document_list(documents(spark, sf_dir), status=" completed ", name="LEDGER-1", limit=500)


def document_list_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.document_list(documents(spark, sf_dir))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.with_counts(documents(spark, sf_dir), entries(spark, sf_dir)).select("id", "entry_count", "review_count")


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.by_uuid(documents(spark, sf_dir), "c4ca4238a0b923820dcc509a6f75849b")


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storage.detail(documents(spark, sf_dir), entries(spark, sf_dir))
    marks = F.transform("entries", lambda e: F.concat_ws(":", e["page_number"].cast("string"), e["row_index"].cast("string"), e["issued"].cast("string")))
    return rows.select("id", F.coalesce(F.array_join(marks, ","), F.lit("")).alias("lines"))


def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = storage.stored_entry(entries(spark, sf_dir))
    return cut.groupBy(F.length("batch_no").alias("batch_length"), F.length("entry_date_text").alias("date_length")).agg(F.count("*").alias("n"), F.max("batch_no").alias("last_batch"))


def replacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document is extracted again, with one row."""
    old = entries(spark, sf_dir).select("document_id", "page_number", "issued")
    fresh = documents(spark, sf_dir).where("id % 10 = 0").select(F.col("id").alias("document_id"), F.lit(1).alias("page_number"), F.lit(7).alias("issued"))
    return storage.replaced(old, fresh).groupBy("document_id").agg(F.count("*").alias("n"), F.sum("issued").alias("issued"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("html").cast("binary").alias("content"), F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".PDF")).alias("name"))
    return storage.uploads(files, F.col("content"), F.col("name"))


def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pages = (F.col("n_chars") / 300).cast("int")
    return docs.select("doc_id", pages.alias("pages"), storage.page_guard(pages).alias("error"), storage.usable_text(F.col("text")).alias("text_layer"))


TABLE = [
    ("storage_document_list", document_list, f"SELECT * FROM {DOCUMENTS} WHERE status = 'COMPLETED' AND file_name ILIKE '%ledger-1%' ORDER BY created_at DESC, id DESC LIMIT 200"),
    ("storage_document_list_default", document_list_default, f"SELECT * FROM {DOCUMENTS} ORDER BY created_at DESC, id DESC LIMIT 50"),
    ("storage_counts", counts, f"SELECT id, count(document_id) AS entry_count, count(*) FILTER (needs_review) AS review_count FROM {DOCUMENTS} d LEFT JOIN {ENTRIES} e ON e.document_id = d.id GROUP BY id"),
    ("storage_lookup", lookup, f"SELECT * FROM {DOCUMENTS} WHERE document_uuid = 'c4ca4238a0b923820dcc509a6f75849b' LIMIT 1"),
    (
        "storage_detail", detail,
        f"SELECT id, coalesce(string_agg(page_number || ':' || row_index || ':' || issued, ',' ORDER BY page_number, row_index, needs_review, issued, batch_no), '') AS lines FROM {DOCUMENTS} d LEFT JOIN {ENTRIES} e ON e.document_id = d.id GROUP BY id",
    ),
    ("storage_truncation", truncation, f"SELECT length(b) AS batch_length, length(t) AS date_length, count(*) AS n, max(b) AS last_batch FROM (SELECT substr(batch_no, 1, 100) AS b, substr(entry_date_text, 1, 60) AS t FROM {ENTRIES}) GROUP BY 1, 2"),
    (
        "storage_replace", replacing,
        f"""SELECT document_id, count(*) AS n, CAST(sum(issued) AS BIGINT) AS issued FROM (
          SELECT document_id, issued FROM {ENTRIES} WHERE document_id NOT IN (SELECT id FROM {DOCUMENTS} WHERE id % 10 = 0) UNION ALL SELECT id, 7 FROM {DOCUMENTS} WHERE id % 10 = 0) GROUP BY 1""",
    ),
    (
        "storage_uploads", uploads,
        """SELECT name AS file_name, sha256(html) AS file_hash, CAST(strlen(html) AS BIGINT) AS file_size, substr(sha256(html), 1, 32) || '-' || name AS stored_name,
          CASE WHEN lower(name) NOT LIKE '%.pdf' THEN 'NOT_A_PDF' WHEN strlen(html) = 0 THEN 'EMPTY_FILE' END AS error_code
          FROM (SELECT html, page_id || CASE WHEN page_id % 3 = 0 THEN '.txt' ELSE '.PDF' END AS name FROM pages)""",
    ),
    (
        "storage_guards", guards,
        "SELECT doc_id, CAST(floor(n_chars / 300) AS INT) AS pages, CASE WHEN floor(n_chars / 300) > 50 THEN 'TOO_MANY_PAGES' END AS error, length(trim(text, ' ')) >= 60 AS text_layer FROM documents",
    ),
]
