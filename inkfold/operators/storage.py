"""Stored documents and entries: lists, look-ups, counts and the replacing sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

DEFAULT_LIMIT, MOST = 50, 200
#: Longest texts of stored columns; others are kept whole.
LENGTHS = {"entry_date_text": 60, "batch_no": 100, "recipient_id": 100, "prescription_no": 100, "unit": 50}


def document_list(documents: DataFrame, status: str | None = None, name: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest documents first, by id where times tie; at most 200."""
    if status and status.strip():
        documents = documents.where(F.col("status") == status.strip().upper())
    if name and name.strip():
        documents = documents.where(F.lower("file_name").contains(name.strip().lower()))
    return documents.orderBy(F.desc("created_at"), F.desc("id")).limit(min(DEFAULT_LIMIT if limit is None else int(limit), MOST))


def by_uuid(documents: DataFrame, uuid: str) -> DataFrame:
    return documents.where(F.col("document_uuid") == uuid).limit(1)


def with_counts(documents: DataFrame, entries: DataFrame, document_id: str = "id") -> DataFrame:
    """documents with entry_count and review_count, in one grouped join."""
    counts = entries.groupBy(F.col("document_id").alias("__id")).agg(F.count("*").alias("entry_count"), F.count_if("needs_review").alias("review_count"))
    out = documents.join(counts, documents[document_id] == F.col("__id"), "left").drop("__id")
    return out.fillna(0, ["entry_count", "review_count"])


def detail(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """documents with their entries, ordered by page and row, as an array; a document's entries are few."""
    own = [c for c in entries.columns if c != "document_id"]
    order = ["page_number", "row_index", *[c for c in own if c not in ("page_number", "row_index")]]
    lines = entries.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("entries"))
    return documents.join(lines, "id", "left")


def stored_entry(rows: DataFrame) -> DataFrame:
    """rows with texts cut to what the stored columns hold."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in LENGTHS.items() if c in rows.columns})


def replaced(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """stored, with all rows of the documents in fresh replaced by fresh."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def replace_sink(fresh: DataFrame, path: str, key: str = "document_id", buckets: int = 256) -> None:
    """Replace the rows of fresh's documents in a stored table; other documents' rows stay.

    The table lies in folders by a hash of the document, so their number is bounded. Only folders of fresh's documents are
    read and written again; they are replaced when the job commits, so a job that fails changes nothing. fresh is read more
    than once and should be stored or cached.
    """
    spark, bucket = fresh.sparkSession, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")
    placed = fresh.withColumn("bucket", bucket)
    touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # at most `buckets`
    try:
        kept = spark.read.schema(placed.schema).parquet(path).where(F.col("bucket").isin(touched))
        whole = replaced(kept, placed, key).select(placed.columns)
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        whole = placed
    whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def entries_of(rows: DataFrame) -> DataFrame:
    """Stored entries of parsed rows (as pages.extract() gives them): cells by their column's name, cut to what columns hold."""
    cell = lambda c: F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit("")).alias(c)
    texts = ["generic_name", "trade_name", "batch_no", "manufacturer", "received_from", "issued_to", "recipient_id", "unit", "prescription_no", "remark"]
    return stored_entry(
        rows.select(
            F.col("doc").alias("document_id"), F.col("page").alias("page_number"), "row_index", "form_code", "entry_date", F.coalesce(F.try_element_at("cells", F.lit("date")), F.lit("")).alias("entry_date_text"),
            *map(cell, texts), "balance_brought", "received", "issued", "balance", F.col("confidence").cast("decimal(5,4)").alias("confidence"), "needs_review", F.col("notes").alias("review_notes"), "raw_text",
        )
    )


def uploads(files: DataFrame, content: Column, name: Column) -> DataFrame:
    """Metadata of uploaded files: sha-256, size, stored name, and whether they pass the first checks."""
    error = F.when(~F.lower(name).endswith(".pdf"), "NOT_A_PDF").when(F.length(content) == 0, "EMPTY_FILE")
    digest = F.sha2(content, 256)
    return files.select(name.alias("file_name"), digest.alias("file_hash"), F.length(content).cast("bigint").alias("file_size"), F.concat_ws("-", F.substring(digest, 1, 32), name).alias("stored_name"), error.alias("error_code"))


def page_guard(page_count: Column, most: int = 50) -> Column:
    return F.when(page_count > most, "TOO_MANY_PAGES")


def usable_text(text: Column, least: int = 60) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= least, F.lit(False))
