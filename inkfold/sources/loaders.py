"""Loaders: source and keyword lists, answer keys and results, documents and their pages.

Files are read by Spark's own readers, so any store that Spark reaches will do. What opens a document's pages is given by the
caller, as no library for it is part of this one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkfold.functions.text import stripped
from inkfold.operators.keywords import Keyword
from inkfold.operators.news import sources as checked_sources

SOURCE_DDL = (
    "name string, url string, kind string, link_pattern string, max_articles int, max_pages int, extract_full_text boolean, `group` string, original_url string, status string"
)
#: Characters of a document's text that make a page's text usable, pages that are looked at, pages of a document at most.
SUFFIX, LEAST_TEXT, LOOKED_AT, MOST_PAGES = ".pdf", 60, 5, 50
KEY_ROW = "struct<date:string,name:string,id:string,brought:int,received:int,issued:int,balance:int>"


def _json(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def load_sources(spark: SparkSession, path: str, statuses: list[str] | None = ("ready",), only: str | None = None) -> DataFrame:
    """Source definitions of a file (an object with `sources`), of some statuses, checked and with defaults; ord is their place."""
    text = spark.read.text(path, wholetext=True)
    listed = text.select(F.posexplode(F.from_json("value", f"sources array<struct<{_fields(SOURCE_DDL)}>>")["sources"]).alias("ord", "s")).select("ord", "s.*")
    full = listed.withColumn("extract_full_text", F.coalesce("extract_full_text", F.lit(False)))
    return checked_sources(full, statuses=statuses, only=only)


def _fields(ddl: str) -> str:
    return ", ".join(":".join(f.rsplit(" ", 1)) for f in ddl.split(", "))


def load_keywords(spark: SparkSession, path: str) -> list[Keyword]:
    """The keywords of a file: a list, or an object with `keywords`. A keyword list is small, as it becomes patterns."""
    listed = json.loads(_json(spark, path))
    return [Keyword.of(k) for k in (listed["keywords"] if isinstance(listed, dict) else listed)]


def load_key(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an answer key, a file for each page: page, ord, the row's fields, effective_date (a blank cell means the day above) and trade_name."""
    raw = spark.read.schema(f"page int, form_code string, trade_name string, rows array<{KEY_ROW}>").json(path, multiLine=True)
    rows = raw.select("page", "form_code", F.coalesce("trade_name", F.lit("")).alias("trade_name"), F.posexplode("rows").alias("ord", "r")).select("page", "form_code", "trade_name", "ord", "r.*")
    above = Window.partitionBy("page").orderBy("ord")
    return rows.withColumn("effective_date", F.coalesce(F.last(F.nullif("date", F.lit("")), ignorenulls=True).over(above), F.lit("")))


def load_result(spark: SparkSession, path: str, fields: str) -> tuple[DataFrame, DataFrame]:
    """(rows, pages) of a result file: rows with page, ord and the given fields (a DDL list), pages with page, form, rows, error."""
    ddl = f"rows array<struct<page:int, {_fields(fields)}>>, pages array<struct<page:int,form:string,rows:int,skew:double,source:string,confidence:double,error:string>>"
    raw = spark.read.schema(ddl).json(path, multiLine=True)
    rows = raw.select(F.posexplode("rows").alias("ord", "r")).select("ord", "r.*")
    return rows, raw.select(F.inline("pages"))


def inspected(documents: DataFrame, opened: Callable[[bytes], tuple[bool, list[str]]]) -> DataFrame:
    """path, ok, error_code, pages, text_layer, size of documents (path, length, content, as binaryFile gives them).

    opened gives whether a document needs a password and the texts of its first pages, with an empty text for each further page;
    it raises on a document that can't be opened. Suffix and size are judged first, so that nothing is opened in vain.
    """

    @F.pandas_udf("struct<error_code:string,pages:int,text_layer:boolean>")
    def look(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_looked(path, content) for path, content in zip(paths, contents)], columns=["error_code", "pages", "text_layer"]).astype({"pages": "Int32"})

    def _looked(path: str, content: bytes | None) -> tuple:
        if not path.lower().endswith(SUFFIX):
            return "UNSUPPORTED", None, None
        if not content:
            return "CORRUPTED", None, None
        try:
            locked, texts = opened(bytes(content))
        except Exception:  # noqa: BLE001  whatever a library raises on a broken document
            return "CORRUPTED", None, None
        if locked or not texts:
            return ("PASSWORD_REQUIRED" if locked else "CORRUPTED"), None, None
        usable = any(len(t.strip()) >= LEAST_TEXT for t in texts[:LOOKED_AT])
        return ("TOO_MANY_PAGES" if len(texts) > MOST_PAGES else None), len(texts), usable

    seen = documents.withColumn("__seen", look(F.col("path"), F.col("content")))
    return seen.select("path", F.col("__seen.error_code").isNull().alias("ok"), "__seen.error_code", "__seen.pages", "__seen.text_layer", F.col("length").alias("size"))


def scanned(documents: DataFrame, numbers: DataFrame, read: Callable[[bytes, int], Iterable[dict]], fields: str, only: list[int] | None = None) -> DataFrame:
    """path, page, error and the fields of what `read` gives for each page; numbers: path, pages.

    Each page is read apart: one that raises gets a row with its error, and the others go on.
    """
    wanted = numbers.where("pages > 0").select("path", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    wanted = wanted.where(F.col("page").isin(only)) if only is not None else wanted
    names = [f.split(" ", 1)[0] for f in fields.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[dict] = []
            for path, page, content in zip(frame["path"], frame["page"], frame["content"]):
                try:
                    got = [{**row, "path": path, "page": page, "error": None} for row in read(bytes(content), int(page))]
                except Exception as failed:  # noqa: BLE001  one page must not fail its document
                    got = [{"path": path, "page": page, "error": f"{type(failed).__name__}: {failed}"}]
                rows += got or [{"path": path, "page": page, "error": None}]
            yield pd.DataFrame(rows, columns=["path", "page", "error", *names])

    return documents.select("path", "content").join(wanted, "path").mapInPandas(each, f"path string, page int, error string, {fields}")


def read_in_batches(df: DataFrame, image: str, reader: Callable[[list[bytes]], list[str]], out: str = "text") -> DataFrame:
    """df with the reader's text of each image; the reader gets a batch at a time and what it leaves out at the end is empty."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for images in batches:
            texts = list(reader([bytes(b) for b in images])) if len(images) else []
            yield pd.Series((texts + [""] * len(images))[: len(images)], dtype="object")

    return df.withColumn(out, read(F.col(image)))


def reads_by_form_feed(answer: Column) -> Column:
    """The texts of one answer that parts its images by form feeds, stripped."""
    return F.transform(F.split(answer, "\f"), lambda t: stripped(t))
