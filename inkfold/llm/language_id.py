"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from labelled texts. A text is encoded with each dictionary;
the language with the smallest output wins. Texts are encoded in chunks that all start from the dictionary, so that a
long text is not judged by how well it predicts itself, and memory stays bounded. A text is rejected when the winner's
margin over the runner-up is narrow: the margin is the share of the runner-up's bytes that the winner saves. As a share says
little of a short text, where one byte is a large one, the winner must save a least number of bytes besides.

Null texts and texts without a letter, empty ones too, get `und` with score 0 and are rejected. With no labelled text at
all every text is `und`. Very long texts are encoded whole, chunk by chunk. Ties go to the language that sorts first.
Repeated rows get a row each; an empty table gives none; extra columns are ignored, and kept by labelled_documents()
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from inkfold.llm.common import fresh_name, released

#: Documents of a language that its dictionary is cut from, at most, and characters of each: the bounded sample.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 512
DICTIONARY_BYTES = 32 * 1024
CHUNK = 8192
LEVEL, MIN_MATCH = 6, 3
#: Sampled documents that are sent to all tasks, at most; more of them are joined without that.
BROADCAST_ROWS = 100_000
#: Narrower margins are rejected, and fewer bytes saved.
MIN_MARGIN, MIN_SAVED = 0.02, 4
UND = "und"

PREDICTED_DDL = "doc_id bigint, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string())]
    + [("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]
)
LETTER = regex.compile(r"\p{L}")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(documents: DataFrame) -> dict[str, bytes]:
    """A dictionary for each language from labelled documents (doc_id, text, lang).

    Ids are dealt to SAMPLE_DOCS cells of each language by hash and the cell's least hash is kept, so the sample is spread
    evenly, is bounded for any number of rows, and a language with most of the rows is reduced before the shuffle.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    labelled = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    cells = labelled.groupBy("lang", F.pmod(key, F.lit(SAMPLE_DOCS)).alias("cell")).agg(F.min_by("doc_id", key).alias("doc_id"))
    chosen = cells.select(F.col("lang").alias("of"), F.col("doc_id").alias("chosen"))
    if labelled.select("lang").distinct().count() * SAMPLE_DOCS <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = documents.join(chosen, (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("of")))
    cut = F.substring("text", 1 + F.greatest(F.lit(0), F.expr(f"(length(text) - {SAMPLE_CHARS}) div 2")), F.lit(SAMPLE_CHARS))
    rows = texts.groupBy("lang", "doc_id").agg(F.min(cut).alias("text")).orderBy("lang", "doc_id").collect()
    parts: dict[str, list[str]] = {}
    for row in rows:
        if row["text"]:
            parts.setdefault(row["lang"], []).append(row["text"])
    return {lang: "\n".join(own).lower().encode("utf-8", "replace")[-DICTIONARY_BYTES:] for lang, own in sorted(parts.items())}


class Judge:
    """judge(text) gives (language, score, margin, rejected)."""

    def __init__(self, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> None:
        self.min_margin, self.by = min_margin, []
        options = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, source_size=CHUNK, dict_size=DICTIONARY_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        for lang, raw in sorted(dictionaries.items()):
            content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=options)
            self.by.append((lang, zstandard.ZstdCompressor(dict_data=content, compression_params=options).compress))

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        if not text or not self.by or not LETTER.search(text):
            return UND, 0.0, 0.0, True
        raw = text.lower().encode("utf-8", "replace")
        chunks = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        sizes = [sum(len(compress(c)) for c in chunks) for _, compress in self.by]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        margin = 1 - sizes[best] / second
        # bytes saved, as odds of the winner against the others
        score = 1 / sum(2.0 ** max(-60.0, sizes[best] - s) for s in sizes)
        return self.by[best][0], score, margin, margin < self.min_margin or second - sizes[best] < MIN_SAVED


def classify(documents: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of each document. Reads ids and texts alone."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, min_margin).judge
        for batch in batches:
            judged = _judged(judge, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *judged], schema=PREDICTED)
        del judge
        released()

    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text").mapInArrow(predict, PREDICTED_DDL)


def _judged(judge, texts: pa.Array) -> list[pa.Array]:
    rows = list(zip(*(judge(t.as_py()) for t in texts))) or [[]] * 4
    return [pa.array(c, f.type) for c, f in zip(rows, list(PREDICTED)[2:])]


def labelled_documents(documents: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """documents without those that are rejected, with the predicted language as lang; all their columns."""
    dictionaries = train(documents.where(fold(F.col("doc_id")) != 2))
    told, refused = fresh_name(documents, "told"), fresh_name(documents, "refused")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries, min_margin).judge
        for batch in batches:
            lang, _, _, rejected = _judged(judge, batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, lang, rejected], names=[*batch.schema.names, told, refused])
        del judge
        released()

    noted = documents.mapInArrow(predict, StructType([*documents.schema.fields, StructField(told, StringType()), StructField(refused, BooleanType())]))
    return noted.where(~F.col(refused)).select(*[F.col(told).alias(c) if c == "lang" else F.col(f"`{c}`") for c in documents.columns])


def identify(documents: DataFrame, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Dictionaries from the documents outside the held-out fold, then a verdict for every document."""
    return classify(documents, train(documents.where(fold(F.col("doc_id")) != 2)), min_margin)
