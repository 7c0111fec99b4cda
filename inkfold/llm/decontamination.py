"""Benchmark decontamination over a distributed positional inverted index.

Documents are indexed in segments, each a row that holds whole documents: for each term (a word's 64-bit hash) the
sorted positions in the segment's token stream. Documents are set apart by a gap, so that no match spans two. The index
is split by document, so postings never move between tasks; the benchmark comes to them in blocks of bounded size, each
a stream of term numbers in which every window is a range. The driver holds one block at a time.

In a segment, windows with a term that the segment lacks drop out at once. The postings of each other window's rarest
term, less the term's offset in the window, are the places where the window may begin; they are intersected with the
offset-adjusted postings of its other terms, rarer ones first, for all windows together. What is left is a phrase match.
For a proximity match the window's distinct words must lie within a stretch of WINDOW + slack words, in any order: each
posting of the rarest term is kept while every other term has a posting near it, and the shortest stretch is measured.

Null and empty texts have no words and are never hit. Items without words, or without an id, have no windows. Repeated
document rows each get a row; repeated items with one id count once. Very long documents are segments of their own; very
long items are split over blocks with the words that a window needs beyond the cut. Matches don't rank each other, so
ties need no rule. An empty benchmark hits nothing; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from inkfold.llm.common import dropped, fresh_name, released, stored, words_of

WINDOW = 10
#: Words of a segment, but for a longer single document.
SEGMENT_WORDS = 500_000
#: Words of benchmark text that meet the index at a time.
BLOCK_WORDS = 2_000_000
#: Words that a proximity match may hold besides its window's number.
SLACK = 5
#: Places between two documents of a segment; WINDOW + slack may not be more.
GAP = 64
#: Candidate places that are tested at a time.
CANDIDATES = 200_000

INDEX_DDL = "segment string, doc_ids array<bigint>, starts array<bigint>, n_words array<bigint>, terms binary, ends binary, positions binary"
HIT_DDL = "segment string, slot int, doc_id bigint, n_words bigint, items array<string>, near array<string>, hits array<bigint>"
INDEX = pa.schema(
    [("segment", pa.string())]
    + [(n, pa.list_(pa.int64())) for n in ("doc_ids", "starts", "n_words")]
    + [(n, pa.binary()) for n in ("terms", "ends", "positions")]
)
HITS = pa.schema(
    [("segment", pa.string()), ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64())]
    + [("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())), ("hits", pa.list_(pa.int64()))]
)


def term_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class _Codes(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """argsort by two radix passes over 16 bits."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


class Segment:
    """Documents whose words are numbered as they come."""

    def __init__(self) -> None:
        self.codes, self.ids, self.streams, self.words = _Codes(), [], [], 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.streams.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        self.words += len(words)

    def row(self, name: str) -> dict:
        lengths = np.array([len(s) for s in self.streams], np.int64)
        starts = np.cumsum(lengths + GAP) - lengths - GAP
        stream = np.concatenate(self.streams) if self.streams else np.zeros(0, np.int32)
        wide = np.int64 if len(lengths) and starts[-1] + lengths[-1] > 2**31 - 1 else np.int32
        place = np.arange(len(stream), dtype=wide) + np.repeat(np.arange(len(lengths)) * GAP, lengths).astype(wide)
        place = place[_stable_order(stream)]
        counts = np.bincount(stream, minlength=len(self.codes))
        hashes = np.fromiter(map(term_hash, self.codes), np.uint64, len(self.codes))
        by_hash = np.argsort(hashes)
        # the postings of the terms, in order of their hashes
        first, lists = np.cumsum(counts) - counts, counts[by_hash]
        ends = np.cumsum(lists)
        take = np.repeat(first[by_hash] - (ends - lists), lists) + np.arange(len(stream))
        return {
            "segment": name, "doc_ids": self.ids, "starts": starts, "n_words": lengths, "terms": hashes[by_hash].tobytes(),
            "ends": ends.astype(np.int64).tobytes(), "positions": np.array([wide is np.int64], np.int64).tobytes() + place[take].tobytes(),
        }


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, n, segment = TaskContext.get().partitionId(), 0, Segment()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = words_of(text.as_py())
            if segment.ids and segment.words + len(words) > SEGMENT_WORDS:
                yield pa.RecordBatch.from_pylist([segment.row(f"{part}-{n}")], schema=INDEX)
                segment, n = Segment(), n + 1
            segment.add(doc_id, words)
            del words
    if segment.ids:
        yield pa.RecordBatch.from_pylist([segment.row(f"{part}-{n}")], schema=INDEX)
    del segment
    released()


def build_index(documents: DataFrame) -> DataFrame:
    """The index as a lazy table: one row for each segment, of whole documents."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_index, INDEX_DDL)


def windows_of(item_words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All distinct runs of `window` words; a shorter item, if not empty, is one window."""
    if not item_words:
        return []
    if len(item_words) < window:
        return [tuple(item_words)]
    return list(dict.fromkeys(tuple(item_words[i : i + window]) for i in range(len(item_words) - window + 1)))


class Block:
    """Benchmark items as one stream of term numbers; vocabulary: the terms' hashes, sorted. A window is a range of the stream."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        codes = _Codes()
        streams = [np.fromiter(map(codes.__getitem__, words), np.int64, len(words)) for _, words in items]
        hashes = np.fromiter(map(term_hash, codes), np.uint64, len(codes))
        by_hash = np.argsort(hashes)
        rank = np.empty(len(codes), np.int32)
        rank[by_hash] = np.arange(len(codes))
        self.vocabulary, self.ids = hashes[by_hash], [item_id for item_id, _ in items]
        self.stream = rank[np.concatenate(streams)] if streams else np.zeros(0, np.int32)
        lengths = np.array([len(s) for s in streams], np.int64)
        heads = np.cumsum(lengths) - lengths
        n = np.where(lengths > 0, np.maximum(lengths - window + 1, 1), 0)
        which = np.repeat(np.arange(len(lengths)), n)
        starts = np.repeat(heads, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(lengths, window)[which]
        # windows by their length: (length, starts in the stream, items)
        self.windows = [(int(k), starts[size == k], which[size == k]) for k in np.unique(size)]


class Postings:
    """The lists of a segment for the terms of a block."""

    def __init__(self, row: dict, block: Block) -> None:
        terms, ends = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["ends"], np.int64)
        wide = np.frombuffer(row["positions"][:8], np.int64)[0]
        positions = np.frombuffer(row["positions"], np.int64 if wide else np.int32, offset=8)
        at = np.minimum(np.searchsorted(terms, block.vocabulary), max(0, len(terms) - 1))
        there = terms[at] == block.vocabulary if len(terms) else np.zeros(len(at), bool)
        high = ends[at] if len(terms) else np.zeros(len(at), np.int64)
        low = np.where(at > 0, ends[at - 1], 0) if len(terms) else high
        self.low, self.count = low, np.where(there, high - low, 0)
        # one sorted array of (term, position), so that the lists of many terms can be searched at once
        own = np.flatnonzero(self.count)
        n = self.count[own]
        self.first = np.zeros(len(at) + 1, np.int64)
        self.first[1:] = np.cumsum(self.count)
        take = np.repeat(low[own] - self.first[own], n) + np.arange(n.sum())
        self.positions = positions[take].astype(np.int64)
        self.span = int(self.positions.max(initial=0)) + 4 * GAP
        self.keys = np.repeat(own, n) * self.span + self.positions + 2 * GAP

    def next_from(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after a place; a very large number if there is none."""
        at = np.searchsorted(self.keys, term.astype(np.int64) * self.span + place + 2 * GAP)
        inside = at < self.first[term + 1]
        return np.where(inside, self.positions[np.minimum(at, len(self.positions) - 1)], np.int64(2**62))

    def last_to(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The last posting of each term at or before a place; a very small number if there is none."""
        at = np.searchsorted(self.keys, term.astype(np.int64) * self.span + place + 2 * GAP, side="right") - 1
        inside = at >= self.first[term]
        return np.where(inside, self.positions[np.maximum(at, 0)], np.int64(-(2**62)))


def _rarest(postings: Postings, terms: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of (window, place, order): the postings of each window's rarest term, and the offsets by rarity. terms: a row for each window."""
    order = np.argsort(postings.count[terms], axis=1, kind="stable")
    rarest = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
    n = postings.count[rarest]
    pieces = np.searchsorted(np.cumsum(n), np.arange(CANDIDATES, n.sum() + CANDIDATES, CANDIDATES), side="left")
    low = 0
    for high in dict.fromkeys([*(pieces + 1).tolist(), len(n)]):
        rows = np.arange(low, min(high, len(n)))
        low = min(high, len(n))
        if len(rows):
            own = n[rows]
            which = np.repeat(rows, own)
            at = np.repeat(postings.first[rarest[rows]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            yield which, postings.positions[at], order


def phrases(postings: Postings, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, first place) of each occurrence of the windows, given as rows of terms that the segment has."""
    out = []
    for which, place, order in _rarest(postings, terms):
        place = place - order[which, 0]
        for k in range(1, terms.shape[1]):
            if not len(which):
                break
            offset = order[which, k]
            want = place + offset
            keep = (want >= 0) & (postings.next_from(terms[which, offset], np.maximum(want, 0)) == want)
            which, place = which[keep], place[keep]
        out.append((which, place))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def stretches(postings: Postings, terms: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of postings of a window's rarest term that lie in a stretch of `most` words with all its terms."""
    out = []
    for which, place, order in _rarest(postings, terms):
        for k in range(1, terms.shape[1]):
            term = terms[which, order[which, k]]
            keep = (postings.next_from(term, place) < place + most) | (postings.last_to(term, place) > place - most)
            which, place = which[keep], place[keep]
        if not len(which):
            continue
        own = terms[which]
        spread = np.repeat(place[:, None], own.shape[1], 1)
        after = postings.next_from(own.ravel(), spread.ravel()).reshape(own.shape)
        before = postings.last_to(own.ravel(), spread.ravel()).reshape(own.shape)
        best = np.full(len(which), np.int64(2**62))
        for start in [place, *before.T]:
            # terms that are not between the start and the place must come after it
            end = np.where(before >= start[:, None], spread, after).max(axis=1)
            best = np.where((start > -(2**61)) & (end < 2**61), np.minimum(best, end - start + 1), best)
        out.append((which[best <= most], place[best <= most]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def _found_in(row: dict, block: Block, slack: int | None) -> pa.RecordBatch:
    postings, starts = Postings(row, block), np.asarray(row["starts"], np.int64)
    present = np.concatenate([[0], np.cumsum(postings.count[block.stream] > 0)])
    hits: dict[int, list[np.ndarray]] = {}
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}

    def noted(to: dict[int, set[str]], slots: np.ndarray, which: np.ndarray) -> None:
        for slot, item in np.unique(np.stack([slots, which], axis=1), axis=0).tolist():
            to.setdefault(slot, set()).add(block.ids[item])

    for length, heads, which in block.windows:
        live = present[heads + length] - present[heads] == length
        heads, which = heads[live], which[live]
        if not len(heads):
            continue
        terms = block.stream[heads[:, None] + np.arange(length)]
        window, place = phrases(postings, terms)
        slots = np.searchsorted(starts, place, side="right") - 1
        noted(items, slots, which[window])
        for slot in np.unique(slots).tolist():
            own = np.unique(place[slots == slot]) - starts[slot]
            hits.setdefault(slot, []).append(np.unique(own[:, None] + np.arange(length)))
        if slack is not None:
            window, place = stretches(postings, terms, length + slack)
            noted(near, np.searchsorted(starts, place, side="right") - 1, which[window])
    n = len(starts)
    listed = lambda of: [sorted(of.get(s, ())) for s in range(n)]
    found_hits = [np.unique(np.concatenate(hits[s])) if s in hits else [] for s in range(n)]
    columns = [[row["segment"]] * n, range(n), row["doc_ids"], row["n_words"], listed(items), listed(near), found_hits]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, HITS)], schema=HITS)


def _matcher(block, slack: int | None):
    """A function for mapInArrow that finds the windows of a block (a broadcast) in segments."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _found_in(batch.slice(k, 1).to_pylist()[0], block.value, slack)

    return match


def _item_pieces(words: int, window: int):
    """Items cut to pieces of at most `words` words that share window - 1 words, so that each window is whole in one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.string()), ("words", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text")):
                own = words_of(text.as_py())
                for k in range(0, max(1, len(own) - window + 1), words) if own else ():
                    part = own[k : k + words + window - 1]
                    yield pa.RecordBatch.from_pylist([{"item_id": item_id, "words": b" ".join(part), "n": len(part)}], schema=schema)

    return cut


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about block_words words; one is on the driver at a time."""
    named = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    pieces = stored(named.mapInArrow(_item_pieces(max(1, block_words // 4), window), "item_id string, words binary, n bigint"), "items")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // block_words)
    for b in range(blocks):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b) if blocks > 1 else pieces
        yield Block([(r["item_id"], bytes(r["words"]).split(b" ")) for r in mine.select("item_id", "words").distinct().toLocalIterator()], window)
    dropped(pieces)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, slack: int | None = None) -> DataFrame:
    """For each document row: doc_id, n_words, items (sorted), near (items with a proximity match, if slack is given), hits (sorted word positions inside occurrences)."""
    if window + (slack or 0) > GAP:
        raise ValueError(f"window and slack may be {GAP} words together")
    spark, index = documents.sparkSession, stored(build_index(documents), "positional-index")
    parts: list[DataFrame] = []
    for block in blocks_of(benchmark, window, block_words):
        sent = spark.sparkContext.broadcast(block)
        parts.append(stored(index.mapInArrow(_matcher(sent, slack), HIT_DDL), "hits"))
        sent.unpersist()
    if not parts:
        parts = [stored(index.mapInArrow(_matcher(spark.sparkContext.broadcast(Block([], window)), slack), HIT_DDL), "hits")]
    dropped(index)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if len(parts) > 1:
        union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("segment", "slot").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), union("items"), union("near"), union("hits"))
    return found.select("doc_id", "n_words", "items", "near", "hits")


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold an occurrence of a benchmark window; all their columns.

    Rows are known by a number that they are given here, so rows that share an id or a text are judged one by one and no
    join brings equal texts together.
    """
    key = fresh_name(documents, "row")
    rows = stored(documents.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark)
    hit = found.where(F.size("hits") > 0).select(F.col("doc_id").alias(key))
    return rows.join(hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


def contamination_report(documents: DataFrame, benchmark: DataFrame, slack: int = SLACK) -> DataFrame:
    """The digest columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and n_near (items with a proximity match)."""
    found = contamination(documents, benchmark, slack=slack)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )

