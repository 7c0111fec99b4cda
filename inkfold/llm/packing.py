"""Packing documents into training sequences by bounded-space online best-fit.

A packer keeps a fixed number of open sequences. A bitset has bit f set where some open sequence has f tokens free; the
lowest bit from a piece's length on is the best fit, found by one shift and mask. If no open sequence fits and the
number is reached, the fullest is closed and a new one opened. Each task packs the pieces of its own partition as they
come. What is still open at its end is packed once more, longest piece first, by far fewer tasks, so that the loss does
not grow with the number of partitions.

A null text counts as empty: its document is the single id 0. Very long texts are encoded whole and cut into pieces, of
which all but the last fill a sequence. Of open sequences with equal room the latest is taken. An empty table gives no
rows. Repeated rows are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkfold.llm.common import released, stored

CAPACITY = 2048
OPEN = 512
#: Open pieces that one task of the second round packs, on average.
SECOND_ROUND = 100_000
#: Cached chunks of a worker; then the cache starts anew.
CACHE = 200_000

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32())]
    + [(n, pa.int64()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]
    + [("open", pa.bool_())]
)
PIECES_DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, open boolean"
#: A chunk of Latin-1 letters and perhaps one mark is split by rule; NFC and lower-casing leave it as it is.
PLAIN = re.compile("([a-zß-öø-ÿ]*)([.,;:!?]?)")


class BestFit:
    """place(length) gives (sequence number, offset)."""

    def __init__(self, capacity: int = CAPACITY, bins: int = OPEN) -> None:
        self.capacity, self.bins, self.n, self.next, self.bits = capacity, bins, 0, 0, 0
        self.free: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.n >= self.bins and length < self.capacity:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.n -= 1
            room, number = self.capacity, self.next
            self.next += 1
            self.n += 1
        if room - length:
            self.free.setdefault(room - length, []).append(number)
            self.bits |= 1 << (room - length)
        else:
            self.n -= 1
        return number, self.capacity - room

    def _take(self, room: int) -> int:
        own = self.free[room]
        number = own.pop()
        if not own:
            self.bits &= ~(1 << room)
        return number

    def still_open(self) -> set[int]:
        return {x for own in self.free.values() for x in own}


class Ids(dict):
    """The ids of each chunk of text between white space, as little-endian unsigned 32-bit numbers.

    Words of a file whose tokens all encode to themselves are merged by byte ranks: before a pair is merged, all pairs of
    lower rank inside it have been, as in the token alone, so both ways merge the same pairs. The check runs once in each
    worker; if it fails, and for any chunk that isn't plain, the tokenizer itself encodes.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        import json

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.symbols = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.merge = self._ranked(spec["model"])

    def _ranked(self, model: dict):
        """A function from a word to its ids, or None if ranks may not stand for the merges."""
        import tiktoken

        vocab, rules = model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        merged = {a + b: (a, b) for a, b in rules}
        numbers = [vocab[a + b] for a, b in rules]
        bare = {vocab[s + e] for s in self.symbols.values() for e in ("", "</w>")}
        if model.get("end_of_word_suffix") != "</w>" or numbers != sorted(numbers) or max(bare) >= numbers[0]:
            return None
        back, ranks = {s: b for b, s in self.symbols.items()}, {}
        for token, number in vocab.items():
            if number in bare or token in merged:
                end = token.endswith("</w>")
                body = token[:-4] if end else token
                parts = [*body[:-1], body[-1] + "</w>" * end]
                if not self._reaches(token, parts, merged, vocab):
                    return None
                ranks[bytes(back[c] for c in body) + b"\n" * end] = number
        return tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _reaches(token: str, parts: list[str], merged: dict, vocab: dict) -> bool:
        """Whether merging the token's own symbols by rank gives the token."""
        while len(parts) > 1:
            pairs = [(vocab[a + b], a, b) for a, b in zip(parts, parts[1:]) if merged.get(a + b) == (a, b)]
            if not pairs:
                return False
            _, a, b = min(pairs)
            out: list[str] = []
            for part in parts:
                if out and out[-1] == a and part == b:
                    out[-1] = a + b
                else:
                    out.append(part)
            parts = out
        return parts == [token]

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text.lower()) if self.merge else None
        if plain:
            word, mark = plain.groups()
            ids = self.merge(word + "\n") if word else []
            if mark:
                ids = ids + self.merge(mark + "\n")
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        if len(self) >= CACHE:
            self.clear()
        self[chunk] = out = np.array(ids, "<u4").tobytes()
        return out

    def of(self, text: str | None) -> bytes:
        """The document's ids and the final 0."""
        raw = (text or "").encode("utf-8", "replace")
        chunks = raw.split() if b"<|" in raw else raw.lower().split()
        return b"".join(map(self.__getitem__, chunks)) + b"\0\0\0\0"


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pack(tokenizer: str | None, capacity: int, bins: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, packer, held = _ids(tokenizer or default_tokenizer()), BestFit(capacity, bins), []
        base = TaskContext.get().partitionId() << 32
        step = 4 * capacity
        for batch in batches:
            rows = held
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = ids.of(text.as_py())
                for k in range(0, len(raw), step):
                    piece = raw[k : k + step]
                    number, offset = packer.place(len(piece) // 4)
                    rows.append((doc_id, k // step, k // 4, len(piece) // 4, zlib.crc32(piece), base + number, offset))
            opened = {base + n for n in packer.still_open()}
            held = [r for r in rows if r[5] in opened]
            yield _batch([r for r in rows if r[5] not in opened], False)
        yield _batch(held, True)
        ids.clear()
        released()

    return pack


def _batch(rows: list[tuple], opened: bool) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * (len(PIECES) - 1)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [opened] * len(rows)], PIECES)], schema=PIECES)


def _repack(capacity: int, bins: int):
    def repack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, base = BestFit(capacity, bins), (TaskContext.get().partitionId() << 32) + (1 << 62)
        for batch in batches:
            placed = [packer.place(n) for n in batch.column("length").to_pylist()]
            new = [pa.array([base + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new, batch.column("open")], schema=PIECES)

    return repack


def pack(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, bins: int = OPEN) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    first = stored(source.mapInArrow(_pack(tokenizer, capacity, bins), PIECES_DDL), "packed")
    rest = first.where("open")
    tasks = max(1, -(-rest.count() // SECOND_ROUND))
    again = (
        rest.repartition(tasks, "doc_id", "piece", "sequence_id", "offset")
        .sortWithinPartitions(F.desc("length"), "doc_id", "piece", "sequence_id", "offset")
        .mapInArrow(_repack(capacity, bins), PIECES_DDL)
    )
    return first.where("not open").unionByName(again).drop("open")
