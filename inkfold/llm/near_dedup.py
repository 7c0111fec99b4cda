"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

A document is its set of five-word shingles, all of one weight: the threshold is on sets, and weights by number would part
documents of which one repeats a line. Each shingle is a Poisson process with its weight as rate; every arrival falls on one of M registers and a register keeps the shingle that arrives first. A process
ends as soon as its next arrival is later than all registers, so long documents cost about one arrival for each shingle.
Registers agree with the documents' probability Jaccard similarity, and documents that agree on a whole band are
candidates: 25 bands of 5 miss a pair of similarity 0.8 once in 20,000.

Copies (equal word sequences) are one node from the start. In each bucket all members are paired with the bucket's most
connected member, not with each other. Pairs whose signatures may reach the threshold are verified on their shingle sets
(Jaccard similarity of at least 0.8). What is verified is merged by connected components. Then each bucket that still holds
several components is searched for links between them: its members outside its largest component are compared, on their
sets, with all others, in tasks of bounded numbers and bytes that give only the links. So a link between components is found wherever
the bands show it; members of one component are not compared again.

Null and empty texts have no words; each such row is its own class. Texts of fewer than five words are one shingle. Repeated
rows are one class. Very long texts are handled whole; a task holds one such text, or a chunk of shorter ones. Ties are broken
by the larger degree and node of a hub and by the least id of a class. An empty table gives no rows; extra columns are ignored,
and kept by keep_one() whatever their names. Rows without doc_id get the class of their text, which is null if none of its rows
has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from inkfold.llm.common import fresh_name, released, scratch, spread_join, stored, words_of
from inkfold.llm.components import components

WORDS = 5
THRESHOLD = 0.8
REGISTERS, BANDS, ROWS = 128, 25, 5
#: Signatures that agree less are not verified: five standard deviations below the threshold.
LEAST_AGREEMENT = 0.62
#: Members of a bucket that one task compares with each other or with as many; elements of their sets that are held as columns at a time.
BLOCK, COLUMNS = 2048, 4096
#: Bytes of the sets of such members.
BLOCK_BYTES = 8_000_000
#: Words that are handled at a time, and words whose hashes, or nodes whose copies, a worker keeps.
CHUNK_WORDS, CACHE = 150_000, 100_000

SIGNED = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
SIGNED_DDL = "doc_id bigint, node bigint, size bigint, bands array<bigint>, signature binary"
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def node_of(words: list[bytes]) -> int | None:
    """One number for each sequence of words; none for no words."""
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words))).astype(np.int64)) if words else None


def shingle_sets(texts: list[list[bytes]], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index, shingle hash and number of occurrences, by document and hash."""
    lengths = np.array([len(w) for w in texts], np.int64)
    total = int(lengths.sum())
    flat = np.fromiter((h for words in texts for h in map(_HASHES.__getitem__, words)), np.uint64, total)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(total) - starts[owner]
    # a text shorter than k is one shingle of all its words
    heads = np.where(lengths[owner] >= k, place <= lengths[owner] - k, place == 0) if total else np.zeros(0, bool)
    at = np.flatnonzero(heads)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = np.minimum(at + j, max(total - 1, 0))
        part = mixed(flat[inside] + _PLACES[j % len(_PLACES)] * np.uint64(1 + j // len(_PLACES)))
        value = mixed(value + np.where(j < lengths[owner[at]], part, np.uint64(0)))
    who = owner[at]
    order = np.lexsort((value, who))
    who, value = who[order], value[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return who[first], value[first], np.diff(np.concatenate([first, [len(who)]]))


def prob_minhash(who: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n x registers: the elements that arrive first. who: each element's document, below n."""
    times = np.full(n * registers, np.inf)
    keeps = np.zeros(n * registers, np.uint64)
    now, r = np.zeros(len(who)), 0
    while len(who):
        r += 1
        z = mixed(value + np.uint64((r * _GOLD) & (2**64 - 1)))
        now = now - np.log(((z >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
        cell = who * registers + (mixed(z ^ _M2) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(times, cell, now)
        won = times[cell] == now
        keeps[cell[won]] = value[won]
        # a process whose last arrival is later than all registers can change none any more
        live = now < times.reshape(n, registers).max(axis=1)[who]
        who, value, weight, now = who[live], value[live], weight[live], now[live]
    return keeps.reshape(n, registers)


def band_keys(kept: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _PLACES[0], (len(kept), 1))
    for j in range(rows):
        key = mixed(key + kept[:, j : bands * rows : rows])
    return key.astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            words = words_of(text.as_py())
            ids.append(doc_id)
            texts.append(words)
            size += len(words)
            if size >= CHUNK_WORDS or len(ids) >= 5000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    del ids, texts
    _HASHES.clear()
    released()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches):
        who, value, _ = shingle_sets(texts)
        kept = prob_minhash(who, value, np.ones(len(who)), len(texts))
        keys, short = band_keys(kept), (kept & np.uint64(255)).astype(np.uint8)
        some = [bool(w) for w in texts]
        columns = [
            ids, [node_of(w) for w in texts], np.bincount(who, minlength=len(texts)),
            [k if s else None for k, s in zip(keys, some)], [x.tobytes() if s else None for x, s in zip(short, some)],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SIGNED)], schema=SIGNED)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's set, once for all its copies in a task."""
    given: set[int] = set()
    for _, chunk in _chunks(batches):
        if len(given) > CACHE:
            given.clear()
        fresh = {n: w for n, w in ((node_of(w), w) for w in chunk if w) if n not in given}
        given.update(fresh)
        texts = list(fresh.values())
        who, value, _ = shingle_sets(texts)
        cuts = np.searchsorted(who, np.arange(len(texts) + 1))
        # 32 bits of each hash; sorted
        sets = [np.sort((value[a:b] >> np.uint64(32)).astype(np.uint32)).tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), pa.array(sets, pa.binary())], schema=SETS)


def _agreeing(least: float):
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agreement", pa.float64())])
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("x", "y"))
            share = (x == y).mean(axis=1)
            keep = share >= least
            columns = [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep)), pa.array(share[keep])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return agree


def jaccard(x: bytes, y: bytes) -> float:
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    shared = len(np.intersect1d(a, b))
    return shared / (len(a) + len(b) - shared)


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            keep = [jaccard(x.as_py(), y.as_py()) >= threshold for x, y in zip(batch.column("x"), batch.column("y"))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    return verify


def _linked(sets: list[np.ndarray], groups: np.ndarray, main: int, sides: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Index pairs of different groups, on different sides if there are two, whose sets are similar; one at least is not of main."""
    sizes = np.array([len(s) for s in sets])
    odd = np.flatnonzero(groups != main)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    # elements that one set alone has are in no intersection
    _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    keep = counts[where] > 1
    owner, where = owner[keep], (np.cumsum(counts > 1) - 1)[where[keep]]
    shared = np.zeros((len(odd), len(sets)), np.float32)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    total = int(where[-1]) + 1 if len(where) else 0
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(where, [low, low + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, total - low)), np.float32)
        block[owner[a:b], where[a:b] - low] = 1
        shared += block[odd] @ block.T
    similar = shared >= threshold * (sizes[odd][:, None] + sizes[None, :] - shared)
    similar &= groups[odd][:, None] != groups[None, :]
    if sides.any() and not sides.all():
        similar &= sides[odd][:, None] != sides[None, :]
    yield from ((int(odd[x]), int(y)) for x, y in zip(*np.nonzero(similar)))


def _across(threshold: float):
    """Links between the components of a bucket (or of two of its blocks), from rows sorted by bucket, i, j."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r["shingles"], np.uint32) for r in rows]
        groups, sides = np.array([r["component"] for r in rows]), np.array([r["block"] == r["i"] for r in rows])
        return [(rows[x]["node"], rows[y]["node"]) for x, y in _linked(sets, groups, rows[0]["main"], sides, threshold)]

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for k in range(0, batch.num_rows, 1000):
                for row in batch.slice(k, 1000).to_pylist():
                    if held and any(held[0][c] != row[c] for c in ("bucket", "i", "j")):
                        out += links(held)
                        held = []
                    held.append(row)
            yield pairs(out)
        yield pairs(links(held) if held else [])

    def pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=schema)

    return across


def _with_sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Stored pairs (a, b, ...) with column of table (node, column) for both as x and y; a may be a hub of very many."""
    one = spread_join(pairs, table.select(F.col("node").alias("a"), F.col(column).alias("x")), "a", "b")
    return one.join(table.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_node of all rows; node: one for each distinct word sequence. The table is stored."""
    with scratch() as keep:
        rows, labels = _labelled(documents, threshold, keep)
        least = spread_join(rows, keep(labels, "classes-of-nodes"), "node", "doc_id", "left").withColumn("class_node", F.coalesce("component", "node"))
        return stored(least.select("doc_id", "node", "class_node"), "classes")


def _labelled(documents: DataFrame, threshold: float, stored) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all rows and (node, component) of the linked ones, over tables that `stored` makes."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = stored(source.mapInArrow(_sign, SIGNED_DDL), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = stored(nodes, "nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(sizes, "bucket"), "buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degree, "node").select("bucket", "node", F.struct("degree", "node").alias("rank"))
    hubs = ranked.groupBy("bucket").agg(F.max("rank").alias("hub"))
    pairs = ranked.join(hubs, "bucket").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    needed = shared.select("node").distinct()
    sets = stored(source.mapInArrow(_sets, "node bigint, shingles binary").join(needed, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")

    def agreeing(pairs: DataFrame) -> DataFrame:
        return _with_sides(pairs, nodes, "signature").select("a", "b", "x", "y").mapInArrow(_agreeing(LEAST_AGREEMENT), "a bigint, b bigint, agreement double")

    def verified(pairs: DataFrame) -> DataFrame:
        return _with_sides(pairs, sets, "shingles").select("a", "b", "x", "y").mapInArrow(_verified(threshold), "a bigint, b bigint")

    # first the likeliest hub of each member, which merges most of a group
    near = stored(agreeing(stored(pairs, "pairs")), "near")
    best = stored(near.groupBy("b").agg(F.max_by("a", F.struct("agreement", "a")).alias("a")), "best")
    links = stored(verified(best), "links")
    label = stored(components(links), "labels")

    def part(df: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(label.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    # then whatever the buckets show between components
    placed = stored(part(shared.select("bucket", "node", "size"), "node", "component"), "placed")
    kinds = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed_up = kinds.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, 4 * F.col("size") / BLOCK_BYTES)).cast("int")
    inside = placed.drop("size").join(mixed_up.select("bucket", blocks.alias("blocks"), F.col("main.component").alias("main")), "bucket")
    inside = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    # members of a bucket of several blocks meet those of each other block in a task of the two
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    small = inside.where("blocks = 1").withColumn("other", F.lit(0))
    large = inside.where("blocks > 1").withColumn("other", other)
    met = small.unionByName(large).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "main", "shingles")
    more = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node").mapInArrow(_across(threshold), "a bigint, b bigint")
    return signed.select("doc_id", "node"), components(links.unionByName(more.distinct()))


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id of each row: the least doc_id of its class of near-duplicates."""
    rows = classes(documents, threshold)
    least = stored(rows.where("class_node is not null").groupBy("class_node").agg(F.min("doc_id").alias("class_id")), "least")
    worded = spread_join(rows, least, "class_node", "doc_id").select("doc_id", "class_id")
    return worded.unionByName(rows.where("class_node is null").select("doc_id", F.col("doc_id").alias("class_id")))


def _with_node(name: str):
    def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([node_of(words_of(t.as_py())) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, name])

    return noted


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents with one row of each class: the one of the least doc_id. Rows without words stay."""
    node, kept_node, kept_id = (fresh_name(documents, n) for n in ("node", "kept_node", "kept_id"))
    kept = classes(documents, threshold).where("node is not null").groupBy("class_node").agg(F.min(F.struct("doc_id", "node")).alias("k"))
    kept = stored(kept.select(F.col("k.node").alias(kept_node), F.col("k.doc_id").alias(kept_id)), "kept")
    schema = StructType([*documents.schema.fields, StructField(node, LongType())])
    noted = documents.mapInArrow(_with_node(node), schema)
    # joined by id as well, so that the rows of a very common text don't meet in one task
    same = (F.col(node) == F.col(kept_node)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(kept_id))
    one = noted.where(F.col(node).isNotNull()).join(kept, same).dropDuplicates([node])
    columns = [F.col(f"`{c}`") for c in documents.columns]
    return one.select(*columns).unionByName(noted.where(F.col(node).isNull()).select(*columns))
