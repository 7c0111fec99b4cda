"""Approximate nearest neighbours by adaptive dimension scan over probed lists.

Vectors are rotated at random and dealt to the lists of the nearest of some centroids, which are fitted on a bounded
sample; their number follows the square root of the table's size as far as the sample allows. A query probes the lists of
its nearest centroids, so many that on the sample a share RECALL of true neighbours lies in them: few lists for vectors
in clusters, most of them for vectors without structure. At least as many lists are probed as hold k + 1 of the sample.

In a list the rotated vectors lie in blocks of columns. After each block, the partial distance, scaled to all dimensions,
is tested against the query's bound, and candidates that are significantly farther are abandoned. A query brings its
bound along: the distance of its (k + 1)-th neighbour among the sample's vectors in its lists; the bound is tightened by
the exact distances of each chunk of a list before the next one is scanned. Survivors are ranked by the exact Euclidean
distance on the original vectors in double precision.

Equal vectors are one candidate that carries its k + 1 least ids: as ties go to the smaller id, no others can be among a
query's k nearest. Lists are cut into parts of bounded size, and a query goes to each part. A part's candidates come
first in its partition and its queries follow as a stream, so memory doesn't grow with the number of queries.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor those whose length differs from
the most common one (of two, the longer). Rows without an id take no part. With fewer than k candidates a query gets all.
Repeated ids and repeated rows are rows of their own: each query row gets its neighbours, and finds every row but itself,
also rows of its own id. Very long vectors make the sample smaller. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfold.llm.common import stored

K = 10
#: Vectors that centroids are fitted on, and numbers in them, at most.
SAMPLE, SAMPLE_VALUES = 20_000, 4_000_000
#: Vectors of the sample for a list, at least.
FOR_A_LIST = 16
#: Share of true neighbours in the sample that lie in the probed lists, and queries that it is measured with.
RECALL, MEASURED = 0.97, 256
#: Vectors of one part of a list, and of a chunk after which bounds are tightened.
PART, CHUNK = 4096, 1024
#: Columns of a block, and the test's width: chance of abandoning a true neighbour falls as it grows.
BLOCK, EPSILON = 16, 2.1
#: Queries that a part is scanned for at a time; a share of live pairs from which a block is computed for all pairs.
QUERIES, DENSE = 128, 0.05

FOUND_DDL = "asked bigint, query_id bigint, vec_id bigint, score double"
FOUND = pa.schema([("asked", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
RESULT_DDL = "query_id bigint, rank int, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    """Whether all components are finite and one is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None, :] - 2 * x @ y.T, 0)


def fit(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of the sample by Lloyd's rounds."""
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centroids = distinct[np.random.default_rng(seed).choice(len(distinct), lists, replace=False)]
    for _ in range(rounds):
        nearest = assign(sample, centroids, 1)[:, 0]
        order = np.argsort(nearest, kind="stable")
        heads = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        centroids = centroids.copy()
        centroids[nearest[order][heads]] = np.add.reduceat(sample[order], heads, axis=0) / np.diff(np.append(heads, len(order)))[:, None]
    return centroids


def assign(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each vector, nearest first."""
    far = (centroids**2).sum(axis=1)[None, :] - 2 * vectors @ centroids.T
    if n == 1:
        return far.argmin(axis=1)[:, None]
    near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(np.arange(n), (len(far), 1))
    return np.take_along_axis(near, np.take_along_axis(far, near, 1).argsort(axis=1), 1)


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, seed: int = 5) -> int:
    """The number of lists that hold the share `recall` of the k nearest sample vectors of some of the sample."""
    asked = np.random.default_rng(seed).permutation(len(sample))[:MEASURED]
    far = squared(sample[asked], sample)
    far[np.arange(len(asked)), asked] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centroids)
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    rank = np.argsort(assign(sample[asked], centroids, len(centroids)), axis=1)
    ranks = np.sort(np.take_along_axis(rank, assign(sample, centroids, 1)[near, 0], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def probed_lists(queries: np.ndarray, centroids: np.ndarray, sizes: np.ndarray, probes: int, k: int) -> list[np.ndarray]:
    """Each query's nearest lists: `probes` of them, and as many more as it takes to hold k + 1 of the sample (sizes: in each list)."""
    order = assign(queries, centroids, len(centroids))
    held = np.cumsum(sizes[order], axis=1) <= k
    return [own[: max(probes, n)] for own, n in zip(order, held.sum(axis=1) + 1)]


def bounds_of(queries: np.ndarray, sample: np.ndarray, of: np.ndarray, lists: list[np.ndarray], k: int) -> np.ndarray:
    """Squared distance to the (k + 1)-th nearest of the sample that lies in a query's lists; a little more, for rounding.

    One of them may be the query itself. of: the list of each of the sample.
    """
    if len(sample) <= k:
        return np.full(len(queries), np.inf)
    probed = np.zeros((len(queries), of.max() + 1), bool)
    for row, own in zip(probed, lists):
        row[own[own < len(row)]] = True
    far = np.where(probed[:, of], squared(queries, sample), np.inf)
    return np.partition(far, k, axis=1)[:, k] * (1 + 1e-6) + 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Part:
    """Vectors of one part, rotated, in column blocks. of: the list of each."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], of: np.ndarray, turn: np.ndarray) -> None:
        self.vectors, self.ids, self.turn = vectors, ids, turn
        self.lists, self.of = np.unique(of, return_inverse=True)
        self.turned = vectors @ turn

    def search(self, queries: np.ndarray, probed: list, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in the part, distance) by query: the k + 1 nearest of its probed lists at least, within its bound."""
        allowed = np.stack([np.isin(self.lists, p) for p in probed])
        turned, bounds, out = queries @ self.turn, bounds.copy(), []
        best = np.full((len(queries), k + 1), np.inf)
        for low in range(0, len(self.vectors), CHUNK):
            rows = slice(low, min(len(self.vectors), low + CHUNK))
            query, place = self._survivors(turned, allowed[:, self.of[rows]], rows, bounds)
            gap = self.vectors[place] - queries[query]
            exact = np.einsum("ij,ij->i", gap, gap)
            out.append((query, place, exact))
            # the bound: the (k + 1)-th best so far, of which one may be the query itself
            cuts = np.searchsorted(query, np.arange(len(queries) + 1))
            for q in np.unique(query):
                best[q] = np.sort(np.concatenate([best[q], exact[cuts[q] : cuts[q + 1]]]))[: k + 1]
            bounds = np.minimum(bounds, best[:, k])
        query, place, exact = (np.concatenate(c) for c in zip(*out))
        keep = np.flatnonzero(exact <= bounds[query])
        keep = keep[np.argsort(query[keep], kind="stable")]
        return query[keep], place[keep], np.sqrt(exact[keep])

    def _survivors(self, turned: np.ndarray, live: np.ndarray, rows: slice, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place in the part), by query, of those among rows that no block's test abandons."""
        dims = turned.shape[1]
        partial: np.ndarray | None = np.zeros(live.shape)
        pairs: tuple[np.ndarray, np.ndarray] | None = None
        held = np.zeros(0)
        for start in range(0, dims, BLOCK):
            columns = slice(start, min(dims, start + BLOCK))
            own, asked, seen = self.turned[rows, columns], turned[:, columns], min(dims, start + BLOCK)
            # distance of the first dimensions, scaled, against the bound: reject if it is larger beyond chance
            most = bounds * (1 + EPSILON / np.sqrt(seen)) ** 2 * (seen / dims) if seen < dims else bounds * (1 + 1e-9) + 1e-12
            if pairs is None:
                partial += squared(asked, own)
                live = live & (partial <= most[:, None])
                if live.mean() < DENSE or seen == dims:
                    pairs = np.nonzero(live)
                    held = partial[pairs]
            else:
                gap = own[pairs[1]] - asked[pairs[0]]
                held = held + np.einsum("ij,ij->i", gap, gap)
                keep = held <= most[pairs[0]]
                pairs, held = (pairs[0][keep], pairs[1][keep]), held[keep]
        return pairs[0], pairs[1] + rows.start


def _scan(turn: np.ndarray, k: int):
    """Neighbours from rows sorted by region, part and kind: a part's candidates (kind 0), then its queries (kind 1)."""

    def found(part: Part, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        queries, ids = matrix(rows.column("vector")), rows.column("query_id").to_pylist()
        query, place, score = part.search(queries, rows.column("lists").to_pylist(), rows.column("bound").to_numpy(), k)
        out: list[tuple[int, int, int, float]] = []
        asked = rows.column("asked").to_pylist()
        cuts = np.searchsorted(query, np.arange(len(ids) + 1))
        for q in np.unique(query).tolist():
            own = slice(cuts[q], cuts[q + 1])
            near: list[tuple[float, int]] = []
            for p, d in zip(place[own].tolist(), score[own].tolist()):
                of = list(part.ids[p])
                if d == 0 and ids[q] in of:
                    of.remove(ids[q])  # the query's own row
                near += [(d, i) for i in of]
            out += [(asked[q], ids[q], i, d) for d, i in sorted(near)[:k]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 4, FOUND)], schema=FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, part = None, [], None
        for batch in batches:
            region, of, kind = (batch.column(c).to_numpy() for c in ("region", "part", "kind"))
            cuts = np.flatnonzero((np.diff(region) != 0) | (np.diff(of) != 0) | (np.diff(kind) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if i == j:
                    continue
                rows = batch.slice(i, j - i)
                if key != (region[i], of[i]):
                    key, held, part = (region[i], of[i]), [], None
                if kind[i] == 0:
                    held.append((matrix(rows.column("vector")), rows.column("ids").to_pylist(), rows.column("list").to_numpy()))
                elif held:
                    if part is None:
                        part = Part(np.concatenate([h[0] for h in held]), [x for h in held for x in h[1]], np.concatenate([h[2] for h in held]), turn)
                    for low in range(0, rows.num_rows, QUERIES):
                        yield from found(part, rows.slice(low, QUERIES))

    return scan


def _candidates(sent, region_of: np.ndarray, parts: np.ndarray):
    """Candidates (vector, ids) with their list, region and part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = assign(matrix(batch.column("vector")), sent.value[0], 1)[:, 0]
                region = region_of[lists]
                part = np.abs(batch.column("digest").to_numpy() % parts[region])
                extra = [pa.array(c.astype(np.int32)) for c in (lists, region, part)]
                yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("ids"), *extra], names=["vector", "ids", "list", "region", "part"])

    return deal


def _asking(sent, region_of: np.ndarray, parts: np.ndarray, probes: int, k: int):
    """Queries (asked, query_id, vector) with their lists, their bound and the parts they go to, as region << 32 | part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sample, of = sent.value
        sizes = np.bincount(of, minlength=len(centroids))
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                queries = matrix(batch.column("vector"))
                lists = probed_lists(queries, centroids, sizes, probes, k)
                bounds = bounds_of(queries, sample, of, lists, k)
                goes = [[int(r) << 32 | p for r in np.unique(region_of[own]).tolist() for p in range(parts[r])] for own in lists]
                extra = [pa.array([own.tolist() for own in lists], pa.list_(pa.int32())), pa.array(bounds), pa.array(goes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lists", "bound", "goes"])

    return deal


def search(vectors: DataFrame, queries: Column, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row where `queries` holds."""
    spark = vectors.sparkSession
    clean = vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    clean = clean.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).alias("vector"), queries.alias("asks"))
    kind = clean.schema["vector"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        kind, clean = "double", clean.withColumn("vector", F.col("vector").cast("array<double>"))
    common = clean.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], RESULT_DDL)
    dims = common["dims"]
    fits = clean.where(F.size("vector") == dims)
    # equal vectors become one candidate with its k + 1 least ids; ranks above that are cut before the shuffle as well
    order = Window.partitionBy("vector").orderBy("id")
    least = fits.select("vector", "id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    distinct = least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = stored(distinct.withColumn("digest", F.xxhash64("vector")), "vectors")
    total, rows = distinct.count(), max(64, min(SAMPLE, SAMPLE_VALUES // dims))
    # a sample by hash, bounded whatever the number of rows
    drawn = distinct.where(F.pmod(F.xxhash64("digest"), F.lit(-(-total // rows))) == 0).orderBy("digest").limit(rows).select("vector").toArrow()
    sample = matrix(drawn.column("vector").combine_chunks())
    if not len(sample):  # few rows, and none that the hash takes
        sample = matrix(distinct.orderBy("digest").limit(rows).select("vector").toArrow().column("vector").combine_chunks())
    lists = int(max(1, min(2 * total**0.5, len(sample) // FOR_A_LIST)))
    centroids, turn = fit(sample, lists), rotation(dims)
    probes = probes_for(sample, centroids, k, recall)
    # small lists share a region and large ones are cut into parts, as the sample tells their sizes
    of = assign(sample, centroids, 1)[:, 0]
    sizes = np.bincount(of, minlength=len(centroids)) * (total / len(sample))
    region_of = (np.cumsum(sizes) - sizes).astype(np.int64) // PART
    region_of = np.unique(region_of, return_inverse=True)[1]
    parts = np.maximum(1, np.ceil(np.bincount(region_of, weights=sizes) / (2 * PART))).astype(np.int64)
    sent = spark.sparkContext.broadcast((centroids, sample, of))  # bounded by SAMPLE_VALUES

    candidates = distinct.mapInArrow(_candidates(sent, region_of, parts), f"vector array<{kind}>, ids array<bigint>, list int, region int, part int")
    asked = fits.where("asks").select(F.monotonically_increasing_id().alias("asked"), F.col("id").alias("query_id"), "vector")
    schema = f"asked bigint, query_id bigint, vector array<{kind}>, lists array<int>, bound double, goes array<bigint>"
    asked = stored(asked.mapInArrow(_asking(sent, region_of, parts, probes, k), schema), "queries")
    sent_to = asked.select("asked", "query_id", "vector", "lists", "bound", F.explode("goes").alias("goes"))
    sent_to = sent_to.withColumns({"region": F.shiftright("goes", 32).cast("int"), "part": F.col("goes").bitwiseAND(0xFFFFFFFF).cast("int"), "kind": F.lit(1)}).drop("goes")
    both = candidates.withColumn("kind", F.lit(0)).unionByName(sent_to, allowMissingColumns=True)
    found = both.repartition("region", "part").sortWithinPartitions("region", "part", "kind").mapInArrow(_scan(turn, k), FOUND_DDL)
    best = Window.partitionBy("asked").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
