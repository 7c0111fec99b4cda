import collections
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkfold.llm import ann, common, near_dedup, substring_dedup
from inkfold.llm.common import words_of
from inkfold.llm.components import components


def docs(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts, start)], "doc_id bigint, text string, node string")


def made(rng, n):
    return ["".join(rng.choices(["th", "er", "on", "ing", "é", "at"], k=rng.randint(1, 5))) for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] = "edit" + str(rng.randint(0, 10**9))
    return words


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)  # several blocks for a bucket
    rng = random.Random(7)
    base = [made(rng, 120) for _ in range(12)] + [made(rng, 3)]
    texts = [" ".join(edited(rng, b, rng.choice([0, 1, 2, 3, 6])) if len(b) > 5 else b) for b in base for _ in range(6)]
    texts += [None, "", "...", "One two", "one, TWO"] + [texts[0]] * 3
    rng.shuffle(texts)
    words = [words_of(t) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if words[i] and words[j] and (words[i] == words[j] or jaccard(words[i], words[j]) >= 0.8):
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    rows = near_dedup.near_duplicates(docs(spark, texts)).collect()
    assert sorted((r.doc_id, r.class_id) for r in rows) == [(i, top(i)) for i in range(len(texts))]
    kept = near_dedup.keep_one(docs(spark, texts).drop("node").unionByName(docs(spark, texts[:5]).drop("node"))).collect()
    expected = {top(i) for i in range(len(texts))}
    worded = [r.doc_id for r in kept if words_of(r.text)]
    assert sorted(worded) == sorted(i for i in expected if words[i])


def test_empty_table_has_no_classes(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert substring_dedup.passages(docs(spark, [])).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    value = rng.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = np.ones(300), np.ones(300)
    wb[:60] = 4.0
    union = lambda d: np.maximum(wa / wa[d], wb / wb[d]).sum()
    true = sum(1 / union(d) for d in range(300))
    who = np.zeros(300, np.int64)
    kept = [near_dedup.prob_minhash(who, value, w, 1, 4096)[0] for w in (wa, wb)]
    assert abs((kept[0] == kept[1]).mean() - true) < 0.03


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (20, 21)] + [(100, n) for n in range(101, 140)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    tops = {r.node: r.component for r in rows}
    assert len(rows) == len(tops) and [tops[n] for n in (1, 2, 3, 7, 8, 9, 20, 21, 139)] == [1, 1, 1, 7, 7, 7, 20, 20, 100]


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32)) * 3
    vectors = [(centres[i % 20] + rng.standard_normal(32)).astype("float32").tolist() for i in range(1500)]
    vectors += [vectors[0]] * 30 + [None, [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] * 32, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, score string")
    rows = ann.search(df, F.col("vec_id") % 100 == 0).collect()
    good = [i for i, v in enumerate(vectors) if v and len(v) == 32 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    matrix = np.array([vectors[i] for i in good], np.float64)
    hits = total = 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.query_id].append(r)
    assert set(by) == {i for i in good if i % 100 == 0}
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        far = np.sqrt(((matrix - np.array(vectors[q], np.float64)) ** 2).sum(axis=1))
        true = [i for _, i in sorted((d, i) for d, i in zip(far.tolist(), good) if i != q)[:10]]
        hits += len(set(true) & {r.vec_id for r in own})
        total += 10
        for r in own:
            assert abs(r.score - far[good.index(r.vec_id)]) < 1e-9
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
    assert hits / total >= 0.9
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    few = ann.search(df.limit(4), F.col("vec_id") == 0).collect()
    assert len(few) == 3


def test_neighbours_of_rows_that_share_an_id(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(0, vectors[5]), (0, vectors[0]), (7, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = ann.search(df, F.col("vec_id") == 0, k=4).collect()
    expected = []
    for at, (i, v) in enumerate(rows):
        if i == 0:
            others = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for n, (j, w) in enumerate(rows) if n != at)
            expected += [(0, rank, j, round(d, 9)) for rank, (d, j) in enumerate(others[:4], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found) == sorted(expected)


@pytest.mark.parametrize("clusters", [0, 300])
def test_recall_of_neighbours(spark, clusters, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 4000)
    monkeypatch.setattr(ann, "PART", 512)
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((20_000, 24)).astype("float32")
    if clusters:
        vectors = vectors * 0.4 + rng.standard_normal((clusters, 24)).astype("float32")[rng.integers(0, clusters, len(vectors))] * 2
    table = pa.table({"vec_id": pa.array(range(len(vectors))), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))})
    rows = ann.search(spark.createDataFrame(table), F.col("vec_id") % 100 == 0).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.query_id].add(r.vec_id)
    hits = 0
    matrix = vectors.astype(np.float64)
    for q in range(0, len(vectors), 100):
        far = ((matrix - matrix[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(by[q] & set(np.argsort(far)[:10].tolist()))
    assert hits / (10 * len(vectors) / 100) >= 0.9


def test_passages(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 600)
    rng = random.Random(11)
    shared = made(rng, 70)
    line = made(rng, 12)
    texts = []
    for i in range(12):
        body = [f"u{i}x{j}" for j in range(150)]
        if i < 5:
            body[30:30] = edited(rng, shared, 2 if i == 3 else 0)
        texts.append(" ".join(line + body))
    texts += [None, "", "short", texts[0], texts[11]]
    rows = substring_dedup.passages(docs(spark, texts)).collect()
    found = {r.doc_id for r in rows if r.kind == "passage"} | {r.other_doc_id for r in rows if r.kind == "passage"}
    assert found == {0, 1, 2, 3, 4}
    assert {(r.doc_id, r.other_doc_id) for r in rows if r.kind == "copy"} == {(15, 0), (16, 11)}
    # a document's spans, over all its partners, cover the passage and nothing else
    for doc_id in (0, 1, 2, 4):
        spans = [(r.start, r.end) for r in rows if r.kind == "passage" and r.doc_id == doc_id]
        spans += [(r.other_start, r.other_end) for r in rows if r.kind == "passage" and r.other_doc_id == doc_id]
        assert {w for low, high in spans for w in range(low, high)} == set(range(42, 112))


def test_chains_equal_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        seeds = sorted({(rng.randint(0, 25), rng.randint(0, 25)) for _ in range(rng.randint(1, 9))})
        best = 0.0
        for n in range(1, len(seeds) + 1):
            for part in itertools.combinations(seeds, n):
                if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(part, part[1:])):
                    cost = sum(substring_dedup.GAP_COST * (q[0] - p[0] + q[1] - p[1]) for p, q in zip(part, part[1:]))
                    best = max(best, n * substring_dedup.K - cost)
        chains = substring_dedup.chains_of([a for a, _ in seeds], [b for _, b in seeds])
        cost = lambda c: sum(substring_dedup.GAP_COST * (q[0] - p[0] + q[1] - p[1]) for p, q in zip(c, c[1:]))
        assert max(len(c) * substring_dedup.K - cost(c) for c in chains) == pytest.approx(best)
        assert sorted(s for c in chains for s in c) == seeds


def uncovered(texts, rows):
    """Runs of MIN_WORDS words that another text has too and that no row covers."""
    n, holders = substring_dedup.MIN_WORDS, collections.defaultdict(set)
    words = [words_of(t) for t in texts]
    for i, own in enumerate(words):
        for at in range(len(own) - n + 1):
            holders[tuple(own[at : at + n])].add(i)
    spans = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.end))
        spans[r.other_doc_id].append((r.other_start, r.other_end))
        same = sum(a == b for a, b in zip(words[r.doc_id][r.start : r.end], words[r.other_doc_id][r.other_start : r.other_end]))
        assert r.identity < 1 or same == r.end - r.start == r.other_end - r.other_start
    return [
        (i, at) for i, own in enumerate(words) for at in range(len(own) - n + 1)
        if len(holders[tuple(own[at : at + n])]) > 1 and not any(low <= at and at + n <= high for low, high in spans[i])
    ]


@pytest.mark.parametrize("block", [600, 1_000_000])
def test_passages_of_frequent_lines_and_overlapping_excerpts(spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    monkeypatch.setattr(substring_dedup, "RUN_WORDS", block, raising=False)
    rng = random.Random(5)
    lines = [made(rng, 15) for _ in range(4)]
    source = made(rng, 400)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    bodies = [fresh(60) + line + fresh(60) for line in lines for _ in range(12)]  # each line in other texts
    bodies += [fresh(60) + sum(lines, []) + fresh(60) for _ in range(4)]
    bodies += [fresh(30) + source[at : at + rng.randint(45, 120)] + fresh(30) for at in range(0, 280, 13)]
    twice = made(rng, 46)
    bodies += [twice + fresh(60) + twice, fresh(60) + twice]  # the first text has it again
    rng.shuffle(bodies)
    texts = [" ".join(b) for b in bodies]
    assert uncovered(texts, substring_dedup.passages(docs(spark, texts)).collect()) == []


def test_line_that_a_text_repeats_gives_few_rows(spark):
    rng = random.Random(8)
    line, fresh = made(rng, 13), lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    bodies = [fresh(50) + line * 300 + fresh(50), fresh(20) + line * 40 + fresh(70) + line * 60, fresh(90) + line * 5, fresh(300), fresh(40) + made(rng, 60) * 3]
    texts = [" ".join(b) for b in bodies]
    rows = substring_dedup.passages(docs(spark, texts)).collect()
    assert uncovered(texts, rows) == [] and len(rows) < 20
    assert {r.doc_id for r in rows} | {r.other_doc_id for r in rows} == {0, 1, 2}
    for r in rows:
        if r.kind == "repeat":
            own = words_of(texts[r.doc_id])
            assert r.doc_id == r.other_doc_id and r.other_start < r.start and own[r.start : r.end] == own[r.other_start : r.other_end]


def test_exact_parts_of_a_chain_that_differs_too_much():
    one, two = ([f"{p}{i}" for i in range(50)] for p in "ab")
    x, y = one + [f"x{i}" for i in range(30)] + two, one + [f"y{i}" for i in range(30)] + two
    chain = [(i, i) for i in (*range(0, 44, 4), *range(80, 124, 4))]
    assert substring_dedup.align(x, y, chain)[4] < 0.8
    assert substring_dedup.kept(x, y, chain) == [(0, 50, 0, 50, 1.0), (80, 130, 80, 130, 1.0)]


def test_repeated_line_keeps_the_signature():
    rng = random.Random(4)
    line, rest = made(rng, 18), made(rng, 54)
    texts = [" ".join(rest + line * n) for n in (2, 50)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "text": texts})
    (signed,) = near_dedup._sign(iter([batch]))
    assert jaccard(*map(words_of, texts)) == 1
    assert signed.column("bands")[0] == signed.column("bands")[1] and signed.column("signature")[0] == signed.column("signature")[1]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_join(spark, how, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    keys = [7] * 60 + [8] * 25 + [None] * 30 + list(range(20, 40)) + [7]
    big = spark.createDataFrame([(k, i, -i) for i, k in enumerate(keys)], "key long, id long, task long")
    small = spark.createDataFrame([(k, f"s{k}") for k in [7, 8, *range(20, 30), 99]], "key long, name string")
    got = common.spread_join(big, small, "key", "id", how)
    assert got.columns == ["key", "id", "task", "name"]
    assert sorted(map(str, got.collect())) == sorted(map(str, big.join(small, "key", how).select(got.columns).collect()))
    assert common.spread_join(big.limit(0), small, "key", "id", how).count() == 0
