import itertools

import corpus_pipeline
from inkfold.llm import decontamination, language_id, packing
from inkfold.llm.common import words_of


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf_dir, counts = "/root/testdata/sf0.001", [docs.count()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), out.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert docs.where("text like '%@mail%.example.com%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_stages_of_odd_rows(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "the and of to in is that with for as was on", "en", "s", 43), (3, "the and of to in is that with for as was on", "en", "s", 43)]
    for table in ([], rows):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_stages_equal_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages, told = dict(corpus_pipeline.STAGES), lambda df: {r.doc_id: r for r in df.collect()}
    first = told(docs)
    assert len(first) == docs.count()
    judge = language_id.Judge(language_id.train(docs.where(language_id.fold(docs.doc_id) != 2))).judge
    verdicts = {i: judge(r.text) for i, r in first.items()}
    out = stages["language_id"](spark, docs, sf_dir)
    assert {i: r.lang for i, r in told(out).items()} == {i: v[0] for i, v in verdicts.items() if not v[3]}
    docs = spark.createDataFrame(out.collect(), out.schema)

    words = {i: words_of(r.text) for i, r in told(docs).items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    top = {i: i for i in words}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in itertools.combinations(sorted(words), 2):
        if words[i] and words[j] and 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    out = stages["near_dedup"](spark, docs, sf_dir)
    assert set(told(out)) == {root(i) for i in words}
    docs = spark.createDataFrame(out.collect(), out.schema)

    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    windows = {w for r in benchmark for w in decontamination.windows_of(words_of(r.text))}
    sizes = {len(w) for w in windows}
    dirty = {i for i in told(docs) if any(tuple(words[i][k : k + n]) in windows for n in sizes for k in range(len(words[i]) - n + 1))}
    out = stages["decontamination"](spark, docs, sf_dir)
    assert set(told(out)) == set(told(docs)) - dirty and dirty
    docs = spark.createDataFrame(out.collect(), out.schema)

    out = stages["pii"](spark, docs, sf_dir)
    before, after = told(docs), told(out)
    assert set(before) == set(after) and all(r.n_chars == len(r.text) for r in after.values())
    assert any(before[i].text != r.text for i, r in after.items()) and any(before[i].text == r.text for i, r in after.items())
    docs = spark.createDataFrame(out.collect(), out.schema)

    ids = packing.Ids(packing.default_tokenizer())
    lengths = {i: len(ids.of(r.text)) // 4 for i, r in told(docs).items()}
    pieces, places = {}, {}
    for r in stages["packing"](spark, docs, sf_dir).collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces == lengths
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
