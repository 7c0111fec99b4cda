import datetime as dt
import io
import random
import zipfile

from pyspark.sql import functions as F

from inkfold.functions import html
from inkfold.operators import keywords as kw, layout, ledger, news, storage
from inkfold.sources import sinks, text_layer
from inkfold.streaming.keyword_stream import windowed_counts


def line(b, r, i, z, unread=(), named=False, ord=0):
    return {"ord": ord, "named": named, "balance_brought": b, "received": r, "issued": i, "balance": z, "unread": list(unread), "notes": []}


def figures(lines):
    return [(x["balance_brought"], x["received"], x["issued"], x["balance"]) for x in ledger.reconcile_page(lines)]


def test_reconcile_fills_what_arithmetic_gives():
    assert figures([line(450, None, 40, None, ["balance"])]) == [(450, None, 40, 410)]
    assert figures([line(None, None, 40, None, ["balance_brought", "balance"])]) == [(None, None, 40, None)]
    assert figures([line(10, None, 40, None, ["balance"])]) == [(10, None, 40, None)]
    assert figures([line(450, None, 40, 410), line(None, None, 10, 400, ["balance_brought"])])[1] == (410, None, 10, 400)
    assert figures([line(450, None, 40, 410), line(None, None, None, 380)])[1] == (None, None, 30, 380)
    assert figures([line(450, None, 40, 410), line(None, None, None, 380, named=True)])[1] == (None, None, None, 380)
    noted = ledger.reconcile_page([line(1, 1, None, 5)])[0]
    assert noted["notes"] == ["the figures do not add up"]


def test_settle_dates(spark):
    day = dt.date
    rows = [
        (1, 1, 0, "1/3/69", day(2026, 3, 1), True), (1, 1, 1, "287376", None, False), (1, 1, 2, "1/4/69", day(2026, 4, 1), True), (1, 1, 3, "2/3/69", day(2026, 3, 2), True),
        (1, 2, 0, "5x", None, False), (1, 2, 1, "3-31", None, True), (2, 1, 0, "7", None, False),
    ]
    df = spark.createDataFrame([(*r, []) for r in rows], "doc int, page int, ord int, date_text string, entry_date date, date_certain boolean, notes array<string>")
    out = {(r.doc, r.page, r.ord): r.entry_date for r in ledger.settle_dates(df, "doc", "page").collect()}
    assert out == {(1, 1, 0): day(2026, 3, 1), (1, 1, 1): day(2026, 3, 28), (1, 1, 2): None, (1, 1, 3): day(2026, 3, 2), (1, 2, 0): day(2026, 3, 5), (1, 2, 1): None, (2, 1, 0): None}


def test_possible_day_equals_the_fold(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choices("0123456789", k=rng.randint(0, 5))), rng.randint(1, 20), rng.choice([1, 3, 5, 10])) for _ in range(200)]
    df = spark.createDataFrame(rows, "t string, b int, m int")
    df = df.select("t", "b", "m", ledger.possible_day(F.col("t"), F.col("b"), F.col("m")).alias("d"), ledger.day_readings(F.col("t"), F.col("m")).alias("r"))
    for r in df.collect():
        above = {"entry_date": dt.date(2026, 1, r.b), "__range": False, "__year": 2026, "__in": r.m, "__days": [], "notes": []}
        line = {"entry_date": None, "__range": False, "__year": 2026, "__in": r.m, "__days": [x.asDict() for x in r.r], "notes": []}
        got = ledger.recover_days([above, line])[1]["entry_date"]
        assert got == (None if r.d is None else dt.date(2026, r.m, r.d))


def test_movements_need_their_column_and_reviews_follow_the_notes(spark):
    lines = [line(450, None, 40, 410), {**line(None, None, None, 380), "roles": ["date", "received"]}]
    assert figures(lines)[1] == (None, None, None, 380)
    rows = [(1, 0, "1/3/69", dt.date(2026, 3, 1), True, [], False), (1, 1, "", None, False, ["date could not be read"], True), (1, 2, "", None, False, ["date could not be read", "x"], True)]
    df = spark.createDataFrame(rows, "p int, ord int, date_text string, entry_date date, date_certain boolean, notes array<string>, needs_review boolean")
    assert [r.needs_review for r in ledger.carry_dates(df, ["p"], ["ord"]).orderBy("ord").collect()] == [False, False, True]


def test_overlaps_in_arrays_equal_a_loop(spark):
    rng = random.Random(9)
    rows = [(n, [(s, s + rng.randint(1, 9), rng.randint(0, 3)) for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 12)))]) for n in range(100)]
    df = spark.createDataFrame(rows, "n int, s array<struct<start:int,end:int,kw:int>>")
    got = {r.n: [tuple(x) for x in r.k] for r in df.select("n", kw.resolved(F.col("s")).alias("k")).collect()}
    for n, spans in rows:
        covered, kept = -1, []
        for s in sorted(spans, key=lambda x: (x[0], -x[1], x[2])):
            if s[1] > covered:
                kept.append(s)
                covered = s[1]
        assert got[n] == kept


def test_clusters(spark):
    rows = [(1, 0, 100.0, 20.0, 0), (1, 1, 108.0, 20.0, 1), (1, 2, 300.0, 20.0, 0), (2, 0, 100.0, 20.0, 3), (2, 1, 108.0, 20.0, 3)]
    df = spark.createDataFrame(rows, "page int, ord int, cy double, height double, col int")
    assert sorted((r.page, r.ord, r.line) for r in layout.clusters(df, ["page"], 0.6).collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 1)]


def test_ruled_edges(spark):
    row = spark.range(1).select(
        layout.ruled_edges(F.array(*map(F.lit, [0.0, 10.0, 20.0])), F.array(F.lit(5.0), F.lit(15.0))).alias("a"), layout.ruled_edges(F.array(F.lit(0.0), F.lit(10.0)), F.array(F.lit(5.0))).alias("b")
    ).first()
    assert [tuple(x) for x in row.a] == [(0.0, 10.0), (10.0, 20.0)] and row.b is None


PAGE = """<html><head><title>A very long headline about recalls | Agency</title><meta property="article:published_time" content="2025-10-07T10:00:00Z">
<link rel="next" href="?page=2"></head><body><nav><a href="/news/menu-entry-that-is-long">Menu</a></nav><article><h1>Short</h1><p>First <b>part</b>.</p><script>x()</script></article>
<a href="/news/2025/10/some-article#top">Some article</a><a href="https://other.org/news/2025/10/elsewhere-long">No</a><script>var u = "\\/news\\/2025\\/10\\/from-a-script";</script></body></html>"""


def test_page_parts():
    page = html.parsed(PAGE)
    found = html.links(page, "https://a.org/news/")
    assert [(x["url"], x["found_in"]) for x in found] == [("https://a.org/news/2025/10/some-article", "anchor"), ("https://a.org/news/2025/10/from-a-script", "script")]
    assert html.article_title(page) == "A very long headline about recalls"
    assert html.next_page(page, "https://a.org/news/") == "https://a.org/news/?page=2"
    assert html.date_candidates(page) == ["2025-10-07T10:00:00Z"]
    menu = html.parsed('<nav><a href="/news/menu-entry-that-is-long">Menu</a></nav>')
    assert [x["url"] for x in html.links(menu, "https://a.org/")] == ["https://a.org/news/menu-entry-that-is-long"]
    assert html.links(html.parsed(None), "https://a.org/") == []


def test_articles_choose_text_and_date(spark):
    ddl = "url string, title string, title_from string, summary string, published string, full_text boolean"
    rows = [
        ("https://a.org/1", None, "feed", "s", "Tue, 07 Oct 2025 10:20:30 GMT", True), ("https://a.org/2025/10/x.pdf", "T", "feed", None, None, True), ("https://a.org/3", "T", "feed", "s", None, True),
        ("https://a.org/2025/10/4", "Read on", "anchor", None, None, True), ("https://a.org/5", "T", "feed", "s", None, False), ("https://a.org/6", "T", "feed", None, None, True),
    ]
    pages = spark.createDataFrame(
        [("https://a.org/1", "Page", "body", None, "text/html", None), ("https://a.org/3", "P", "b", None, "image/png; x", None), ("https://a.org/2025/10/4", "Long", "text", None, None, None), ("https://a.org/6", None, None, None, None, "blocked: 403")],
        "url string, title string, text string, published timestamp, content_type string, error string",
    )
    got = {r.url[-1]: r for r in news.articles(spark.createDataFrame(rows, ddl), pages).collect()}
    assert (got["1"].title, got["1"].text_source, got["1"].published_at_source, got["1"].error) == ("Page", "article", "feed", None)
    assert (got["f"].text_source, got["f"].published_at_source, got["f"].text) == ("skipped_document", None, None)
    assert (got["3"].text_source, got["3"].title, got["3"].published_at, got["3"].error) == ("skipped_document", "T", None, "content-type image/png")
    assert (got["4"].title, got["4"].published_at_source, got["4"].published_at.month) == ("Long", "url_path", 10)
    assert (got["5"].text_source, got["5"].text) == ("rss_summary", None)
    assert (got["6"].text_source, got["6"].error) == ("none", "blocked: 403")


def test_pages_that_try_to_fail_a_task():
    deep = '<script type="application/ld+json">' + '{"a":' * 20000 + "1" + "}" * 20000 + "</script><p>text</p>"
    page = html.parsed(deep)
    assert html.date_candidates(page) == [] and html.article_text(page) == "text"
    broken = html.parsed('<a href="http://[x">a</a><a href="/news/some-long-enough-path">b</a><![bad')
    assert html.links(broken, "http://[x") == [] and html.next_page(broken, "http://[x") is None and html.feeds(broken, "http://[x") == []
    assert [x["url"] for x in html.links(broken, "https://a.org/")] == ["https://a.org/news/some-long-enough-path"]
    assert html.feed_items("<rss>" + "<a>" * 5000) == []


def test_page_rules():
    label = lambda t: html.next_page(html.parsed(f'<a href="/x">no</a><a href="/p2">{t}</a>'), "https://e.org/news")
    assert {label(t) for t in ("Next", "ถัดไป", "หน้าต่อไป", "→", "next &gt;", "›")} == {"https://e.org/p2"}
    assert label("What comes next for drug policy") is None
    meta = lambda *m: html.date_candidates(html.parsed("".join(f'<meta {k}="{v}" content="{c}">' for k, v, c in m)))
    assert meta(("property", "og:updated_time", "9"), ("name", "dcterms.date", "2"), ("name", "dcterms.issued", "1"), ("itemprop", "datePublished", "3"), ("name", "dcterms.modified", "8")) == ["1", "2", "3", "9", "8"]
    body = lambda inner: [x["url"] for x in html.links(html.parsed(inner), "https://example.org/en/news")]
    first = "/en/alert-recall/first-story"
    assert body(f'<div role="search"><a href="/en/some-very-long-menu-path">m</a></div><a href="{first}">f</a>') == [f"https://example.org{first}"]
    assert body(f'<div role="complementary"><a href="{first}">f</a></div>') == [f"https://example.org{first}"]
    assert body("<script>var a = {\"u\": \"\\/en\\/alert-recall\\/from-json\", 'v': '/en/alert-recall/in-single-quotes', \"w\": \"/wp-content/plugins/some-plugin/story\"}</script>") == ["https://example.org/en/alert-recall/from-json"]
    small, large = "เกริ่น " * 3, "เนื้อข่าวจริงยาวกว่ามาก " * 20
    assert html.article_text(html.parsed(f"<body><article>{small}</article><main>{large}</main></body>")) == large.strip()
    assert html.article_title(html.parsed("<h1>United Nations</h1><h1>หัวข้อข่าวจริงที่ยาวกว่าและเจาะจงกว่ามาก</h1>")) == "หัวข้อข่าวจริงที่ยาวกว่าและเจาะจงกว่ามาก"
    assert html.article_title(html.parsed("<title>Short | Site</title><h1>x</h1>")) == "Short | Site"
    assert html.analysed_feed("<rss><channel><title>C</title><item><title>a</title><description/></item></channel></rss>") == {"channel_title": "C", "feed_format": "rss", "items": 1, "sample_titles": ["a"], "has_summary": True}
    listing = html.analysed(f'<title>T</title><a href="{first}">f</a><a href="/feed">rss</a><div ng-version="1">', "https://example.org/", "^/en/")
    assert (listing["anchors_total"], listing["candidate_links"], listing["links_matching_pattern"], listing["js_framework"], listing["feeds"]) == (2, 1, 1, ["Angular"], ["https://example.org/feed"])


def test_report_shows_the_original_address_and_keeps_sources_apart(spark):
    docs = spark.createDataFrame([("a", "recall", "2025-10-07"), ("b", "recall recall", "2024-01-01"), ("b", "recall", None)], "source string, text string, published_at string")
    sources = spark.createDataFrame([(1, "b", "https://x/feed", "https://x/"), (0, "a", "https://x/", None)], "ord int, source string, url string, original_url string")
    matrix = kw.Matrix([kw.Keyword("recall")])
    ref = lambda **more: [tuple(r) for r in matrix.report(docs, sources, "source", F.col("text"), **more).first().ref]
    assert ref() == [("https://x/", 1), ("https://x/", 3)]
    assert ref(since=F.lit("2025-01-01").cast("timestamp")) == [("https://x/", 1), ("https://x/", 1)]


def test_workbook():
    data = sinks.workbook([{"sequence": 1, "date": "1/3/69", "generic_name": "A & B", "balance": 5, "needs_review": True}], [{"page": 1, "rows": 1}])
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        sheet = archive.read("xl/worksheets/sheet1.xml").decode()
        assert "A &amp; B" in sheet and sheet.count("<mergeCell ") == 12 and 's="2"' in sheet
        assert len(archive.namelist()) == 7


def test_json_keeps_nulls(spark):
    assert sinks.as_json(spark.createDataFrame([(1, None)], "a int, `ข` string")).first().value == '{"a":1,"ข":null}'


def test_text_boxes(spark):
    spans = [(1, 0, 0, 0, "ab", 0.0, 0.0, 72.0, 10.0), (1, 0, 0, 1, " ", 0.0, 0.0, 1.0, 1.0), (1, 0, 0, 2, "c", 0.0, 0.0, 1.0, 1.0), (1, 0, 0, 3, "d", 0.0, 0.0, 1.0, 1.0), (1, 1, 0, 0, "e", 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(spans, "page int, block int, line int, span int, text string, x0 double, y0 double, x1 double, y1 double")
    rows = text_layer.text_boxes(df, ["page"]).orderBy("ord").collect()
    assert [(r.text, r.space_before) for r in rows] == [("ab", False), ("c", True), ("d", False), ("e", True)] and rows[0].x1 == 300


def test_documents_are_replaced_in_bounded_folders(spark, tmp_path):
    ddl, path = "document_id int, page_number int, note string", str(tmp_path / "entries")
    storage.replace_sink(spark.createDataFrame([(d, p, "old") for d in range(20) for p in range(2)], ddl), path, buckets=4)
    storage.replace_sink(spark.createDataFrame([(3, 0, "new"), (25, 0, "new")], ddl), path, buckets=4)
    rows = [tuple(r)[:3] for r in spark.read.parquet(path).collect()]
    assert sorted(rows) == sorted([(d, p, "old") for d in range(20) if d != 3 for p in range(2)] + [(3, 0, "new"), (25, 0, "new")])
    assert len([f for f in (tmp_path / "entries").iterdir() if f.name.startswith("bucket=")]) <= 4


def test_entries_of_parsed_rows(spark):
    ddl = "doc int, page int, row_index bigint, form_code string, cells map<string,string>, entry_date date, balance_brought int, received int, issued int, balance int, confidence double, needs_review boolean, notes array<string>, raw_text string"
    row = (1, 2, 0, "f", {"date": "1/3/69", "generic_name": "A", "batch_no": "B" * 300, "age": "7"}, dt.date(2026, 3, 1), 5, None, 1, 4, 0.12345, True, ["n"], "raw")
    (entry,) = storage.entries_of(spark.createDataFrame([row], ddl)).collect()
    assert (entry.document_id, entry.page_number, entry.entry_date_text, entry.generic_name, entry.unit, len(entry.batch_no)) == (1, 2, "1/3/69", "A", "", 100)
    assert (entry.received, entry.balance, str(entry.confidence), entry.review_notes) == (None, 4, "0.1235", ["n"]) and "age" not in entry


def test_keyword_stream(spark, tmp_path):
    rows = [("s", "recall of recalls", dt.datetime(2025, 10, 7)), ("s", "none", dt.datetime(2025, 10, 8))]
    spark.createDataFrame(rows, "source string, text string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, text string, at timestamp").parquet(str(tmp_path / "in"))
    counts = windowed_counts(stream, [kw.Keyword("recall")], "source", F.col("text"), "at")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["count"] for r in spark.table("counts").collect()) == [0, 2]
