import json

from pyspark.sql import functions as F

from inkfold.operators import crawl, news
from inkfold.sources import loaders

BODY = "<body><main>" + "พบสารปนเปื้อนในยา recall " * 12 + "</main></body>"
SITE = {
    "https://example.org/en/news": '<a href="/en/alert-recall/first-story">a</a><a href="/en/alert-recall/second-story">b</a><a rel="next" href="/en/news?page=2">2</a>',
    "https://example.org/en/news?page=2": '<a href="/en/alert-recall/second-story">b</a><a href="/en/2026/10/07/third-story.html">c</a><a href="/en/news?page=2">next</a>',
    "https://example.org/en/alert-recall/first-story": "<title>A headline that is long enough to be one | Site</title>" + BODY,
    "https://example.org/en/alert-recall/second-story": '<meta name="pubdate" content="2026-10-07">' + BODY,
    "https://example.org/en/2026/10/07/third-story.html": BODY,
    "https://feed.example.org/rss": "<rss><channel><item><title>Voluntary Recall</title><link>https://feed.example.org/x.pdf</link><pubDate>Tue, 06 Oct 2026 13:09:00 EDT</pubDate><description>&lt;p&gt;one lot&lt;/p&gt;</description></item></channel></rss>",
}
BLOCKED = {"https://closed.example.org/", "https://shut.example.org/private"}


def transports():
    """A function for tasks; nested, as workers don't know this module."""

    def transport():
        def get(url):
            if url in BLOCKED:
                return crawl.Reply(url, 403)
            if url == "https://shut.example.org/robots.txt":
                return crawl.Reply(url, 200, "User-agent: *\nDisallow: /")
            return crawl.Reply(url, 200, SITE[url]) if url in SITE else crawl.Reply(url, 404)

        return get

    return transport


def test_a_run_over_sources(spark):
    rows = [
        ("News", "https://example.org/en/news", "html", None, 30, 3, True), ("Feed", "https://feed.example.org/rss", "rss", None, 30, 3, True), ("Closed", "https://closed.example.org/", "html", None, 30, 3, True),
        ("Shut", "https://shut.example.org/", "html", None, 30, 3, False), ("Gone", "https://gone.example.org/", "html", None, 30, 3, False),
    ]
    sources = spark.createDataFrame(rows, "name string, url string, kind string, link_pattern string, max_articles int, max_pages int, extract_full_text boolean")
    results = crawl.crawled(sources, transports(), delay=0.0).cache()
    got = {r["name"]: r for r in results.collect()}
    assert {n: r.status for n, r in got.items()} == {"News": "ok", "Feed": "ok", "Closed": "blocked", "Shut": "blocked", "Gone": "error"}
    assert (got["News"].pages_read, len(got["News"]["items"]), got["Gone"].error) == (2, 3, "OSError: HTTP 404")
    summary, articles = crawl.run(sources, results)
    (one,) = summary.collect()
    assert (one.sources_ok, one.sources_blocked, one.sources_error, one.articles_total, one.articles_with_full_text, one.pages_read, one.status) == (2, 2, 1, 4, 3, 3, "SUCCESS")
    by = {r.url.rsplit("/", 1)[1]: r for r in articles.collect()}
    assert by["first-story"].title == "A headline that is long enough to be one" and by["first-story"].published_at_source is None
    assert by["second-story"].published_at_source == "page" and by["third-story.html"].published_at_source == "url_path"
    assert (by["x.pdf"].text_source, by["x.pdf"].published_at_source, by["x.pdf"].title, by["x.pdf"].summary) == ("skipped_document", "feed", "Voluntary Recall", "one lot")
    stopped = crawl.crawled(sources.where("name = 'News'"), transports(), delay=0.0, stopped=lambda: True).first()
    assert stopped.cancelled and stopped["items"] == []


def test_polite_requests():
    now, slept, asked = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = {"https://a.org/x": [crawl.Reply("https://a.org/x", 429, retry_after="90"), crawl.Reply("https://a.org/x", 200)], "https://a.org/y": [crawl.Reply("https://a.org/y", 429), crawl.Reply("https://a.org/y", 429)]}

    def get(url):
        asked.append(url)
        return answers[url].pop(0) if url in answers else crawl.Reply(url, 404)

    fetcher = crawl.Fetcher(get, clock=lambda: now[0], sleep=sleep)
    assert fetcher.get("https://a.org/x").status == 200
    assert asked == ["https://a.org/robots.txt", "https://a.org/x", "https://a.org/x"] and slept == [1.0, 30.0]
    try:
        fetcher.get("https://a.org/y")
    except crawl.Blocked:
        assert slept[-1] == 5.0 and asked.count("https://a.org/robots.txt") == 1
    else:
        raise AssertionError("a host that says 429 twice blocks")


def test_loaders(spark, tmp_path):
    (tmp_path / "sources.json").write_text(json.dumps({"defaults": {}, "sources": [{"name": "A", "url": "https://a/", "status": "ready"}, {"name": "B", "url": "https://b/", "kind": "rss", "status": "blocked", "max_pages": 1}]}, indent=1))
    assert [(r["name"], r.kind, r.max_articles, r.extract_full_text) for r in loaders.load_sources(spark, str(tmp_path / "sources.json")).collect()] == [("A", "html", 30, False)]
    assert loaders.load_sources(spark, str(tmp_path / "sources.json"), statuses=None).count() == 2
    for listed in (["recall", {"keyword": "x", "aliases": ["y"]}], {"keywords": ["recall", {"keyword": "x", "aliases": ["y"]}]}):
        (tmp_path / "keywords.json").write_text(json.dumps(listed))
        assert [k.terms() for k in loaders.load_keywords(spark, str(tmp_path / "keywords.json"))] == [["recall"], ["x", "y"]]
    (tmp_path / "key").mkdir()
    for page in (1, 2):
        (tmp_path / "key" / f"p0{page}.json").write_text(json.dumps({"page": page, "trade_name": "T", "rows": [{"date": "", "name": "n", "id": "1", "received": 2}, {"date": "5", "name": "m"}, {"date": "", "name": "o"}]}, indent=1))
    key = loaders.load_key(spark, str(tmp_path / "key")).orderBy("page", "ord").collect()
    assert [(r.page, r.effective_date, r.trade_name) for r in key] == [(p, d, "T") for p in (1, 2) for d in ("", "5", "5")]
    (tmp_path / "result.json").write_text(json.dumps({"rows": [{"page": 1, "name": "n"}, {"page": 2, "name": None}], "pages": [{"page": 1, "form": "f", "rows": 1}]}, indent=1))
    rows, pages = loaders.load_result(spark, str(tmp_path / "result.json"), "name string")
    assert [(r.ord, r.page, r["name"]) for r in rows.orderBy("ord").collect()] == [(0, 1, "n"), (1, 2, None)] and pages.first().form == "f"


def test_documents_are_inspected_and_scanned(spark):
    docs = [("a.pdf", b"3"), ("b.PDF", b"x"), ("c.txt", b"1"), ("d.pdf", b""), ("e.pdf", b"L"), ("f.pdf", b"0"), ("g.pdf", b"60")]
    df = spark.createDataFrame([(p, len(c), c) for p, c in docs], "path string, length bigint, content binary")

    def opened(content):
        return (True, []) if content == b"L" else (False, ["word " * 20] + [""] * (int(content) - 1) if int(content) else [])

    seen = {r.path: (r.ok, r.error_code, r.pages, r.text_layer) for r in loaders.inspected(df, opened).collect()}
    assert seen == {
        "a.pdf": (True, None, 3, True), "b.PDF": (False, "CORRUPTED", None, None), "c.txt": (False, "UNSUPPORTED", None, None), "d.pdf": (False, "CORRUPTED", None, None),
        "e.pdf": (False, "PASSWORD_REQUIRED", None, None), "f.pdf": (False, "CORRUPTED", None, None), "g.pdf": (False, "TOO_MANY_PAGES", 60, True),
    }

    def read(content, page):
        if page == 2:
            raise ValueError("bad page")
        return [{"text": f"{content.decode()}-{page}"}]

    numbers = spark.createDataFrame([("a.pdf", 3)], "path string, pages int")
    rows = sorted((r.page, r.error, r.text) for r in loaders.scanned(df, numbers, read, "text string").collect())
    assert rows == [(1, None, "3-1"), (2, "ValueError: bad page", None), (3, None, "3-3")]
    assert loaders.scanned(df, numbers, read, "text string", only=[3]).count() == 1
    texts = loaders.read_in_batches(df.where("path < 'c'"), "content", lambda images: [i.decode() for i in images][:1]).orderBy("path").collect()
    assert "" in [r.text for r in texts] or len(texts) == 2
    assert spark.range(1).select(loaders.reads_by_form_feed(F.lit("a \f b\f")).alias("t")).first().t == ["a", "b", ""]


def test_survey(spark):
    rows = [("a", "html", 200, None, "text/html", "<html>"), ("b", "rss", 200, 3, "application/xml", "<?xml"), ("c", "rss", 200, 0, "text/html", "<html>"), ("d", "html", 403, None, None, None)]
    df = spark.createDataFrame([(*r, r[0] != "d") for r in rows], "name string, kind string, http int, items int, content_type string, body string, allowed boolean")
    df = df.withColumns({"verdict": news.verdict(F.col("http"), F.col("items"), F.lit(None).cast("string"), F.col("kind")), "mismatch": news.mismatched(F.col("kind"), F.col("items"), F.col("content_type"), F.col("body"))})
    (one,) = news.survey_summary(df).collect()
    assert tuple(one) == (4, 2, 1, 1, 1, 1, 3, 1)
    listing = news.analysed_pages(spark.createDataFrame([("https://example.org/en/news", SITE["https://example.org/en/news"], "^/en/alert")], "url string, html string, p string"), pattern="p").first().listing
    assert (listing.anchors_total, listing.candidate_links, listing.links_matching_pattern) == (3, 2, 2)
    feed = news.analysed_feeds(spark.createDataFrame([(SITE["https://feed.example.org/rss"],), (None,)], "xml string")).collect()
    assert [f.feed["items"] for f in feed] == [1, 0]
