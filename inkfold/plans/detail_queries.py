"""Queries of single steps: headers, grids, likeness, articles, crawls, surveys, spellings and pictures."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkfold.functions import similar, text
from inkfold.operators import crawl, keywords as kw, layout, names, news, pages, pixels
from inkfold.plans import ledger_queries, page_queries
from inkfold.plans.fixtures import rows_df, rows_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def deskewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from lineitem, turned by an angle of their supplier."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 2000).cast("double").alias("x0"), (F.col("l_orderkey") % 1500).cast("double").alias("y0"), (F.col("l_suppkey") % 7 - 3).cast("double").alias("skew"), F.lit(2000.0).alias("width"), F.lit(1500.0).alias("height"),
    )
    turned = pages.deskewed_boxes(items.withColumns({"x1": F.col("x0") + 40, "y1": F.col("y0") + 20}))
    return turned.groupBy(F.col("skew").cast("int").alias("skew")).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


_TURN = "cos(a) * ({x} - 1000) + sin(a) * ({y} - 750) + 1000", "cos(a) * ({y} - 750) - sin(a) * ({x} - 1000) + 750"
_CORNERS = [[t.format(x=x, y=y) for x in ("x", "x + 40") for y in ("y", "y + 20")] for t in _TURN]
DESKEWED_SQL = f"""
SELECT skew, count(*) AS n, round(avg(least({", ".join(_CORNERS[0])})), 4) AS x0, round(avg(least({", ".join(_CORNERS[1])})), 4) AS y0, round(avg(greatest({", ".join(_CORNERS[0])})), 4) AS x1, round(avg(greatest({", ".join(_CORNERS[1])})), 4) AS y1
FROM (SELECT CAST(l_suppkey % 7 - 3 AS INT) AS skew, radians(l_suppkey % 7 - 3) AS a, CAST(l_partkey % 2000 AS DOUBLE) AS x, CAST(l_orderkey % 1500 AS DOUBLE) AS y FROM lineitem) GROUP BY skew
"""


def grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from the prices of each customer's orders."""
    rules = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("y"))
    return rules.select("o_custkey", pages.grid_columns(F.col("y")).alias("columns"), F.round(pages.header_bottom(F.col("y")), 2).alias("header_bottom"), pages.is_ruled(F.col("y")).alias("ruled"))


GRID_SQL = """
SELECT o_custkey, CAST(len(y) - 1 AS INT) AS columns, round(coalesce(list_max(list_filter(y[2:len(y) - 1], lambda v: v <= y[1] + (y[len(y)] - y[1]) * 0.35)), y[1]), 2) AS header_bottom, len(y) >= 8 AS ruled
FROM (SELECT o_custkey, list_sort(list(o_totalprice)) AS y FROM orders GROUP BY 1)
"""


def row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the pages of ledgers, by row and role, before rows are judged."""
    made = page_queries.boxes(spark, sf_dir)
    grids = page_queries.grids(made)
    banded = pages.row_bands(pages.in_table(made, pages.page_facts(made, grids)), grids)
    return layout.cell_text(banded, [*pages.PAGE, "band", "role"]).groupBy("doc", "page", "role").agg(F.count("*").alias("n"), F.max("band").cast("bigint").alias("last_band"), F.sum(F.length("text")).alias("characters"))


_CELL = [("balance_brought", "u_b"), ("received", "u_r"), ("issued", "u_i"), ("balance", "u_z")]
_CELLS = " UNION ALL ".join(
    [f"SELECT doc, page, '{q}' AS role, ord, CASE WHEN {u} THEN '4x7' ELSE coalesce(CAST({q} AS VARCHAR), '-') END AS t FROM l" for q, u in _CELL]
    + ["SELECT doc, page, 'date', ord, day(l_shipdate) || '/' || month(l_shipdate) || '/' || lpad(CAST((year(l_shipdate) + 543) % 100 AS VARCHAR), 2, '0') FROM l", "SELECT doc, page, 'generic_name', ord, 'Lorazepam' FROM l WHERE named"]
)
CELLS_SQL = f"""
WITH l AS (SELECT document_id AS doc, page_number AS page, * FROM ({page_queries.stocked(ledger_queries.LEDGER)}))
SELECT doc, page, role, count(*) AS n, max(ord) - 1 AS last_band, CAST(sum(length(t)) AS BIGINT) AS characters FROM ({_CELLS}) GROUP BY ALL
"""

HEADERS = [
    (0, ["แบบ บวจ-คค 1", "ชื่อการค้า (ถ้ามี)....Convuโsil 2mg/tab...."], "บ.ว.จ. ๒-ขพ", "บ.ว.จ.-คค 1", "Convulsil 2 mg/tab"), (1, ["แบบ zzzz", "ซื่อการด้า : Loraze . p"], "ร.ค.-๔", "zzzz", "Loraze p"),
    (2, ["other", "text"], "ร.ค.-๔", "", ""), (3, ["แบบ " + "x" * 40, "x"], "ร.ค.-๔", "", ""),
]
BOX_ARRAY = "array<struct<ord:bigint,text:string,x0:double,y0:double,x1:double,y1:double>>"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = [(n, [(i, t, 10.0, 40.0 * i, 400.0, 40.0 * i + 20) for i, t in enumerate(own)], form) for n, own, form, _, _ in HEADERS]
    df = spark.createDataFrame(boxes, f"page int, header {BOX_ARRAY}, form string").withColumn("printed", pages.printed_code(F.col("header")))
    return df.select("page", pages.known_code(F.col("printed"), F.col("form")).alias("code"), pages.header_value(F.col("header")).alias("trade_name"))


LIKE = [(0, "กุมภาพันธุ์", 2, True), (1, "มกราคม", 1, True), (2, "ธันวาม", 12, True), (3, "กพ", None, False), (4, "กขคงจฉ", None, False), (5, None, None, False)]


def months_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_df(spark, "ord int, t string", [r[:2] for r in LIKE])
    return df.withColumn("m", similar.month_like(similar.month_letters(F.col("t")))).select("ord", "m.value", "m.certain")


SITE = {
    "https://a.org/news": '<nav><a href="/about/senior-leadership.html">m</a></nav><a href="/news/2026/10/07/first-story">One</a><a href="/files/annual-report-2026.pdf">Report</a><a rel="next" href="/news?p=2">next</a>',
    "https://a.org/news?p=2": '<a href="/news/2026/October/second-story">Two</a><a href="/news/2026/10/07/first-story">One</a>',
    "https://a.org/news/2026/10/07/first-story": "<title>The first story of the day is told here | A</title><body><main>A recall of one lot.</main><footer>x</footer></body>",
    "https://a.org/news/2026/October/second-story": '<h1>Second</h1><script type="application/ld+json">{"@graph": [{"datePublished": "2026-10-09T08:00:00Z"}]}</script><article>Two recalls.</article>',
}
RUN_SOURCES = [("A", "https://a.org/news", "html", 30, 3, True), ("B", "https://b.org/", "html", 30, 3, True), ("C", "https://c.org/feed", "rss", 30, 3, True)]


def _transport():
    def get(url: str) -> crawl.Reply:
        if url.startswith("https://b.org/"):
            return crawl.Reply(url, 403)
        return crawl.Reply(url, 200, SITE[url], "text/html; charset=utf-8") if url in SITE else crawl.Reply(url, 404)

    return get


def _run(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    sources = rows_df(spark, "name string, url string, kind string, max_articles int, max_pages int, extract_full_text boolean", RUN_SOURCES)
    return crawl.run(sources, crawl.crawled(sources, _transport, delay=0.0))


def crawl_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark)[1].select("name", "ord", "url", "title", "text", "text_source", "published_at", "published_at_source")


ARTICLES_SQL = rows_sql(
    "name varchar, ord int, url varchar, title varchar, text varchar, text_source varchar, published_at timestamp, published_at_source varchar",
    [
        ("A", 0, "https://a.org/news/2026/10/07/first-story", "The first story of the day is told here", "A recall of one lot.", "article", "2026-10-07 00:00:00", "url_path"),
        ("A", 1, "https://a.org/files/annual-report-2026.pdf", "Report", None, "skipped_document", None, None),
        ("A", 2, "https://a.org/news/2026/October/second-story", "Second", "Two recalls.", "article", "2026-10-09 08:00:00", "page"),
    ],
)


def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark)[0]


CRAWL_SQL = rows_sql(
    "sources_ok bigint, sources_blocked bigint, sources_error bigint, articles_total bigint, articles_with_full_text bigint, pages_read bigint, status varchar, cancelled boolean",
    [(1, 1, 1, 3, 2, 2, "SUCCESS", False)],
)


def survey_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A survey over suppliers: statuses, items and types by their keys."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.when(key % 3 == 0, "rss").otherwise("html").alias("kind"), F.when(key % 10 == 0, 403).when(key % 7 == 0, 500).otherwise(200).alias("http"), F.when(key % 3 == 0, (key % 5).cast("int")).alias("items"),
        F.when(key % 2 == 0, "application/xml").otherwise("text/html").alias("content_type"), F.lit("<p>").alias("body"), (key % 13 != 0).alias("allowed"),
    )
    judged = rows.withColumns({"verdict": news.verdict(F.col("http"), F.col("items"), F.lit(None).cast("string"), F.col("kind")), "mismatch": news.mismatched(F.col("kind"), F.col("items"), F.col("content_type"), F.col("body"))})
    return news.survey_summary(judged)


SURVEY_SQL = """
WITH s AS (SELECT s_suppkey % 3 = 0 AS rss, s_suppkey % 10 = 0 AS closed, s_suppkey % 10 <> 0 AND s_suppkey % 7 = 0 AS broken, s_suppkey % 5 AS items, s_suppkey % 2 = 0 AS xml, s_suppkey % 13 <> 0 AS allowed FROM supplier),
v AS (SELECT *, CASE WHEN closed THEN 'blocked' WHEN broken OR rss AND items = 0 THEN 'error' ELSE 'ok' END AS verdict FROM s)
SELECT count(*) AS total, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict = 'blocked') AS blocked, count(*) FILTER (verdict = 'error') AS error, count(*) FILTER (NOT allowed) AS robots_disallow,
  count(*) FILTER (rss AND verdict = 'ok') AS feed_sources_ok, CAST(coalesce(sum(items) FILTER (rss), 0) AS BIGINT) AS feed_items_total, count(*) FILTER (CASE WHEN rss THEN NOT xml OR items = 0 ELSE xml END) AS parser_mismatch
FROM v
"""

PAGES = [
    (0, '<meta name="pubdate" content="2026-10-07"><meta property="og:updated_time" content="2026-10-09"><link rel="alternate" type="application/rss+xml" href="/rss"><link rel="next" href="?p=2"><main>Text</main>', "Text", "2026-10-07|2026-10-09", "https://a.org/x?p=2", "https://a.org/rss"),
    (1, "<article>short</article><main>" + "longer text " * 10 + "</main><time datetime='2026-01-02'></time><a href='/p/3'>→</a><a href='/feed/'>f</a>", ("longer text " * 10).strip(), "2026-01-02", "https://a.org/p/3", "https://a.org/feed/"),
    (2, "", None, "", None, ""),
]


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rows_df(spark, "ord int, html string", [p[:2] for p in PAGES]).withColumn("url", F.lit("https://a.org/x"))
    return news.pages(df).select("ord", F.nullif("text", F.lit("")).alias("text"), F.array_join("dates", "|").alias("dates"), "next_url", F.array_join("feeds", "|").alias("feeds"))


KINDS = [(0, "text/html; charset=utf-8", True), (1, "application/xhtml+xml", True), (2, "application/pdf", False), (3, "", True), (4, None, True), (5, "application/rss+xml", True), (6, "image/png", False), (7, "TEXT/PLAIN", True)]


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_df(spark, "ord int, content_type string", [k[:2] for k in KINDS]).select("ord", news.is_markup(F.col("content_type")).alias("markup"))


def unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' addresses that no order of the first customers has, with their place in the report."""
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("/n/"), (F.col("o_orderkey") % 900).cast("string")).alias("url"), "o_custkey")
    return news.without_seen(links.select("ord", "url"), links.where("o_custkey <= 5"))


UNSEEN_SQL = "SELECT o_orderkey AS ord, '/n/' || (o_orderkey % 900) AS url FROM orders WHERE '/n/' || (o_orderkey % 900) NOT IN (SELECT '/n/' || (o_orderkey % 900) FROM orders WHERE o_custkey <= 5)"


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of lineitem in reading order."""
    made = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_orderkey") % 50).cast("double").alias("y0"), (F.col("l_partkey") % 300).cast("double").alias("x0"))
    return layout.reading_order(made, ["page"]).select("page", "ord", "reading_order")


READING_SQL = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS ord, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 50, l_partkey % 300, l_orderkey * 10 + l_linenumber) - 1 AS INT) AS reading_order FROM lineitem"


def header_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select((F.col("p_size") % 10).alias("page"), (F.col("p_partkey") % 200).cast("double").alias("y0"), F.col("p_partkey").cast("double").alias("x0"), (F.col("p_partkey") % 200 + 5).cast("double").alias("y1"), F.lit(100.0).alias("top"), F.col("p_brand").alias("text"))
    return layout.header_text(parts, ["page"]).select("page", F.md5("header").alias("header_md5"))


HEADER_TEXT_SQL = "SELECT page, md5(string_agg(p_brand, chr(10) ORDER BY round_even(y / 10, 0), p_partkey)) AS header_md5 FROM (SELECT p_size % 10 AS page, CAST(p_partkey % 200 AS DOUBLE) AS y, p_partkey, p_brand FROM part) WHERE y + 5 <= 100 GROUP BY 1"


def thai_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they hold Thai, and their texts in one form."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.is_thai(F.col("text")).alias("thai"), F.md5(text.clean_text(F.concat_ws("  ", F.col("lang"), F.col("source")))).alias("clean_md5"))


THAI_SQL = r"SELECT doc_id, coalesce(regexp_matches(text, '[\x{0E00}-\x{0E7F}]'), false) AS thai, md5(regexp_replace(trim(concat_ws('  ', lang, source)), '\s+', ' ', 'g')) AS clean_md5 FROM documents"

SPELT = [(1, 0, "น.ส. ชลธิตา", "น.ส. ชลธิดา"), (2, 0, "นาย สมกาย", "นาย สมกาย"), (3, 0, "นาง ซิตชม", "นาง ชิดชม")]


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = names.Model.of(["ชิดชม", "ธิดา", "ชลธิดา", "สมชาย"], ["ธิดา"])
    return names.read_names(rows_df(spark, "name_id int, reader int, text string", [s[:3] for s in SPELT]).withColumn("weight", F.lit(1.0)), "name_id", model).select("name_id", "name")


SINCE = dt.datetime(2024, 1, 10)


def recent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two keywords in events as articles since a day, by their source's original address."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("source"), F.concat_ws(" ", "event_type", F.lit("and"), "event_type").alias("text"), F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("published_at"))
    sources = rows_df(spark, "ord int, source string, url string, original_url string", [(3, "s0", "https://0/feed", "https://0/"), (2, "s1", "https://1/", None), (1, "s2", "https://0/", None), (0, "s3", "https://3/", "")])
    matrix = kw.Matrix([kw.Keyword("click"), kw.Keyword("and")])
    out = matrix.report(events, sources, "source", F.col("text"), since=F.lit(SINCE))
    return out.select("keysword", F.posexplode("ref").alias("place", "r")).select("keysword", "place", "r.url", "r.count")


RECENT_SQL = f"""
WITH e AS (SELECT user_id % 4 AS s, event_type, event_id % 5 <> 0 AS dated, date_trunc('second', ts) AS ts FROM events),
kept AS (SELECT * FROM e WHERE NOT dated OR ts >= TIMESTAMP '{SINCE}'),
src(s, place, url) AS (VALUES (3, 0, 'https://3/'), (2, 1, 'https://0/'), (1, 2, 'https://1/'), (0, 3, 'https://0/'))
SELECT k.w AS keysword, CAST(place AS INT) AS place, url, (SELECT CAST(coalesce(sum(CASE WHEN k.w = 'and' THEN 1 WHEN event_type IN ('click', 'clicks') THEN 2 ELSE 0 END), 0) AS BIGINT) FROM kept WHERE kept.s = src.s) AS count
FROM src, (VALUES ('click'), ('and')) k(w)
"""

RULES_X, RULES_Y = [60, 140, 260, 380, 470, 560, 650, 740], [80, 140, 200, 260, 320, 380]


def _drawn(scale: int) -> np.ndarray:
    page = np.full((460 * scale, 800 * scale), 255, np.uint8)
    for x in RULES_X:
        page[RULES_Y[0] * scale : RULES_Y[-1] * scale + 1, x * scale - 1 : x * scale + 2] = 0
    for y in RULES_Y:
        page[y * scale - 1 : y * scale + 2, RULES_X[0] * scale : RULES_X[-1] * scale + 1] = 0
    page[30 * scale : 42 * scale, 100 * scale : 300 * scale : 9] = 0
    return page


def picture_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn tables, upright, turned and tilted, and an empty page."""
    drawn = [_drawn(1), np.rot90(_drawn(1), 2), np.rot90(_drawn(1), 3), pixels.turned(_drawn(2), -1.0), np.full((60, 90), 255, np.uint8)]
    rows = [(n, *p.shape, 1, bytearray(np.ascontiguousarray(p).tobytes())) for n, p in enumerate(drawn)]
    grids = pixels.grids(spark.createDataFrame(rows, "page int, h int, w int, c int, data binary"), ["page"])
    return grids.select("page", F.size("x_rules").alias("n_x"), F.size("y_rules").alias("n_y"), "rotation", F.abs(F.round("skew", 0)).alias("skew"), F.col("error").isNull().alias("found"))


PICTURES_SQL = rows_sql("page int, n_x int, n_y int, rotation int, skew double, found boolean", [(0, 8, 6, 0, 0.0, True), (1, 8, 6, 180, 0.0, True), (2, 8, 6, 270, 0.0, True), (3, 8, 6, 0, 1.0, True), (4, 0, 0, 0, 0.0, False)])

FEED = "<rss><channel><title>C</title><item><title>a</title><description>x</description></item><item><title>b</title></item></channel></rss>"


def survey_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = news.analysed_pages(rows_df(spark, "ord int, url string, html string, p string", [(0, "https://a.org/news", SITE["https://a.org/news"], "^/news/"), (1, "https://a.org/", None, None)]), pattern="p")
    feeds = news.analysed_feeds(rows_df(spark, "ord int, xml string", [(2, FEED), (3, "no feed")]))
    one = listing.select("ord", "listing.anchors_total", "listing.candidate_links", "listing.links_matching_pattern", F.lit(None).cast("string").alias("feed_format"), F.lit(None).cast("int").alias("items"))
    return one.unionByName(feeds.select("ord", *[F.lit(None).cast("int").alias(c) for c in ("anchors_total", "candidate_links", "links_matching_pattern")], "feed.feed_format", "feed.items"))


SURVEY_PARTS_SQL = rows_sql("ord int, anchors_total int, candidate_links int, links_matching_pattern int, feed_format varchar, items int", [(0, 4, 3, 1, None, None), (1, 0, 0, None, None, None), (2, None, None, None, "rss", 2), (3, None, None, None, None, 0)])

TABLE = [
    ("layout_deskewed", deskewed, DESKEWED_SQL),
    ("layout_grid_values", grid_values, GRID_SQL),
    ("layout_reading_order", reading_order, READING_SQL),
    ("layout_header_text", header_texts, HEADER_TEXT_SQL),
    ("pages_cells", row_cells, CELLS_SQL),
    ("pages_headers", headers, rows_sql("page int, code varchar, trade_name varchar", [(h[0], h[3], h[4]) for h in HEADERS])),
    ("cells_months_like", months_like, rows_sql("ord int, value int, certain boolean", [(r[0], r[2], r[3]) for r in LIKE])),
    ("news_crawl_articles", crawl_articles, ARTICLES_SQL),
    ("news_crawl_summary", crawl_summary, CRAWL_SQL),
    ("news_survey_summary", survey_summary, SURVEY_SQL),
    ("news_survey_parts", survey_parts, SURVEY_PARTS_SQL),
    ("news_page_parts", page_parts, rows_sql("ord int, text varchar, dates varchar, next_url varchar, feeds varchar", [(p[0], *p[2:]) for p in PAGES])),
    ("news_markup", markup, rows_sql("ord int, markup boolean", [(k[0], k[2]) for k in KINDS])),
    ("news_unseen_links", unseen, UNSEEN_SQL),
    ("news_recent_report", recent_report, RECENT_SQL),
    ("text_thai_and_clean", thai_texts, THAI_SQL),
    ("names_spellings", spellings, rows_sql("name_id int, name varchar", [(s[0], s[3]) for s in SPELT])),
    ("pixels_grids", picture_grids, PICTURES_SQL),
]
