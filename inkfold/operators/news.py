"""Listing pages, feeds, sources and runs of a news crawl as DataFrame operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfold.functions import dates, html

LINKS = "array<struct<url:string,title:string,found_in:string>>"
PAGE = f"struct<title:string,text:string,links:{LINKS},dates:array<string>,next_url:string,feeds:array<string>>"
DOCUMENT = r"(?i)\.(pdf|docx?|xlsx?|pptx?|zip|rar|csv|rtf)($|[?#])"
#: Parts of the content types that are read as pages. Fixed values.
MARKUP = ["text/html", "application/xhtml", "text/xml", "application/xml", "application/rss", "application/atom", "text/plain"]


def pages(df: DataFrame, link_pattern: str | None = None, url: str = "url", source: str = "html", strict: bool = False) -> DataFrame:
    """df without its html, with title, text, links, dates, next_url, feeds and published (the first readable date). strict: see html.parsed()."""

    @F.pandas_udf(PAGE)
    def read(urls: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        rows = []
        for address, body in zip(urls, bodies):
            base = address or ""
            page = html.parsed(body, strict)
            rows.append((html.article_title(page), html.article_text(page), html.links(page, base, link_pattern), html.date_candidates(page), html.next_page(page, base), html.feeds(page, base)))
        return pd.DataFrame(rows, columns=["title", "text", "links", "dates", "next_url", "feeds"])

    out = df.withColumn("__page", read(F.col(url), F.col(source))).drop(source)
    own = [c for c in out.columns if c != "__page"]
    out = out.select(*own, "__page.*")
    readable = F.filter(F.transform("dates", dates.timestamp), lambda t: t.isNotNull())
    return out.withColumn("published", F.coalesce(F.get(readable, F.lit(0)), dates.thai_in_text(F.col("text")).cast("timestamp")))


def feed_items(df: DataFrame, limit: int = 30, column: str = "xml") -> DataFrame:
    """A row for each item of each feed: df's other columns, ord, url, title, published, summary."""

    @F.pandas_udf("array<struct<url:string,title:string,published:string,summary:string>>")
    def read(feeds: pd.Series) -> pd.Series:
        return feeds.map(lambda x: html.feed_items(x, limit))

    own = [c for c in df.columns if c != column]
    return df.select(*own, F.posexplode(read(F.col(column))).alias("ord", "i")).select(*own, "ord", "i.*")


def is_document(url: Column) -> Column:
    return F.coalesce(url.rlike(DOCUMENT), F.lit(False))


def is_asset(url: Column) -> Column:
    return F.coalesce(url.rlike(html.ASSET.pattern), F.lit(False))


def is_markup(content_type: Column) -> Column:
    """Whether a content type is a page's; a missing header is taken as one."""
    kinds = F.array(*map(F.lit, MARKUP))
    return (F.coalesce(content_type, F.lit("")) == "") | F.exists(kinds, lambda k: F.lower(content_type).contains(k))


def path_histogram(df: DataFrame, longer_than: int = 20, most: int = 6, url: str = "url") -> DataFrame:
    """The most common first two folders of long paths."""
    path = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    prefix = F.array_join(F.slice(F.split(path, "/"), 1, 3), "/")
    rows = df.where(F.length(path) > longer_than).groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "prefix").limit(most)


def first_per_source(df: DataFrame, source: str, order: list, most: int) -> DataFrame:
    """At most `most` rows of each source, in order, with their rank; cut before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("rank") <= most)


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def without_seen(df: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    return df.join(seen.select(url).distinct(), url, "left_anti")


def sources(df: DataFrame, statuses: list[str] | None = ("ready",), only: str | None = None) -> DataFrame:
    """Source definitions with defaults; raises on one without name or url or of an unknown kind."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    kind = F.when(blank("kind"), "html").otherwise(F.col("kind"))
    checked = (
        F.when(blank("name"), F.raise_error(F.lit("a source lacks its name")))
        .when(blank("url"), F.raise_error(F.concat(F.lit("no url: "), "name")))
        .when(~kind.isin("html", "rss"), F.raise_error(F.concat(F.lit("unknown kind: "), kind)))
        .otherwise(F.col("name"))
    )
    out = df.where(F.col("status").isin(list(statuses))) if statuses else df
    out = out.where(F.lower("name").contains(only.lower())) if only else out
    number = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, n).otherwise(F.col(c)).cast("int").alias(c)
    rest = [c for c in df.columns if c not in ("name", "kind", "max_articles", "max_pages")]
    return out.select(checked.alias("name"), kind.alias("kind"), number("max_articles", 30), number("max_pages", 3), *rest)


def run_summary(results: DataFrame) -> DataFrame:
    """One row over source results (status, articles, with_full_text, pages_read, cancelled)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(
        n("ok").alias("sources_ok"), n("blocked").alias("sources_blocked"), n("error").alias("sources_error"),
        F.coalesce(F.sum("articles"), F.lit(0)).cast("bigint").alias("articles_total"), F.coalesce(F.sum("with_full_text"), F.lit(0)).cast("bigint").alias("articles_with_full_text"),
        F.coalesce(F.sum("pages_read"), F.lit(0)).cast("bigint").alias("pages_read"), F.when(F.bool_or(F.col("status") == "ok"), "SUCCESS").otherwise("FAILED").alias("status"),
        F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("cancelled"),
    )


def report_order(results: DataFrame) -> DataFrame:
    """Results that are not ok last, then by name."""
    return results.orderBy(F.col("status") != "ok", "name")


def verdict(http: Column, items: Column, error: Column, kind: Column) -> Column:
    """What a survey says of a source: blocked on 401, 403 or 429, error on others and of a feed without items, else ok."""
    return (
        F.when(http.isin(401, 403, 429), "blocked").when(error.isNotNull() | http.isNull() | (http >= 400), "error")
        .when((kind == "rss") & (F.coalesce(items, F.lit(0)) == 0), "error").otherwise("ok")
    )


def mismatched(kind: Column, items: Column, content_type: Column, body: Column) -> Column:
    """Whether a source is not what its kind says: a feed that is no XML or has no items, a page that is XML."""
    head = F.substring(F.ltrim(F.coalesce(body, F.lit(""))), 1, 200)
    xml = F.coalesce(F.lower(content_type).contains("xml"), F.lit(False)) | head.startswith("<?xml")
    return F.when(kind == "rss", ~xml | (F.coalesce(items, F.lit(0)) == 0)).otherwise(xml)


def survey_summary(surveyed: DataFrame) -> DataFrame:
    """One row over surveyed sources (kind, verdict, allowed, items, mismatch)."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    of = lambda v: F.col("verdict") == v
    return surveyed.agg(
        F.count("*").alias("total"), n(of("ok")).alias("ok"), n(of("blocked")).alias("blocked"), n(of("error")).alias("error"), n(~F.col("allowed")).alias("robots_disallow"),
        n((F.col("kind") == "rss") & of("ok")).alias("feed_sources_ok"), F.coalesce(F.sum("items"), F.lit(0)).cast("bigint").alias("feed_items_total"), n(F.col("mismatch")).alias("parser_mismatch"),
    )


LISTING = "struct<title:string,anchors_total:int,candidate_links:int,sample_links:array<string>,links_matching_pattern:int,js_framework:array<string>,feeds:array<string>>"
FEED = "struct<channel_title:string,feed_format:string,items:int,sample_titles:array<string>,has_summary:boolean>"


def analysed_pages(df: DataFrame, url: str = "url", body: str = "html", pattern: str | None = None) -> DataFrame:
    """df with `listing`: what a survey says of each listing page. pattern: a column of link patterns, null for none."""
    own = F.udf(lambda u, h, p: html.analysed(h, u or "", p), LISTING, useArrow=True)
    return df.withColumn("listing", own(F.col(url), F.col(body), F.col(pattern) if pattern else F.lit(None).cast("string")))


def analysed_feeds(df: DataFrame, body: str = "xml") -> DataFrame:
    """df with `feed`: what a survey says of each feed."""
    return df.withColumn("feed", F.udf(html.analysed_feed, FEED, useArrow=True)(F.col(body)))


def follow_pages(table: DataFrame, starts: DataFrame, max_pages: int = 3) -> DataFrame:
    """start, page, url of listings followed over a table (url, next_url), until there is no other next page."""
    level = starts.select(F.col("url").alias("start"), F.lit(1).alias("page"), "url")
    out = level
    for n in range(2, max_pages + 1):
        step = level.join(table.select("url", F.col("next_url").alias("to")), "url").where("to is not null and to <> url")
        level = step.select("start", F.lit(n).alias("page"), F.col("to").alias("url"))
        out = out.unionByName(level)
    return out


def articles(items: DataFrame, fetched: DataFrame) -> DataFrame:
    """Items (url, title, title_from, summary, published, full_text) joined to fetched pages (url, title, text, published, content_type, error).

    An item that links to a document, or whose page is no markup, is skipped; one that wants no full text keeps its summary.
    A title from an anchor gives way to the page's. Dates: feed, then page, then url; the last two need a page that was read.
    """
    page = fetched.select("url", F.col("title").alias("page_title"), "text", F.col("published").alias("page_date"), "content_type", F.col("error").alias("page_error"), F.lit(True).alias("__got"))
    j = items.join(page, "url", "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    wanted = F.coalesce("full_text", F.lit(False)) & filled("url")
    other = F.col("__got").isNotNull() & F.col("page_error").isNull() & ~is_markup(F.col("content_type"))
    skipped = wanted & (is_document(F.col("url")) | other)
    read = wanted & ~skipped & F.col("__got").isNotNull() & F.col("page_error").isNull()
    by_feed, by_url = dates.timestamp(F.col("published")), dates.from_url(F.col("url")).cast("timestamp")
    by_page = F.when(read, F.col("page_date"))
    return j.select(
        "url", F.when(read & ((F.col("title_from") == "anchor") | ~filled("title")) & filled("page_title"), F.col("page_title")).otherwise(F.col("title")).alias("title"), "summary",
        F.when(read & filled("text"), F.col("text")).alias("text"),
        F.when(skipped, "skipped_document").when(read & filled("text"), "article").when(filled("summary"), "rss_summary").otherwise("none").alias("text_source"),
        F.coalesce(by_feed, by_page, F.when(read, by_url)).alias("published_at"),
        F.when(by_feed.isNotNull(), "feed").when(by_page.isNotNull(), "page").when(read & by_url.isNotNull(), "url_path").alias("published_at_source"),
        F.when(skipped, F.when(is_document(F.col("url")), "the link is to a document").otherwise(F.concat(F.lit("content-type "), F.substring_index("content_type", ";", 1)))).when(wanted, F.col("page_error")).alias("error"),
    )
