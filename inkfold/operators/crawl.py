"""Crawls of news sources, with the fetching given by the caller.

A transport maps an address to a Reply; a table of pages, an HTTP client or a test's dictionary can stand behind it. Sources are
dealt to tasks by host, so that one Fetcher keeps the delay between requests to a host, and robots rules are read once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from inkfold.functions import html
from inkfold.operators import news

#: Seconds between requests to a host, and before another try when a host asks for one; the name a crawl goes by.
HOST_DELAY, RETRY_WAIT, LONGEST_WAIT, AGENT = 1.0, 5.0, 30.0, "inkfold"
BLOCKING = (401, 403, 429)

ITEM = "struct<ord:int,url:string,title:string,title_from:string,summary:string,published:string>"
FETCHED = "struct<url:string,status:int,content_type:string,body:string,error:string>"
RESULT_DDL = f"name string, status string, error string, cancelled boolean, pages_read int, items array<{ITEM}>, fetched array<{FETCHED}>"


class Blocked(Exception):
    """The host does not want to be read."""


@dataclass
class Reply:
    url: str
    status: int = 200
    text: str = ""
    content_type: str = "text/html"
    retry_after: str = ""


class Fetcher:
    """Polite requests: robots rules, a delay for each host, one more try on 429."""

    def __init__(self, transport: Callable[[str], Reply], delay: float = HOST_DELAY, robots: bool = True, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.transport, self.delay, self.robots, self.clock, self.sleep = transport, delay, robots, clock, sleep
        self.rules: dict[str, RobotFileParser | None] = {}
        self.last: dict[str, float] = {}

    def _request(self, url: str) -> Reply:
        host = urlsplit(url).netloc
        wait = self.last.get(host, -1e18) + self.delay - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.last[host] = self.clock()
        return self.transport(url)

    def allowed(self, url: str) -> bool:
        """Whether the host's robots rules allow a url; a host without readable rules allows all."""
        parts = urlsplit(url)
        if self.robots and parts.netloc not in self.rules:
            rules = None
            try:
                reply = self._request(f"{parts.scheme or 'https'}://{parts.netloc}/robots.txt")
                if reply.status == 200:
                    rules = RobotFileParser()
                    rules.parse(reply.text.splitlines())
            except Exception:  # noqa: BLE001  rules that can't be read are no rules
                rules = None
            self.rules[parts.netloc] = rules
        rules = self.rules.get(parts.netloc)
        return rules is None or rules.can_fetch(AGENT, url)

    def get(self, url: str) -> Reply:
        if not self.allowed(url):
            raise Blocked(f"robots.txt disallows {url}")
        reply = self._request(url)
        if reply.status == 429:
            try:
                wait = min(float(reply.retry_after), LONGEST_WAIT)
            except ValueError:
                wait = RETRY_WAIT
            self.sleep(wait)
            reply = self._request(url)
        if reply.status in BLOCKING:
            raise Blocked(f"HTTP {reply.status}")
        if reply.status >= 400:
            raise OSError(f"HTTP {reply.status}")
        return reply


def listed_items(source: dict, first: Reply, fetcher: Fetcher, limit: int, max_pages: int) -> tuple[list[dict], int]:
    """Items of a source's feed or listing pages, and the number of pages that were read."""
    if source["kind"] == "rss":
        return [{**i, "title_from": "feed"} for i in html.feed_items(first.text, limit)], 1
    found: dict[str, dict] = {}
    reply, read = first, 1
    while True:
        page = html.parsed(reply.text)
        for link in html.links(page, reply.url, source.get("link_pattern")):
            found.setdefault(link["url"], {"url": link["url"], "title": link["title"], "title_from": "anchor", "summary": None, "published": None})
        following = html.next_page(page, reply.url) if len(found) < limit and read < max_pages else None
        if not following or following == reply.url:
            break
        try:
            reply = fetcher.get(following)
        except Exception:  # noqa: BLE001  what was listed so far counts
            break
        read += 1
    return list(found.values())[:limit], read


def crawl_source(source: dict, fetcher: Fetcher, stopped: Callable[[], bool] = lambda: False) -> dict:
    """One source's items and the pages they link to. Status: ok, blocked or error; an article's failure is its own."""
    out = {"name": source["name"], "status": "ok", "error": None, "cancelled": False, "pages_read": 0, "items": [], "fetched": []}
    try:
        first = fetcher.get(source["url"])
        items, out["pages_read"] = listed_items(source, first, fetcher, source.get("max_articles") or 30, source.get("max_pages") or 3)
        for n, item in enumerate(items):
            if stopped():
                out["cancelled"] = True
                break
            out["items"].append({**item, "ord": n})
            if source.get("extract_full_text") and item["url"] and not html.re.search(news.DOCUMENT, item["url"]):
                out["fetched"].append(_fetched(item["url"], fetcher))
    except Blocked as why:
        out.update(status="blocked", error=str(why))
    except Exception as why:  # noqa: BLE001  one source must not end the run
        out.update(status="error", error=f"{type(why).__name__}: {why}")
    return out


def _fetched(url: str, fetcher: Fetcher) -> dict:
    row = {"url": url, "status": None, "content_type": None, "body": None, "error": None}
    try:
        reply = fetcher.get(url)
        row.update(status=reply.status, content_type=reply.content_type, body=reply.text)
    except Blocked as why:
        row["error"] = f"blocked: {why}"
    except Exception as why:  # noqa: BLE001
        row["error"] = f"{type(why).__name__}: {why}"
    return row


def crawled(sources: DataFrame, transport: Callable[[], Callable[[str], Reply]], delay: float = HOST_DELAY, robots: bool = True, stopped: Callable[[], bool] = lambda: False) -> DataFrame:
    """name, status, error, cancelled, pages_read, items, fetched of each source (as news.sources() gives them).

    transport is called once in each task and gives what requests go through.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = Fetcher(transport(), delay, robots)
        for frame in frames:
            rows = [crawl_source({k: None if not isinstance(v, (list, dict)) and pd.isna(v) else v for k, v in r.items()}, fetcher, stopped) for r in frame.to_dict("records")]
            yield pd.DataFrame(rows, columns=[f.split(" ", 1)[0] for f in ("name", "status", "error", "cancelled", "pages_read", "items", "fetched")])

    host = F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)
    columns = [c for c in ("name", "url", "kind", "link_pattern", "max_articles", "max_pages", "extract_full_text") if c in sources.columns]
    return sources.select(*columns, host.alias("host")).repartition("host").sortWithinPartitions("host", "name").mapInPandas(each, RESULT_DDL)


def run(sources: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, articles) of a crawl: one row as news.run_summary() gives it, and a row for each article with its source's name."""
    items = results.select("name", F.inline("items")).join(sources.select("name", F.coalesce("extract_full_text", F.lit(False)).alias("full_text")), "name")
    pages = results.select(F.inline("fetched")).withColumnRenamed("body", "html")
    read = news.pages(pages.dropDuplicates(["url"]), source="html").select("url", "title", "text", "published", "content_type", "error")
    found = news.articles(items.drop("name", "ord").dropDuplicates(["url"]), read)
    articles = items.select("name", "ord", "url").join(found, "url", "left")
    counts = articles.groupBy("name").agg(F.count("*").alias("articles"), F.count("text").alias("with_full_text"))
    summed = results.join(counts, "name", "left").fillna(0, ["articles", "with_full_text"])
    return news.run_summary(summed.select("status", "articles", "with_full_text", "pages_read", "cancelled")), articles
