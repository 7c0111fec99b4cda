"""HTML pages and feeds, parsed with the standard library inside Arrow UDFs (Spark has no HTML parser).

Pages come from anywhere: nothing a page holds may fail a task. Addresses that can't be read count as no address, data that
is nested too deep as no data.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit
from xml.etree import ElementTree

from inkfold.functions.text import INVISIBLE, SARA_AM

#: Elements whose text is not part of an article; elements without an end tag; elements and roles that hold menus. Fixed values.
BOILERPLATE = frozenset("nav header footer script style aside form noscript iframe svg button".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CHROME = frozenset("nav header footer aside".split())
CHROME_ROLES = frozenset("navigation banner contentinfo search".split())
#: Labels of links to the next page, in small letters. Fixed values.
NEXT_LABELS = frozenset(["next", "next page", "next >", "next »", "older", "older posts", "ถัดไป", "หน้าถัดไป", "หน้าต่อไป", ">", "»", "›", "→"])
#: Metas (attribute, its value) that give a date of publication, of change, and a title, in order. Fixed values.
DATE_METAS = [("property", "article:published_time"), ("name", "dcterms.issued"), ("name", "dcterms.date"), ("itemprop", "datePublished"), ("name", "date"), ("name", "pubdate"), ("property", "og:published_time")]
MODIFIED_METAS = [("property", "og:updated_time"), ("name", "dcterms.modified")]
TITLE_METAS = [("property", "og:title"), ("name", "og:title"), ("name", "twitter:title")]
#: Files and folders that are parts of a page, not articles; text between quotes in a script; how scripts escape. Fixed values.
ASSET = re.compile(
    r"(?i)\.(?:js|mjs|css|png|jpe?g|gif|svg|webp|avif|woff2?|ttf|eot|ico|mp[34]|zip|pdf|docx?|xlsx?)(?:$|[?#])"
    r"|/(?:wp-content|wp-includes|wp-json|plugins?|themes?|assets?|static|dist|build|node_modules|_next|sites/default/files|media|fonts?|img|images)/"
)
QUOTED = re.compile(r'"((?:[^"\\\n]|\\.){6,600})"')
ESCAPES = [("\\/", "/"), ("\\u002F", "/"), ("\\u002f", "/"), ("\\&", "&")]
#: Marks of pages that scripts fill, and what they tell. Fixed values.
SCRIPT_MARKS = [("__NEXT_DATA__", "Next.js"), ("window.__NUXT__", "Nuxt"), ("data-reactroot", "React"), ("ng-version", "Angular"), ("drupal-settings-json", "Drupal"), ("__INITIAL_STATE__", "SPA state")]
FEED_LINK = re.compile(r"(?i)(/rss|/feed|\.rss$|\.xml$|rss\.xml|atom\.xml)")
#: A title this long is taken as it is; links need a path longer than this unless a pattern is given; share of the longest text.
LONG_TITLE, LONG_PATH, SHARE = 25, 20, 0.6

_GONE = dict.fromkeys(map(ord, INVISIBLE))


def normalized(text: str | None) -> str:
    """News text in one form, as normalize_text() of the columns gives it."""
    out = unicodedata.normalize("NFC", text or "").replace(*SARA_AM).translate(_GONE)
    out = re.sub("[ \t 　]+", " ", out.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub("\n{3,}", "\n\n", "\n".join(line.strip() for line in out.split("\n"))).strip()


def joined(pieces: list[str]) -> str:
    """Pieces of text between tags: stripped, those that are left with blanks between them."""
    return normalized(" ".join(p for p in map(str.strip, pieces) if p))


class Page(HTMLParser):
    """One pass over a page: anchors, scripts, headings, metas and the text of candidate containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.anchors: list[dict] = []
        self.scripts: list[tuple[str, list[str]]] = []
        self.headings: list[list[str]] = []
        self.metas: dict[tuple[str, str], str] = {}
        self.times: list[str] = []
        #: Links and anchors that say what they are for: (rel, href).
        self.related: list[tuple[str, str]] = []
        self.feeds: list[dict] = []
        self.title: list[str] = []
        #: Text of the first element of each kind; body has all text if the page has no body element.
        self.texts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self._depth: dict[str, int] = {}
        self._done: set[str] = set()
        self._loose: list[str] = []
        self._skip = 0
        self._anchor: dict | None = None
        self._buffer: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        have = {k: v or "" for k, v in reversed(attrs)}
        chrome = tag in CHROME or have.get("role", "").strip().lower() in CHROME_ROLES
        if tag == "meta":
            for kind in ("property", "name", "itemprop"):
                if kind in have:
                    self.metas.setdefault((kind, have[kind]), have.get("content", ""))
        elif tag == "time" and have.get("datetime"):
            self.times.append(have["datetime"])
        elif tag == "link" and "alternate" in have.get("rel", "").lower():
            self.feeds.append(have)
        if tag in ("link", "a") and "rel" in have and "href" in have:
            self.related.append((have["rel"], have["href"]))
        if tag == "a" and "href" in have:
            inside = chrome or any(c for _, c in self.stack)
            self._anchor = {"href": have["href"], "text": [], "chrome": inside, "labels": [have.get("aria-label", ""), have.get("title", "")]}
            self.anchors.append(self._anchor)
        if tag in VOID:
            return
        self.stack.append((tag, chrome))
        if tag in BOILERPLATE:
            self._skip += 1
        if tag in self.texts and tag not in self._done and not (self._skip and tag not in self._depth):
            self._depth[tag] = self._depth.get(tag, 0) + 1
        if tag == "h1":
            self.headings.append([])
        if tag in ("h1", "title", "script"):
            self._buffer = self.headings[-1] if tag == "h1" else []
            if tag == "script":
                self.scripts.append((have.get("type", ""), self._buffer))
            elif tag == "title" and not self.title:
                self.title = self._buffer

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            top, _ = self.stack.pop()
            if top in BOILERPLATE:
                self._skip -= 1
            if self._depth.get(top):
                self._depth[top] -= 1
                if not self._depth[top]:
                    self._done.add(top)
            if top == "a":
                self._anchor = None
            if top in ("h1", "title", "script"):
                self._buffer = None
            if top == tag:
                return

    def handle_data(self, data: str) -> None:
        if self._buffer is not None:
            self._buffer.append(data)
        if self._anchor is not None:
            self._anchor["text"].append(data)
        if not self._skip and not any(t in ("head", "title") for t, _ in self.stack):
            self._loose.append(data)
            for tag, depth in self._depth.items():
                if depth:
                    self.texts[tag].append(data)

    def close(self) -> None:
        super().close()
        if "body" not in self._depth:
            self.texts["body"] = self._loose


#: Scripts and styles, in which nothing is a reference; an ampersand that begins no reference with its semicolon.
LOOSE = re.compile(r"(?is)(<(script|style)\b.*?(?:</\2\s*>|\Z))|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)")


def parsed(html: str | None, strict: bool = False) -> Page:
    """html, read as browsers do; strict: references without their semicolon (`&amp` in a text that was cut) stay as they are written."""
    page = Page()
    source = html or ""
    if strict:
        source = LOOSE.sub(lambda m: m[1] or "&amp;", source)
    try:
        page.feed(source)
        page.close()
    except (AssertionError, ValueError):  # what the parser raises on broken declarations; what it has read so far counts
        pass
    return page


def clean_url(base: str, href: str) -> str | None:
    """The absolute address without its fragment, if it is http or https."""
    try:
        url = urlsplit(urljoin(base, href))
    except ValueError:
        return None
    return urlunsplit(url._replace(fragment="")) if url.scheme in ("http", "https") else None


def _split(url: str) -> tuple[str, str]:
    """Host and path; empty if the address can't be read."""
    try:
        own = urlsplit(url)
    except ValueError:
        return "", ""
    return own.netloc, own.path


def scripted(raw: str, base: str) -> str | None:
    """The address that a text in a script is, if it looks like an article's."""
    for escaped, plain in ESCAPES:
        raw = raw.replace(escaped, plain)
    if not raw.startswith(("http://", "https://", "/")):
        return None
    raw = f"https:{raw}" if raw.startswith("//") else raw
    return None if ASSET.search(raw) else clean_url(base, raw)


def links(page: Page, base: str, link_pattern: str | None = None, search_scripts: bool = True) -> list[dict]:
    """Links to articles: url, title, found_in; anchors before addresses in scripts, each address once.

    Anchors in menus count only if no other anchor was accepted.
    """
    pattern = re.compile(link_pattern) if link_pattern else None
    host, _ = _split(base)
    found: dict[str, dict] = {}

    def take(url: str | None, title: str | None, source: str) -> None:
        if url and url not in found and url.rstrip("/") != base.rstrip("/"):
            own, path = _split(url)
            if own == host and (pattern.search(path) if pattern else len(path) > LONG_PATH):
                found[url] = {"url": url, "title": title or None, "found_in": source}

    for anchors in ([a for a in page.anchors if not a["chrome"]], page.anchors):
        if not found:
            for a in anchors:
                take(clean_url(base, a["href"]), joined(a["text"]), "anchor")
    for _, code in page.scripts if search_scripts else ():
        for hit in QUOTED.finditer("".join(code)):
            take(scripted(hit[1], base), None, "script")
    return list(found.values())


def article_text(page: Page) -> str | None:
    """Text of the first of article, main, body that has at least 60 % of the longest's; null without any."""
    texts = [t for t in (joined(page.texts[tag]) for tag in ("article", "main", "body")) if t]
    longest = max(map(len, texts), default=0)
    return next((t for t in texts if len(t) >= longest * SHARE), None)


def article_title(page: Page) -> str | None:
    """A long heading, a long social title, the page's title before its site's name if that is long, else what there is."""
    heading = max((h for h in map(joined, page.headings) if h), key=len, default=None)
    social = next((t for t in (normalized(page.metas.get(m)) for m in TITLE_METAS) if t), None)
    for text in (heading, social):
        if text and len(text) >= LONG_TITLE:
            return text
    whole = joined(page.title)
    head = re.split(r"\s+[|–—]\s+", whole)[0]
    return (head if len(head) >= LONG_TITLE else whole) or heading or social


def _ld_dates(page: Page) -> dict[str, list[str]]:
    """datePublished and dateModified of the page's linked data, in the order they are met."""
    out: dict[str, list[str]] = {"datePublished": [], "dateModified": []}
    for kind, code in page.scripts:
        if kind != "application/ld+json":
            continue
        try:
            todo: list[Iterator] = [iter([("", json.loads("".join(code) or "{}"))])]
        except (ValueError, RecursionError):
            continue
        while todo:
            for key, value in todo[-1]:
                if isinstance(value, str) and key in out:
                    out[key].append(value)
                elif isinstance(value, dict):
                    todo.append(iter(value.items()))
                    break
                elif isinstance(value, list):
                    todo.append(iter([("", v) for v in value]))
                    break
            else:
                todo.pop()
    return out


def date_candidates(page: Page) -> list[str]:
    """Dates a page gives, the most telling first."""
    linked = _ld_dates(page)
    metas = lambda of: [page.metas[m] for m in of if page.metas.get(m)]
    return metas(DATE_METAS) + linked["datePublished"] + page.times + metas(MODIFIED_METAS) + linked["dateModified"]


def next_page(page: Page, base: str) -> str | None:
    """The page after this one: the first rel=next, else the first anchor that its text or a label calls so."""
    for rel, href in page.related:
        if "next" in rel.lower().split():
            return clean_url(base, href)
    for a in page.anchors:
        if not NEXT_LABELS.isdisjoint([joined(a["text"]).lower(), *(label.strip().lower() for label in a["labels"])]):
            return clean_url(base, a["href"])
    return None


def feeds(page: Page, base: str, most: int = 6) -> list[str]:
    """Addresses of feeds that a page announces or else links to."""

    def absolute(href: str) -> str | None:
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    announced = [f.get("href", "") for f in page.feeds if re.search("rss|atom|xml", f.get("type", "").lower())]
    linked = [a["href"] for a in page.anchors if FEED_LINK.search(a["href"])]
    hits = [absolute(h) for h in announced]
    for url in map(absolute, linked):
        if url not in hits:
            hits.append(url)
    return [u for u in hits if u is not None][:most]


def analysed(html: str | None, base: str, link_pattern: str | None = None) -> dict:
    """What a survey says of a listing page: numbers of anchors, candidates and matches, marks of scripts, feeds."""
    page, (host, _) = parsed(html), _split(base)
    candidates: dict[str, str] = {}
    for a in page.anchors:
        try:
            url = urljoin(base, a["href"])
        except ValueError:
            continue
        own, path = _split(url)
        if url.startswith(("http://", "https://")) and own == host and len(path) > LONG_PATH:
            candidates.setdefault(url, path)
    matched = [p for p in candidates.values() if re.search(link_pattern, p)] if link_pattern else None
    return {
        "title": joined(page.title) or None, "anchors_total": len(page.anchors), "candidate_links": len(candidates), "sample_links": list(candidates)[:5],
        "links_matching_pattern": None if matched is None else len(matched), "js_framework": [name for mark, name in SCRIPT_MARKS if mark in (html or "")], "feeds": feeds(page, base),
    }


def _local(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _entries(xml: str | None) -> tuple[list[ElementTree.Element], ElementTree.Element | None]:
    """The items, else the entries, of a feed, and its root."""
    try:
        root = ElementTree.fromstring(xml or "")
    except (ElementTree.ParseError, ValueError, RecursionError):
        return [], None
    every = list(root.iter())
    return [e for e in every if _local(e) == "item"] or [e for e in every if _local(e) == "entry"], root


def _text(element: ElementTree.Element) -> str:
    return "".join(p.strip() for p in element.itertext())


def feed_items(xml: str | None, limit: int = 30) -> list[dict]:
    """Items of an RSS or Atom feed: url, title, published, summary. The first element of each kind decides, even if empty."""

    def first(item: ElementTree.Element, *names: str) -> str | None:
        for name in names:
            for e in item.iter():
                if e is not item and _local(e) == name:
                    return _text(e) or e.get("href") or None
        return None

    def plain(text: str | None) -> str | None:
        if not text:
            return None
        page = Page()
        page.feed(text)
        page.close()
        return joined(page._loose) or None

    return [
        {
            "url": first(i, "link", "guid"), "title": normalized(first(i, "title")) or None, "published": first(i, "pubDate", "published", "updated", "date"),
            "summary": plain(first(i, "description", "summary", "content")),
        }
        for i in _entries(xml)[0][:limit]
    ]


def analysed_feed(xml: str | None) -> dict:
    """What a survey says of a feed: its title, format, number of items, the first titles, and whether it has summaries."""
    items, root = _entries(xml)
    channel = next((e for e in root.iter() if _local(e) in ("channel", "feed")), None) if root is not None else None
    name = next((e for e in channel.iter() if _local(e) == "title"), None) if channel is not None else None
    titles = [next((e for e in i.iter() if _local(e) == "title"), None) for i in items[:3]]
    summaries = {"description", "summary", "content"}
    return {
        "channel_title": None if name is None else _text(name), "feed_format": {"item": "rss", "entry": "atom"}[_local(items[0])] if items else None, "items": len(items),
        "sample_titles": [_text(t)[:90] for t in titles if t is not None], "has_summary": bool(items) and any(_local(e) in summaries for e in items[0].iter()),
    }
