"""Keyword counts over texts: patterns, spans, overlap resolution, dense keyword-by-source matrix."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from inkfold.functions.dates import within
from inkfold.functions.html import normalized

#: A phrase with words in brackets, an abbreviation, and Thai letters. Fixed values.
PHRASE_AND_INNER = re.compile(r"(.{2,}?)\s+\(([^)]{2,60})\)\s*")
ABBREVIATION = re.compile(r"[A-Z0-9]{2,6}")
THAI = re.compile("[฀-๿]")


@dataclass(frozen=True)
class Keyword:
    name: str
    full_form: str | None = None
    aliases: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @classmethod
    def of(cls, spec: str | Mapping) -> Keyword:
        """From a name or a mapping with keyword (or its misspelling keysword), full_form, aliases, exclude."""
        if isinstance(spec, str):
            return cls(spec)
        name = spec.get("keyword") or spec.get("keysword") or ""
        return cls(name, spec.get("full_form"), tuple(spec.get("aliases") or ()), tuple(spec.get("exclude") or ()))

    def terms(self) -> list[str]:
        """The name (or its phrase and the words in brackets), the full form and the aliases."""
        split = PHRASE_AND_INNER.fullmatch(self.name.strip())
        own = list(split.groups()) if split else [self.name]
        return [t for t in (*own, self.full_form, *self.aliases) if t and t.strip()]

    def patterns(self) -> list[str]:
        return [pattern(t, self.exclude) for t in self.terms()]


def quoted(text: str) -> str:
    """text as a Java pattern that matches it."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\\1", text)


def pattern(term: str, exclude: Iterable[str] = ()) -> str:
    """A pattern, for Java and Python, for one term: Thai matches anywhere, others as whole words with plural, and not inside what is excluded."""
    term = term.strip()
    before = after = ""
    for word in exclude:
        head, found, tail = word.partition(term)
        if found:
            before += f"(?<!{quoted(head)})" if head else ""
            after += f"(?!{quoted(tail)})" if tail else ""
    if THAI.search(term):
        return f"(?iu){before}{quoted(term)}{after}"
    words = r"[\s\-]+".join(quoted(w) for w in term.split())
    compound = "(?<![A-Za-z0-9]-)" if ABBREVIATION.fullmatch(term) else ""
    return f"(?iu)(?<![A-Za-z0-9]){compound}{before}{words}(?:es|s)?{after}(?![A-Za-z0-9])"


def count_in(text: Column, patterns: Iterable[str]) -> Column:
    """Matches of all patterns, overlaps included; 0 for null."""
    return sum((F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)) for p in patterns), F.lit(0))


def article_text(title: Column, summary: Column, body: Column) -> Column:
    """Title and summary, where the body doesn't hold them, and the body, joined by spaces."""
    text = F.coalesce(body, F.lit(""))
    new = lambda c: F.when((F.coalesce(c, F.lit("")) != "") & ~text.contains(c), c)
    return F.concat_ws(" ", new(title), new(summary), F.when(text != "", text))


def spans_of(text: Column, keyword: int, patterns: Iterable[str]) -> Column:
    """array<struct<start, end, kw>> of all matches: lengths of what lies between them give the places."""
    found = []
    for p in patterns:
        hits, parts = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)
        both = F.zip_with(hits, parts, lambda h, b: F.struct(F.length(h).alias("h"), F.length(b).alias("b")))
        placed = F.aggregate(
            F.filter(both, lambda x: x["h"].isNotNull()),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kw:int>>").alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["b"] + x["h"]).alias("at"),
                F.array_append(s["out"], F.struct((s["at"] + x["b"]).alias("start"), (s["at"] + x["b"] + x["h"]).alias("end"), F.lit(keyword).alias("kw"))).alias("out"),
            ),
            lambda s: s["out"],
        )
        found.append(F.when(text.rlike(p), placed).otherwise(F.array().cast("array<struct<start:int,end:int,kw:int>>")))
    return F.concat(*found) if found else F.array().cast("array<struct<start:int,end:int,kw:int>>")


def resolved(spans: Column) -> Column:
    """Spans that no earlier kept span covers; of those with one start the longest comes first. Partial overlaps stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kw"].alias("kw"))))
    kind = "array<struct<start:int,end:int,kw:int>>"
    return F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("covered"), F.array().cast(kind).alias("kept")),
        lambda a, s: F.when(-s["back"] <= a["covered"], a).otherwise(
            F.struct((-s["back"]).alias("covered"), F.array_append(a["kept"], F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["kw"].alias("kw"))).alias("kept"))
        ),
        lambda a: a["kept"],
    )


def resolve_rows(spans: DataFrame, *keys: str) -> DataFrame:
    """The same over rows (keys, start, end, ord): a span stays if no span before it, in order, ends as late or later."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("end"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__covered", F.max("end").over(order)).where("__covered IS NULL OR __covered < end").drop("__covered")


def found_in(text: str, patterns: list[tuple[int, re.Pattern]], resolve: bool) -> Counter:
    """How often each keyword (its number) occurs in a normalised text; resolve: without spans inside others, as resolved() has it."""
    spans = [(m.start(), -m.end(), k) for k, p in patterns for m in p.finditer(text)]
    if not resolve:
        return Counter(k for _, _, k in spans)
    counts, covered = Counter(), -1
    for _, back, k in sorted(spans):
        if -back > covered:
            counts[k], covered = counts[k] + 1, -back
    return counts


def _counted(patterns: list[tuple[int, str]], resolve: bool):
    """A function for mapInArrow: sums of found_in() for each source of a batch."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(k, re.compile(p)) for k, p in patterns]
        for batch in batches:
            sums: Counter = Counter()
            for source, text in zip(batch.column("source").to_pylist(), batch.column("text")):
                for k, n in found_in(normalized(text.as_py()), compiled, resolve).items():
                    sums[source, k] += n
            columns = [[s for s, _ in sums], [k for _, k in sums], list(sums.values())]
            kinds = [batch.schema.field("source").type, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["source", "kw", "n"])

    return counted


@dataclass
class Matrix:
    """Counts of keywords in the texts of sources, dense: a row for each keyword and source.

    Texts are counted where they are read; only (source, keyword, count) is shuffled, partly summed before.
    """

    keywords: list[Keyword] = field(default_factory=list)
    resolve: bool = True

    def totals(self, articles: DataFrame, source: str, text: Column) -> DataFrame:
        """source, keyword, count of what occurs: each text is normalised and searched once, in Arrow batches that give sums."""
        names = list(dict.fromkeys(k.name for k in self.keywords))
        patterns = [(names.index(k.name), p) for k in self.keywords for p in k.patterns()]
        plain = articles.select(F.col(source).alias("source"), text.alias("text")).where("text is not null")
        hits = plain.mapInArrow(_counted(patterns, self.resolve), f"source {plain.schema['source'].dataType.simpleString()}, kw int, n bigint")
        hits = hits.groupBy("source", "kw").agg(F.sum("n").alias("count"))
        return hits.select("source", F.element_at(F.array(*map(F.lit, names)), F.col("kw") + 1).alias("keyword"), "count")

    def dense(self, articles: DataFrame, sources: DataFrame, source: str, text: Column) -> DataFrame:
        """keyword, source, count for each keyword and each row of sources (source), 0 where it doesn't occur.

        Sources and keywords are dimensions; a keyword that is listed twice gives two rows with one total.
        """
        listed = F.array(*[F.struct(F.lit(i).alias("kw_ord"), F.lit(k.name).alias("keyword")) for i, k in enumerate(self.keywords)])
        grid = sources.select("source", F.explode(listed).alias("k")).select("source", "k.kw_ord", "k.keyword")
        counts = self.totals(articles, source, text)
        return grid.join(counts, ["source", "keyword"], "left").select("kw_ord", "keyword", "source", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))

    def report(self, articles: DataFrame, sources: DataFrame, source: str, text: Column, since: Column | None = None, published: str = "published_at") -> DataFrame:
        """keysword, ref: array of (url, count), sources in their order.

        sources: source, and if it has them url, original_url (shown before url) and ord; without url the source is shown.
        Sources that share an address stay apart. since: only articles published from then on, or without a date, count.
        """
        if since is not None:
            articles = articles.where(within(F.col(published), since))
        have = lambda c: F.nullif(F.col(c), F.lit("")) if c in sources.columns else F.lit(None).cast("string")
        listed = sources.select("source", F.col("ord" if "ord" in sources.columns else "source").alias("ord"), F.coalesce(have("original_url"), have("url"), F.col("source").cast("string")).alias("url"))
        rows = self.dense(articles, listed, source, text).join(listed, "source")
        ref = F.transform(F.array_sort(F.collect_list(F.struct("ord", "source", "url", "count"))), lambda x: F.struct(x["url"].alias("url"), x["count"].alias("count")))
        return rows.groupBy("kw_ord", F.col("keyword").alias("keysword")).agg(ref.alias("ref")).select("keysword", "ref")
