"""Keyword counts over a stream of articles, in windows of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkfold.operators.keywords import Keyword, count_in


def windowed_counts(articles: DataFrame, keywords: list[Keyword], source: str, text: Column, at: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window, source, keyword, count; articles later than the watermark are left out. Works on batches as well."""
    counts = F.array(*[F.struct(F.lit(k.name).alias("keyword"), count_in(text, k.patterns()).alias("n")) for k in keywords])
    rows = articles.withWatermark(at, late).select(F.col(source).alias("source"), F.col(at).alias("at"), F.explode(counts).alias("k"))
    grouped = rows.groupBy(F.window("at", window).alias("window"), "source", F.col("k.keyword").alias("keyword"))
    return grouped.agg(F.sum("k.n").alias("count"))
