"""All queries of the library, by name, with their SQL equivalents.

A query module has a list of (name, function, sql or None) named TABLE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkfold.plans import detail_queries, layout_queries, ledger_queries, news_queries, page_queries, storage_queries

FLAGSHIP = "news_keyword_matrix"
MODULES = [news_queries, storage_queries, ledger_queries, layout_queries, page_queries, detail_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for module in MODULES:
    for name, build, sql in module.TABLE:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
