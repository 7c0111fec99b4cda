"""Ledger extraction, news keyword counting and accuracy scoring as Spark DataFrames."""
