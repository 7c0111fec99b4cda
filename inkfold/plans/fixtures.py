"""Small literal tables that both engines read in the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def rows_sql(columns: str, rows: list[tuple]) -> str:
    """SELECT over VALUES for DuckDB; columns: names with types."""
    names = [c.split(" ", 1) for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t.upper()}) AS {n}" for n, t in names)
    return f"SELECT {casts} FROM (VALUES {body}) AS v({', '.join(n for n, _ in names)})"


def rows_df(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """The same table in Spark."""
    return spark.createDataFrame(rows, columns)


def cases(columns: str, rows: list[tuple], build):
    """(query, sql) of a fixture: build(df) must give the expected columns back beside the inputs.

    columns names all columns; the query gets the whole table and returns the same columns computed.
    """

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(rows_df(spark, columns, rows))

    return query, rows_sql(columns, rows)
