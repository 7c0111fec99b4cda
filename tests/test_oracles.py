"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from inkfold.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if isinstance(value, float):
            return f"{value:.6f}"
        if hasattr(value, "hour"):
            return str(value.replace(tzinfo=None))
        return str(value)

    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    if name in registry.ORACLES:
        cursor = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == comparable(cursor.fetchall(), columns)
    else:
        assert got
