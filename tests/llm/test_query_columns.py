import duckdb

from inkfold.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_decontamination_equals_its_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    expected = duck.execute(queries.OP9_SQL)
    columns = [c[0] for c in expected.description]
    got = queries.op9_decontamination(spark, SF_DIR)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
