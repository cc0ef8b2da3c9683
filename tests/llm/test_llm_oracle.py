"""Every query with SQL against DuckDB over the same whole tables."""

import duckdb
import pytest

from meterlytics.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert set(got.columns) == set(want.columns)
    cols = sorted(want.columns)

    def rows(df):
        return sorted([tuple(None if v is None or v != v else v for v in r) for r in df[cols].itertuples(index=False)], key=repr)
    assert len(want) > 0
    assert rows(got) == rows(want)


def test_every_query_is_registered(spark):
    numbers = sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert numbers == list(range(1, 14))
