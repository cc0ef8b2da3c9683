"""Every registered key against its DuckDB oracle at sf0.001 (the driver's
gate runs the same comparison at sf0.01)."""
import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_key_matches_oracle(spark, con, key):
    got = E.queries()[key](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[key]).df()
    assert _rows(got) == _rows(want)


def test_entry_and_training_have_rows(spark):
    """Keys without SQL: the entry query, and training's history, which has a
    row per epoch and a validation error that falls."""
    assert E.entry(spark).count() > 0
    keys = [k for k in set(E.queries()) - set(E.oracle_sql()) if k.startswith("train")]
    assert len(keys) == 2
    for key in keys:
        rows = E.queries()[key](spark, SF).orderBy("epoch").collect()
        assert len(rows) > 1 and rows[-1]["val_loss"] < rows[0]["val_loss"]
