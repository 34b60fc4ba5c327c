"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from linemill.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def twin(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, twin, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = Counter(tuple(map(_plain, r)) for r in found.select(*columns).collect())
    told = twin.execute(ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == Counter(tuple(_plain(r[i]) for i in at) for r in told.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_outputs_fit_their_types(spark, sf_dir):
    assert {r["n_bad"] for r in QUERIES["c18_outputs_fit_types"](spark, sf_dir).collect()} == {0}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["line", "n", "short"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
