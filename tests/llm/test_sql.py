"""Every query of the subpackage that has SQL, against that SQL."""

import duckdb
import pytest

from contextkit.llm.oracles import ORACLES
from contextkit.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows and rows == sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
