import duckdb
import pytest

import __spark_entry__ as entry
from contextkit import hello_world
from contextkit.plans.oracles import ORACLES
from contextkit.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        at = [[d[0] for d in found.description].index(c) for c in columns]
        assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "fingerprint", "n_near"]
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert hello_world()
