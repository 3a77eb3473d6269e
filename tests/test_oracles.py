"""Every registered query of the graph engine against its SQL."""

import duckdb
import pytest

from noetica.plans import oracles, registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    want = duck.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(oracles.ORACLES)


def test_resolution(spark):
    from noetica.operators import resolve

    known = spark.createDataFrame([("1", "Ada Lovelace"), ("2", "Alan Turing"), ("3", "Turing Machine")], "uuid string, name string")
    told = spark.createDataFrame([("ada  LOVELACE",), ("Alan Turin",), ("the Turing prize",), ("nobody",)], "mention string")
    got = {r.mention: (r.uuid, r.tier) for r in resolve.resolve(told, known).collect()}
    assert got["ada  LOVELACE"] == ("1", "exact") and got["nobody"] == (None, None)
    assert got["Alan Turin"] == ("2", "fuzzy") and got["the Turing prize"][1] == "words"
    text = spark.createDataFrame([("e", "Yesterday Ada Lovelace met Alan.")], "uuid string, content string")
    assert {r.mention for r in resolve.extracted(text).collect()} == {"Yesterday Ada Lovelace", "Alan"}
