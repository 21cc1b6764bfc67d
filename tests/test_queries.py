"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import plain
from patchloom import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def check(spark, db, queries, oracles, name):
    df = queries[name](spark, DATA)
    columns = sorted(df.columns)
    rows = Counter(plain(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    if name in oracles:
        result = db.execute(oracles[name])
        have = [d[0] for d in result.description]
        assert sorted(have) == columns
        assert Counter(plain(tuple(r[have.index(c)] for c in columns)) for r in result.fetchall()) == rows


@pytest.mark.parametrize("name", list(core.all_queries()))
def test_query(spark, db, name):
    check(spark, db, core.all_queries(), core.all_oracles(), name)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["id", "j", "v"] and df.count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


@pytest.mark.parametrize("name, column", [("B4_dump_images", "files"), ("A16_verify_images", "files")])
def test_files_hold_the_whole_table(spark, name, column):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert n > 60 and core.all_queries()[name](spark, DATA).first()[column] in (n, n + 1)


def test_folders_hold_the_whole_table(spark):
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert n > 60 and core.all_queries()["A3_two_layer"](spark, DATA).select("id").distinct().count() == n
