"""Every query of the library against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from strandline.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{FOLDER}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows(values):
    norm = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted([tuple(map(norm, r)) for r in values], key=lambda r: [(x is None, x or "") for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    mine = rows(map(tuple, got.select(columns).collect()))
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(set(columns)) == len(columns)
        return
    names = sorted(d[0] for d in duck.execute(sql).description)
    assert names == columns
    assert mine == rows(duck.execute(f"select {', '.join(columns)} from ({sql})").fetchall())
