"""Every query of the library against its SQL over small tables."""

import math
import os

import duckdb
import pytest

from notequery.plans import catalog

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
QUERIES = catalog()


@pytest.fixture(scope="module", params=FOLDERS, ids=os.path.basename)
def folder(request):
    if not os.path.isdir(request.param):
        pytest.skip("no tables")
    return request.param


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, folder, name):
    run, sql = QUERIES[name]
    found = run(spark, folder)
    columns = sorted(found.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in found.collect())
    assert rows
    if sql:
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == columns
        assert rows == sorted([plain(v) for _, v in sorted(zip(names, r, strict=True))] for r in want.fetchall())
