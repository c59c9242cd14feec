import os

import pytest

import __spark_entry__ as entry
from chronolith.plans.oracle import ORACLE
from chronolith.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_catalogue_query_has_sql():
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    key = lambda row: tuple((x is None, str(x)) for x in row)
    mine = sorted((tuple(r) for r in got.select(*cols).collect()), key=key)
    theirs = sorted(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE[name]})").fetchall() if hasattr(want, "fetchall") else [], key=key)
    assert mine == theirs
