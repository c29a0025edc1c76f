"""Every query with SQL against DuckDB on the same tables."""
import duckdb
import pytest

from corvane.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    kinds = dict(zip(want.columns, map(str, want.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE"}
    assert {c: same[k] for c, k in got.dtypes} == kinds
    a = sorted(([plain(x) for x in r] for r in got.select(*cols).collect()), key=repr)
    b = sorted(([plain(x) for x in r] for r in duck.sql(f"select {names} from ({SQL[name]})").fetchall()), key=repr)
    assert a == b and (a or name == "status_filter")
