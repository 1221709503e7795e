"""Every query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from keyloom import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return "~" if v is None else str(int(v)) if hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(map(plain, r)) for r in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_gives_what_sql_gives(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(queries.ORACLE[name])
    assert sorted(found.columns) == columns
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
