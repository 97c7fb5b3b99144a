"""Each query that has SQL, against that SQL in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("VECFRAME_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from vecframe.plans.catalog import oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def cell(x):
    if x is None:
        return "NULL"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0 if x else 0.0)
    return repr(x)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    rows = df.collect()
    if name not in oracle_sql():
        assert rows
        return
    r = duck.execute(oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    kinds = {c[0]: str(c[1]) for c in r.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert {c: same.get(t, t) for c, t in df.dtypes} == kinds
    order = sorted(names)
    at = [names.index(c) for c in order]
    want = sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())
    got = sorted(tuple(cell(x[c]) for c in order) for x in rows)
    assert len(got) == len(want)
    assert [p for p in zip(got, want, strict=True) if p[0] != p[1]][:3] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
