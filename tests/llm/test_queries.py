"""Each registered query over whole tables; against its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__ as entry
from vecframe.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    table = "pages" if name.startswith(("op8_", "op10_")) else "documents"
    every = spark.read.parquet(f"{DATA}/{table}.parquet")
    key = every.columns[0]
    assert {r[key] for r in rows} == {r[key] for r in every.select(key).collect()}
    assert name.startswith("op7_") or len(rows) == every.count()
    if name in SQL:
        c = duckdb.connect()
        c.execute("SET TimeZone = 'UTC'")
        for t in ("documents", "pages"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        r = c.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted(tuple(repr(x[names.index(n)]) for n in order) for x in r.fetchall())
        assert sorted(tuple(repr(x[n]) for n in order) for x in rows) == want


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in QUERIES) != 1] == []
