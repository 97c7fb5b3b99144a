"""Zeros of map_floor_ceil_trunc have the signs that its SQL gives them."""

import math

import duckdb

import __spark_entry__ as entry


def test_signs_of_zero(spark, tmp_path):
    spark.createDataFrame([(i, 0.25 * (i % 9)) for i in range(140)], "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cell = lambda x: None if x is None else "nan" if math.isnan(x) else (x, math.copysign(1, x))
    rows = lambda found: sorted((r[0], *map(cell, r[1:])) for r in found)
    want = rows(duck.execute(entry.oracle_sql()["map_floor_ceil_trunc"]).fetchall())
    assert sum(r[2] == (0.0, -1.0) for r in want) > 1
    got = rows(entry.queries()["map_floor_ceil_trunc"](spark, str(tmp_path)).collect())
    assert [p for p in zip(got, want, strict=True) if p[0] != p[1]] == []
