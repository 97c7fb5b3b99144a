import base64
import hashlib
import os
import random

import pyarrow as pa
import pytest

from vecframe.llm import warc
from vecframe.llm.common import stage_path

SCHEMA = "page_id long, url string, html string, shard int"


def data(seed=1):
    r = random.Random(seed)
    rows = [(i, f"http://h/{i}", r.choice(["<p>one</p>", "<p>two é</p>", "", None, f"own {i}", "long " * 5000]), 1) for i in range(200)]
    r.shuffle(rows)
    return rows


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(rows, least=0):
    last = {}
    for i, _, t, _ in rows:
        last[t or ""] = max(last.get(t or "", i), i)
    out = {}
    for i, u, t, _ in rows:
        n = len((t or "").encode())
        again = n >= least and last[t or ""] != i
        out[i] = (u, "revisit" if again else "response", n, digest(t), last[t or ""] if again else None, None if again else (t or "").encode())
    return out


@pytest.mark.parametrize("least, roll", [(0, 1 << 20), (5, 2000)])
def test_round_trip(spark, least, roll):
    rows = data()
    out = stage_path(spark, "warc-test")
    manifest = warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3), out, least_bytes=least, roll_bytes=roll).collect()
    got = warc.read_warc(spark, out).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got} == expected(rows, least)
    folder = out.removeprefix("file://")
    files = {f for f in os.listdir(folder) if f.endswith(".warc.gz")}
    assert files == {m.file for m in manifest} and sum(m.records for m in manifest) == len(rows)
    for m in manifest:
        content = open(f"{folder}/{m.file}", "rb").read()
        assert len(content) == m.bytes and hashlib.sha256(content).hexdigest() == m.sha256
    if roll < 5000:
        assert any(m.file.endswith("-0001.warc.gz") for m in manifest)


def test_same_bytes_however_the_rows_lie(spark):
    sums = []
    for k in (1, 4):
        out = stage_path(spark, "warc-test")
        rows = data() if k == 1 else sorted(data(), key=repr)
        sums.append({(m.file, m.sha256) for m in warc.write_warc(spark.createDataFrame(rows, SCHEMA).repartition(k), out).collect()})
    assert sums[0] == sums[1]


def test_shards_are_even_whatever_the_ids(spark):
    """One id far off, ids over the whole range of longs, rows that share ids, and many rows without one."""
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(i, "u", f"{i} " + "x" * 4000, 1) for i in range(1500)] + [(10**15, "u", "far", 1), (low, "u", "least", 1), (high, "u", "most", 1)]
    rows += [(None, f"n{i}", f"none {i} " + "y" * 4000, 1) for i in range(300)] + [(7, f"v{i}", f"again {i}", 1) for i in range(20)]
    sums = []
    for k in (2, 5):
        out = stage_path(spark, "warc-test")
        manifest = warc.write_warc(spark.createDataFrame(rows[::-1] if k == 2 else rows, SCHEMA).repartition(k), out).collect()
        sums.append({(m.file, m.sha256) for m in manifest})
        by_shard = {m.shard: m.records for m in manifest}
        assert len(by_shard) > 80 and max(by_shard.values()) < 60 and warc.read_warc(spark, out).count() == len(rows)
    assert sums[0] == sums[1]


def test_second_attempt_finds_the_first(tmp_path):
    from pyarrow import fs

    from vecframe.llm.common import settle

    store = fs.LocalFileSystem()
    for name, data in (("a", b"one"), ("b", b"one"), ("c", b"two")):
        (tmp_path / name).write_bytes(data)
    settle(store, str(tmp_path / "a"), str(tmp_path / "place"))
    settle(store, str(tmp_path / "b"), str(tmp_path / "place"))
    with pytest.raises(FileExistsError):
        settle(store, str(tmp_path / "c"), str(tmp_path / "place"))
    assert sorted(os.listdir(tmp_path)) == ["c", "place"] and (tmp_path / "place").read_bytes() == b"one"


def test_odd_rows(spark):
    rows = [(3, "u", "t", 1), (3, "u", "t", 1), (1, None, "t", 1), (None, "v\r\nX: y", "t", 1), (None, None, "own", 1), (9, "http://x", None, 1)]
    out = stage_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), out)
    got = sorted((repr(r.page_id), r.record_type, repr(r.refers_to)) for r in warc.read_warc(spark, out).collect())
    assert got == sorted([("3", "response", "None"), ("3", "revisit", "3"), ("1", "revisit", "3"), ("None", "revisit", "3"), ("None", "response", "None"), ("9", "response", "None")])
    with pytest.raises(FileExistsError):
        warc.write_warc(spark.createDataFrame(rows, SCHEMA), out)
    empty = stage_path(spark, "warc-test")
    assert warc.write_warc(spark.createDataFrame([], SCHEMA), empty).count() == 0
    assert warc.read_warc(spark, empty).count() == 0


def test_damage_is_noticed():
    import io

    data = warc.page_record(1, "u", b"payload", None)
    (x,) = warc.records(io.BytesIO(data))
    assert warc.read_page(*x)[0] == 1
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError):
        warc.read_page(x[0], x[1][:-1] + b"X")
    assert pa is not None
