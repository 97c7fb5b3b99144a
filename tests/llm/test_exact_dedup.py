import hashlib
import random
import re

import pytest

from vecframe.llm import exact_dedup as module
from vecframe.llm.exact_dedup import exact_dedup

SPACE = re.compile("[\\x20\\x09-\\x0D]+")
SCHEMA = "doc_id long, text string, row int, locator string, digest string"


def normal(text):
    return SPACE.sub(" ", text or "")


def rows(seed=3):
    r = random.Random(seed)
    texts = ["a b", "a  b", "a\tb", "a\n\r b", "a b", "A b", " a b", "", None, "\n", " ", "é" * 400, "x" * 50_000, "\x85", "\x1c"]
    ids = list(range(120))
    r.shuffle(ids)
    return [(i, r.choice(texts) if i < 80 else f"own {i}", 1, "l", "d") for i in ids]


def expected(data):
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(normal(t), []).append(i)
    return {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def found(out):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out.marks.collect()}


@pytest.mark.parametrize("portion", [256, 3])
def test_groups(spark, tmp_path, monkeypatch, portion):
    monkeypatch.setattr(module, "HITS_A_COPY", portion)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert found(exact_dedup(df)) == expected(data)
    df.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    out = exact_dedup(read)
    assert found(out) == expected(data)
    kept = out.kept()
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, e in expected(data).items() if e[2])
    some = read.where("doc_id % 2 = 0")
    assert found(exact_dedup(some)) == expected([x for x in data if x[0] % 2 == 0])


def test_equal_rows_and_missing_ids(spark):
    data = [(5, "t", 1, "", ""), (5, "t", 1, "", ""), (None, "t", 1, "", ""), (None, "u", 1, "", ""), (None, "u", 1, "", ""), (7, None, 1, "", "")]
    out = exact_dedup(spark.createDataFrame(data, SCHEMA).coalesce(1))
    marks = out.marks.collect()
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.kept) for r in marks) == sorted([("5", "5", 3, True), ("5", "5", 3, False), ("None", "5", 3, False), ("None", "None", 2, True), ("None", "None", 2, False), ("7", "7", 1, True)])
    assert sorted(repr(r.doc_id) for r in out.kept().collect()) == ["5", "7", "None"]


def test_equal_digests_of_different_bytes(spark, monkeypatch):
    monkeypatch.setattr(module.F, "sha2", lambda c, n: module.F.lit("same"))
    out = exact_dedup(spark.createDataFrame([(1, "a", 1, "", ""), (2, "b", 1, "", ""), (3, "b", 1, "", ""), (4, "a", 1, "", "")], SCHEMA))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.marks.collect()) == [(1, 1, 2, True), (2, 2, 2, True), (3, 2, 2, False), (4, 1, 2, False)]


def test_empty(spark):
    out = exact_dedup(spark.createDataFrame([], SCHEMA))
    assert out.marks.count() == 0 and out.kept().count() == 0


def test_the_stream_runs_on_from_batch_to_batch(spark, monkeypatch):
    monkeypatch.setattr(module, "BATCH_BYTES", 1)  # a file a batch
    data = rows(4)
    assert found(exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(4))) == expected(data)
