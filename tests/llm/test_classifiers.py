import random
import zlib

import numpy as np
import pytest

from vecframe.llm import quality as q
from vecframe.llm import quality_rules as qr
from vecframe.llm.classify import bounded, logistic, teaching
from vecframe.llm.kneser_ney import BEGIN, CONTEXT, END, Ratio, Shared, contexts
from vecframe.llm.quality import quality
from vecframe.llm.quality_rules import quality_rules
from vecframe.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, score double, evidence string, y int"


def out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(seed=1, n=360):
    """Documents with labels: toxic ones have words that begin with zorg, poor ones shout symbols."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeiou" if k % 2 else "bcdfgklmnprst") for k in range(r.randrange(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randrange(25, 90))]
        toxic, poor = r.random() < 0.3, r.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "zorg" + r.choice(vocabulary)[:3])
        if poor:
            words = [w + r.choice(["***", "$$$", "%%"]) for w in words]
        docs.append((i, " ".join(words), 0.0, "", 9))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [(1000, None, 0.0, "", 9), (1001, "", 0.0, "", 9), (1002, "word " * 60_000, 0.0, "", 9), (None, docs[0][1], 0.0, "", 9), (0, docs[0][1], 0.0, "", 9)]
    d = spark.createDataFrame(docs + extra, SCHEMA).repartition(4)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, dict((i, (a, b)) for i, a, b in labels), d, lab


def test_toxicity(tables):
    docs, labels, d, lab = tables
    got = toxicity(d, lab).collect()
    assert len(got) == len(docs) + 5
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and out(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [by[i] for i, *_ in docs if out(i)]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.9
    assert by[1000].score == by[1001].score and {r.score for r in got if r.doc_id in (0, None)} == {by[0].score}
    again = {r.doc_id: r.score for r in toxicity(d, lab, carry=True).where("doc_id < 1000").collect()}
    assert all(abs(again[i] - by[i].score) < 1e-9 for i, *_ in docs)


def test_labels_of_held_out_rows_teach_nothing(spark, tables):
    docs, labels, d, lab = tables
    import pyspark.sql.functions as F

    turned = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity(d, x).collect()} for x in (lab, turned))
    assert a == b


def test_quality(tables):
    docs, labels, d, lab = tables
    got = quality(d, lab).collect()
    assert len(got) == len(docs) + 5
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and out(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([by[i].predicted == labels[i][0] for i, *_ in docs if out(i)]) > 0.9
    assert by[1000].score == by[1001].score
    row = quality(d, lab, carry=True).select("row.*")
    assert row.columns == d.columns and row.count() == d.count()


def test_nothing_to_learn_from(spark, tables):
    _, _, d, lab = tables
    none = lab.limit(0)
    for f in (toxicity, quality):
        assert f(d, none).count() == d.count()
        assert f(d.limit(0), lab).count() == 0
    assert {r.score for r in toxicity(d, none).collect()} == {0.5}
    assert quality_rules(d.limit(0), lab).count() == 0
    assert {round(r.score, 9) for r in quality_rules(d, none).collect()} == {0.75}


def brute_counts(text):
    import re

    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_base_counts():
    r = random.Random(2)
    texts = ["", "a", "\n\n", "é x y", "a b c d e f g h " * 3, "x\nx\n \nx \nx", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "#a*b$ %&|<>##"]
    # two words with one CRC, after equal words: no run of eight is repeated
    texts.append("a b c d e f g plumless x y z a b c d e f g buckeroo")
    texts += [" ".join(r.choice(["a", "b", "c", "#", "\n", "\t"]) for _ in range(r.randrange(60))) for _ in range(200)]
    for t in texts:
        assert qr.base_counts(*qr.read(t)[:3]) == brute_counts(t)


def test_quality_rules(tables):
    docs, labels, d, lab = tables
    got = quality_rules(d, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs) + 5
    for i, t, *_ in docs:
        r = by[i]
        n, c, s, l, w = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, c, s, l, w)
        assert r.base_failed == (n < 20 or 100 * w > 30 * n) and (not r.base_failed or not r.kept)
    assert by[1000].base_failed and by[1001].base_failed and by[1002].base_failed
    held = [by[i] for i, *_ in docs if out(i)]
    assert np.mean([r.kept == bool(labels[r.doc_id][0]) for r in held]) > 0.9


def test_quality_rules_fit_sample(spark):
    lab = spark.range(12_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = bounded(teaching(lab, "quality"), qr.FIT_DOCUMENTS).groupBy("y", "calibrates").count().collect()
    assert {(r.y, r.calibrates): r["count"] for r in got} == {(y, c): n for y in (0, 1) for c, n in ((False, 1000), (True, 500))}
    assert qr.EPOCHS == 8


def test_shared_model_is_a_distribution():
    words = ["abra", "abba", "cab", "aac", "b"]
    s = Shared(g for w in words for g in contexts(w))
    letters = sorted({g[1] for w in words for g in contexts(w)})
    for h in ("", BEGIN, "a", "ab", BEGIN + "a"):
        total = sum(s.probability(h, w) for w in letters)
        assert 0.75 < total <= 1 + 1e-9  # what is missing is kept for an unseen letter
    assert CONTEXT >= 2 and END in letters


def test_ratio_prefers_the_class_of_a_word():
    r = Ratio([("idiot", 0, 20), ("the", 50, 50), ("house", 30, 0)])
    assert r.word("idiot") > 2 and r.word("house") < -2 and abs(r.word("the")) < 1 and r.word("日本") == pytest.approx(r.unseen[BEGIN], abs=2)


def test_monotone():
    r = np.random.default_rng(0)
    v, w = r.normal(size=60), r.uniform(1, 3, 60)
    m = q.monotone(v, w)
    assert (np.diff(m) >= 0).all() and np.isclose((m * w).sum(), (v * w).sum())
    better = sum(((v - np.sort(m + r.normal(scale=0.05, size=60))) ** 2 * w).sum() < ((v - m) ** 2 * w).sum() - 1e-9 for _ in range(200))
    assert better == 0


def test_kernel_features_approximate_a_gaussian():
    k = q.Kernel(np.zeros(4), np.ones(4), features=4096)
    r = np.random.default_rng(1)
    x = r.normal(size=(20, 4))
    z = k(x)[:, :-1]
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d2 / 2 * 1.5**2 / 4)).max() < 0.1


def test_logistic_is_the_optimum():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = (r.uniform(size=300) < 1 / (1 + np.exp(-(x @ [1, -2, 0.5] + 0.3)))).astype(float)
    w = logistic(x, y, ridge=0.5)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (p - y) + 0.5 * w[:-1]).max() < 1e-4
