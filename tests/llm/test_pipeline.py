import math
import os

import numpy as np

import corpus_pipeline as cp
from vecframe.llm import quality as q
from vecframe.llm import toxicity as t
from vecframe.llm.common import stage
from vecframe.llm.ngram_join import ngram_join
from vecframe.llm.quality import quality
from vecframe.llm.toxicity import toxicity

from test_classifiers import SCHEMA, corpus
from test_exact_dedup import normal
from test_ngram_join import brute
from test_packing import check, theirs

DATA = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    steps = dict(cp.STAGES)
    a = stage(steps["toxicity"](spark, docs, DATA), "t")
    assert a.columns == docs.columns and ids(a) == ids(toxicity(docs, labels).where("predicted = 0"))
    b = stage(steps["quality"](spark, a, DATA), "t")
    assert b.columns == docs.columns and ids(b) == ids(quality(a, labels).where("predicted = 1"))
    c = stage(steps["exact_dedup"](spark, b, DATA), "t")
    least = {}
    for r in b.collect():
        least[normal(r.text)] = min(least.get(normal(r.text), r.doc_id), r.doc_id)
    assert c.columns == docs.columns and ids(c) == sorted(least.values())
    e = stage(steps["near_duplicates"](spark, c, DATA), "t")
    want = brute([(r.doc_id, r.text) for r in c.collect()], cp.SHINGLE_WORDS, cp.SIMILAR_PER_CENT)
    assert e.columns == docs.columns and ids(e) == sorted(i for i, (_, root) in want.items() if root == i)
    assert ngram_join(c, cp.SHINGLE_WORDS, cp.SIMILAR_PER_CENT).count() == c.count()
    packed = steps["packing"](spark, e, DATA).collect()
    assert sorted({r.doc_id for r in packed}) == ids(e)
    assert all(len(r.ids) == r.length for r in packed)


def test_run(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "exact_dedup", "near_duplicates", "packing"]
    assert cp.run(spark, DATA).count() > 0
    assert os.path.exists(f"{DATA}/documents.parquet")


def toxic_score(model, text):
    """The fitted model's score of one text, in plain Python."""
    words = (text or "").lower().split()
    x = [0.0] * t.FEATURES
    if words:
        own = {w: model.ratio.word(w) for w in words}
        best = sorted(own.values(), reverse=True)
        over = [max(v - t.CLEAR, 0) for v in best]
        x = [sum(own[w] for w in words) / len(words), *[sum(best[:k]) / min(k, len(best)) for k in t.STRONGEST]]
        x += [sum(over) / len(best), sum(min(v, t.LIMIT) for v in over) / math.sqrt(len(best)), math.log(len(best))]
    z = model.weights[-1] + sum((a - m) / s * w for a, m, s, w in zip(x, model.mean, model.scale, model.weights[:-1], strict=True))
    return 1 / (1 + math.exp(-z))


def quality_score(model, text):
    k = model.kernel
    z = [min(max((a - m) / s, -8), 8) for a, m, s in zip(q.statistics(text or ""), k.mean, k.scale, strict=True)]
    f = [math.cos(sum(a * d for a, d in zip(z, k.directions[:, j], strict=True)) + k.phases[j]) * math.sqrt(2 / len(k.phases)) for j in range(len(k.phases))]
    return float(np.interp(sum(a * w for a, w in zip([*f, 1.0], model.weights, strict=True)), *model.curve))


def clear(scores, threshold):
    """Rows at or over the threshold; the fixture has none so close to it that rounding could decide."""
    assert all(abs(s - threshold) > 1e-7 for s in scores)
    return [s >= threshold for s in scores]


def test_run_equals_its_twin_in_plain_python(spark, tmp_path):
    docs, labels = corpus(seed=4, n=240)
    more = [(1000 + k, docs[k][1].replace(" ", "\t ", 3)) for k in range(0, 60, 2)] + [(2000 + k, docs[k][1] + " changed") for k in range(0, 90, 3)]
    more += [(3000, None), (3001, ""), (3002, " \n"), (3003, "long words here " * 20_000), (None, docs[7][1] + " " + docs[8][1])]
    rows = docs + [(i, x, 0.0, "", 9) for i, x in more]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    lab = spark.read.parquet(f"{tmp_path}/labels.parquet")
    table = lambda kept: spark.createDataFrame(kept, "doc_id long, text string")

    left = [(i, x) for i, x, *_ in rows]
    sizes = [len(left)]
    model = t.fit(table(left), lab)
    left = [r for r, bad in zip(left, clear([toxic_score(model, x) for _, x in left], t.THRESHOLD), strict=True) if not bad]
    sizes.append(len(left))
    model = q.fit(q.tabulated(table(left)), lab)
    left = [r for r, good in zip(left, clear([quality_score(model, x) for _, x in left], q.THRESHOLD), strict=True) if good]
    sizes.append(len(left))
    stays = {}
    for i, x in sorted(left, key=lambda r: (r[0] is None, r[0])):
        stays.setdefault(normal(x), (i, x))
    left = list(stays.values())
    sizes.append(len(left))
    root = brute([r for r in left if r[0] is not None], cp.SHINGLE_WORDS, cp.SIMILAR_PER_CENT)
    left = [(i, x) for i, x in left if i is None or root[i][1] == i]
    sizes.append(len(left))
    assert all(a > b for a, b in zip(sizes, sizes[1:]))  # each stage has something to do

    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left}
    ids = {i: np.array(theirs(x or "") + [1], "<u4") for i, x in left}
    check([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in got], ids, 2048, len({r.sequence_id for r in got}))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    assert all(list(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tolist() for r in got)


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, step in cp.STAGES:
        docs = stage(step(spark, docs, DATA), "t")
    assert docs.count() == 0
