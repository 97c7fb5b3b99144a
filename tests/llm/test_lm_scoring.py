import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from vecframe.llm import lm_scoring as lm
from vecframe.llm.common import stage_path
from vecframe.llm.elias_fano import EliasFano, pack_sorted, unpack_sorted

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


@pytest.mark.parametrize("n, universe", [(0, 0), (1, 0), (1, 10**6), (50, 49), (1000, 10**9), (5000, 300), (3, 2**40)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, universe + 1, n))
    e = EliasFano.encode(v, universe)
    at = r.integers(0, n, 200) if n else np.zeros(0, "i8")
    assert (e.get(at) == v[at]).all() and (e.get(np.arange(n)) == v).all()
    u = np.sort(r.integers(0, 2**63, n).astype("u8"))
    assert (unpack_sorted(pack_sorted(u), n) == u).all()


def test_tokens():
    texts = ["", "a b", "  A\tb\n", "é É x y", "a", "long " * 500]
    h, n = lm.tokens([t.encode() for t in texts])
    want = [words(t) for t in texts]
    assert n.tolist() == [len(w) for w in want]
    name = {}
    for x, w in zip(h.tolist(), [w for ws in want for w in ws], strict=True):
        assert name.setdefault(x, w) == w
    assert len(set(name.values())) == len(name)


def make(seed=1, n=150):
    r = random.Random(seed)
    v = [f"w{i}" for i in range(60)]
    return [(i, " ".join(v[min(59, int(r.paretovariate(0.6)) - 1)] for _ in range(r.randrange(40)))) for i in range(n)] + [(500, None), (501, ""), (502, "Only HERE once"), (503, "w1 " * 20_000)]


def trained(rows):
    """Counts of words, of successors of words, and of successors of pairs, from the rows that teach."""
    c, levels = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(2)]
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ts = words(t)
            c.update(ts)
            for k, w in enumerate(ts):
                levels[0][ts[k - 1] if k else "start"][w] += 1
                if k:
                    levels[1][ts[k - 2] if k > 1 else "start", ts[k - 1]][w] += 1
    return c, levels


def score_of(ts, c, levels):
    """log10 probabilities by the definition: absolute discounting, interpolated down to the additive unigrams."""
    times = [collections.Counter(n for h in level.values() for n in h.values()) for level in levels]
    ds = [t[1] / (t[1] + 2 * t[2]) for t in times]
    assert [lm._discount(t[1], t[2]) for t in times] == ds
    out = 0.0
    for k, w in enumerate(ts):
        p = (c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))
        contexts = [ts[k - 1] if k else "start"] + ([(ts[k - 2] if k > 1 else "start", ts[k - 1])] if k else [])
        for level, d, h in zip(levels, ds, contexts, strict=False):
            if h in level:
                n = sum(level[h].values())
                p = max(level[h][w] - d, 0) / n + d * len(level[h]) / n * p
        out += math.log10(p)
    return out


def test_scores_are_the_models_however_many_parts(spark):
    rows = make()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(3)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got.append({r.doc_id: r for r in lm.lm_scoring(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in got[1:]:
        assert {i: r.score for i, r in got[0].items()} == pytest.approx({i: r.score for i, r in other.items()}, rel=1e-6)
    toks = {i: words(t) for i, t in rows}
    teach = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    c, levels = trained(rows)
    total, kinds = sum(c.values()), len(c)
    uni = lambda w: (c[w] + 0.5) / (total + 0.5 * (kinds + 1))
    assert set(got[0]) == set(toks)
    for i, ts in toks.items():
        r = got[1][i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in teach, len(ts), sum(w in c for w in ts), total)
        assert math.isclose(r.base_score, sum(math.log10(uni(w)) for w in ts), rel_tol=1e-9)
        # a code stands for a few steps of 1 / GRID at most, here
        assert abs(score_of(ts, c, levels) - r.score) / len(ts) < 4 / lm.GRID
    held = [got[0][i] for i in toks if i not in teach and i < 500]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 50


def test_repeated_texts_score_higher_by_longer_contexts(spark):
    """Texts that the corpus repeats are told apart by what follows pairs of words."""
    r = random.Random(5)
    v = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(v) for _ in range(60))) for i in range(60)]
    free = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 5 == 1]
    twice = [(i, rows[k][1]) for k, i in enumerate(free[:10]) if zlib.crc32(str(k).encode()) % 5 != 1]
    alone = [(i, " ".join(r.choice(v) for _ in range(60))) for i in free[10:20]]
    got = {x.doc_id: x.score for x in lm.lm_scoring(spark.createDataFrame(rows + twice + alone, "doc_id long, text string")).collect()}
    assert min(got[i] for i, _ in twice) > max(got[i] for i, _ in alone)


def test_hot_contexts_are_spread(spark):
    """One context with most of the successors: its entries are in many parts, and scores don't change."""
    rows = [(i, " ".join(f"the n{i * 50 + k}" for k in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        trie = lm.build(docs.select("text"), stage_path(spark, "lm-test"), 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(trie.pairs.hot) >= 2 and max(trie.pairs.sizes) < 2.5 * sum(trie.pairs.sizes) / 20


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert lm.lm_scoring(spark.createDataFrame([], schema)).count() == 0
    got = lm.lm_scoring(spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a")], schema)).collect()
    assert len(got) == 3 and {r.held_out for r in got if r.doc_id is None} == {False}
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm.lm_scoring(spark.createDataFrame([(alone, "a b")], schema)).collect()
    assert (r.train_tokens, r.n_known, r.n_tokens, r.base_score, r.score) == (0, 0, 3, 0.0, 0.0)
