import random
import re

import numpy as np
import pytest

from vecframe.llm.components import connected_components
from vecframe.llm.ngram_join import Bound, Union, forest, ngram_join, part_hashes, shingles, trie_links

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, per_cent):
    """Component of each id, by comparing all with all."""
    sets = brute_sets([t for _, t in rows], n)
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                i, j = root(rows[a][0]), root(rows[b][0])
                up[max(i, j)] = min(i, j)
    return {i: (len(s), root(i)) for (i, _), s in zip(rows, sets)}


def texts(seed, count):
    r = random.Random(seed)
    out = []
    for _ in range(count):
        if out and r.random() < 0.7:
            w = r.choice(out).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randrange(2)] = [f"v{r.randrange(50)}"] * r.randrange(2)
            out.append(" ".join(w))
        else:
            out.append(" ".join(f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 3, 9, 10, 11, 12, 20, 40, 120]))))
    return out


@pytest.mark.parametrize("n, per_cent", [(3, 90), (5, 80), (1, 50)])
def test_sets_that_link_share_a_part_and_the_trie_finds_all_links(n, per_cent):
    for seed in range(4):
        ts = texts(seed, 90)
        sets = [s for s in shingles([t.encode() for t in ts], n)]
        assert [len(s) for s in sets] == [len(s) for s in brute_sets(ts, n)]
        bound = Bound(per_cent)
        ids = [i for i, s in enumerate(sets) if len(s)]
        turns = [{i: set(part_hashes(sets[i], bound, t).tolist()) for i in ids} for t in (0, 1)]
        want = set()
        for a in ids:
            for b in ids:
                common = len(set(sets[a].tolist()) & set(sets[b].tolist()))
                if a < b and 100 * common >= per_cent * (len(sets[a]) + len(sets[b]) - common):
                    want.add((a, b))
                    assert all(parts[a] & parts[b] for parts in turns)
        assert {(min(x), max(x)) for x in trie_links(sets, ids, ids, bound, all_links=True)} == want


@pytest.mark.parametrize("n, per_cent", [(3, 90), (5, 80)])
def test_table_against_all_pairs(spark, monkeypatch, n, per_cent):
    from vecframe.llm import ngram_join as module

    monkeypatch.setattr(module, "BLOCK_SETS", 5)  # so that blocks have a second turn and are cut into portions
    rows = list(enumerate(texts(9, 150)))
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1003, " \t\n"), (1004, "one two"), (1005, "One  TWO"), (1006, "É é"), (1007, "long words here " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs, n, per_cent).collect()}
    assert got == brute(rows, n, per_cent)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (None, 0, None)], key=repr)
    assert ngram_join(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="2\\^62"):
        ngram_join(spark.createDataFrame([(1 << 62, "a")], "doc_id long, text string")).collect()


def test_rows_without_id_link_others(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(w)), (None, " ".join([*w, "x"])), (3, " ".join([*w, "x", "y"])), (None, "p q r s t u"), (None, "p q r s t u v w x y")]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 98).collect()), key=repr)
    assert got == sorted([(7, 3), (None, 3), (3, 3), (None, None), (None, None)], key=repr)


def test_words_that_polynomials_modulo_powers_of_two_confuse(spark):
    """Thue-Morse words of 4,096 letters: two different ones, and documents that share nothing."""
    bits = [bin(i).count("1") & 1 for i in range(4096)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    docs = spark.createDataFrame([(1, f"{one} {one} {one} {one}x {one}"), (2, f"{two} {two} {two} {two}x {two}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_join(docs).collect()) == [(1, 1), (2, 2)]


def test_links_are_checked_by_words(spark, monkeypatch):
    """Even if all words had one number, sets that share no words stay apart."""
    from vecframe.llm import ngram_join as module

    sets = [np.array([1, 2, 3], "u8")] * 2
    assert trie_links(sets, [0, 1], [0, 1], Bound(90)) in ([(0, 1)], [(1, 0)])
    assert trie_links(sets, [0, 1], [0, 1], Bound(90), exact=lambda i, j: False) == []
    assert module.true_shingles(b"A b  c", 2) == {(b"a", b"b"), (b"b", b"c")} and module.true_shingles(b" a ", 2) == {(b"a",)} and module.true_shingles(b" ", 2) == set()


@pytest.mark.parametrize("n, per_cent", [(3, 90), (5, 80)])
def test_large_group_of_near_copies(spark, n, per_cent):
    """Thousands of near copies of one text, a long chain, and lone texts, in a table whose keys all tasks share."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(5000 - i, " ".join([*base, f"u{i}"])) for i in range(1500)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(9000 + i, " ".join(chain[i : i + 150])) for i in range(50)]
    rows += [(9500 + i, " ".join(f"z{r.randrange(10**6)}" for _ in range(40))) for i in range(50)]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n, per_cent).collect()}
    assert got == {i: 3501 if i <= 5000 else 9000 if i < 9500 else i for i, _ in rows}


def test_forest():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 80):
        edges = r.integers(0, 60, (n, 2))
        got = forest(edges)
        union = Union(60)
        for a, b in edges:
            union.join(int(a), int(b))
        assert sorted(map(tuple, got.tolist())) == sorted((union.root(i), i) for i in {*edges.reshape(-1).tolist()} if union.root(i) != i)


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(500, 501), (501, 500), (7, 7), (None, 3)] + [(1000 + r.randrange(60), 1000 + r.randrange(60)) for _ in range(50)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        return i if up[i] == i else root(up[i])

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {(x.node, x.root) for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, root(i)) for i in list(up)}
