import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from vecframe.llm.packing import Packer, WordTokenizer, packing

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def theirs(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_word_memory_equals_the_library():
    texts = ["", " ", "It's WE'LL don't '' 's", "a1b22 ½ x²", "İ ŉ Σας ΣΑΣ", "né é  x\u0085y", "tab\tnew\nline", "日本 語", "<|endoftext|> a", "a!!'s?? #1", "ß ẞ Straße", "\x1c x \x00"]
    texts += [" ".join(random.Random(i).choices(texts, k=5)) for i in range(30)]
    assert [x.tolist() for x in WordTokenizer(PATH).ids(texts)] == [theirs(t) for t in texts]


def check(pieces, docs, capacity, workers):
    """pieces: (doc, start, length, crc, doc tokens, sequence, offset); docs: doc to ids."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p[0]].append(p)
        by_sequence[p[5]].append(p)
        assert p[2] > 0
    for d, ids in docs.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p[1]):
            assert p[1] == at and p[4] == len(ids) and p[3] == zlib.crc32(np.array(ids[at : at + p[2]], "<u4").tobytes())
            at += p[2]
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= workers * capacity // 2


def test_bins():
    r = random.Random(5)
    for n in (0, 1, 2, 40, 400):
        docs = {i: np.array([r.randrange(1000) for _ in range(min(300, int(r.paretovariate(0.7))))], "<u4") for i in range(n)}
        packer, pieces = Packer(64), []
        for d, ids in docs.items():
            pieces += packer.add(d, ids)
        pieces += packer.end()
        check([(d, a, len(x), zlib.crc32(x.tobytes()), len(docs[d]), s, o) for d, a, x, s, o in pieces], docs, 64, 1)


def test_class_bins_take_a_fixed_count():
    packer = Packer(100)
    placed = [p for d in range(3) for p in packer.add(d, np.arange(30, dtype="<u4"))]
    assert [(p[0], p[3], p[4]) for p in placed] == [(0, 0, 0), (1, 0, 30), (2, 0, 60)]
    assert [(p[0], p[1], len(p[2]), p[3], p[4]) for p in packer.add(3, np.arange(30, dtype="<u4"))] == [(3, 0, 10, 0, 90)]


def test_table(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 9000), (5, "x"), (5, "x"), (None, "y z")] + [(i, "some words é " * (i % 50)) for i in range(6, 300)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, length int").repartition(3)
    got = packing(docs, PATH).collect()
    seen = defaultdict(int)
    for r in got:
        seen[r.doc_id] += r.length
        assert r.length == len(r.ids)
    assert all(seen[i] == sum(len(theirs(t or "")) + 1 for j, t in rows if j == i) for i, _ in rows)
    single = {i: theirs(t or "") + [1] for i, t in rows if i not in (5, None)}
    for i, ids in single.items():
        flat = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert flat == ids
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert packing(docs.limit(0), PATH).count() == 0
