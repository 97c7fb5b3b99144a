import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.Codec(RANKS, P.PATTERN)
HARD = ["", " ", "\n", "  a", "a  b", "a\n\nb", " lead", "trail ", "it's 'S we'll", "a\tb", "é ü ñ çà", "日本語テキスト", "👩‍👩‍👧 ok", "a" * 5000, "<|endoftext|>", "x y", "1234567 89", "\r\nx\r\n y", "ab" * 999 + "!!" * 77, "\x00\x01", "a \n b", "zażółć gęślą"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    ids = OURS.encode(text).tolist()
    assert ids == THEIRS.encode_ordinary(text)
    assert "".join(OURS.decode([[i] for i in ids])) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abeinorst AB\n\t.,'!é日0123 "), max_size=80) | st.text(max_size=40))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    ids = OURS.encode(text).tolist()
    assert ids == THEIRS.encode_ordinary(text)
    assert "".join(OURS.decode([ids])) == text


def test_forgetting_states_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 1)
    ours = bpe.Codec(RANKS, P.PATTERN)
    text = "Incomprehensibilities undoubtedly necessitate reconsideration zzxqj"
    assert ours.encode(text).tolist() == THEIRS.encode_ordinary(text)


def test_pairs_fit_as_the_merges_say():
    m, r = OURS.machine, random.Random(3)
    tokens = [t for t in range(50256)]
    common = [RANKS[x] for x in (b"a", b"aa", b"aaaa", b" the", b"the", b"ing", b"ation", b" ", b"--", b"----", b"th", b"e", b"er")]
    for _ in range(20000):
        a, b = r.choice(common if r.random() < 0.3 else tokens), r.choice(common if r.random() < 0.3 else tokens)
        assert m.fits(a, b) == ([RANKS[x] for x in m.merge(m.token[a] + m.token[b])] == [a, b]), (m.token[a], m.token[b])


@given(st.binary(max_size=30), st.integers(1, 5))
def test_utf8_machine_is_pythons(data, step):
    m = bpe.Utf8Machine()
    assert "".join([*(m.feed(data[i : i + step]) for i in range(0, len(data), step)), m.end()]) == data.decode(errors="replace")


def test_other_patterns_are_not_cut():
    """A pattern whose matches cross blanks and line ends."""
    pattern = r"[^x]+|x+"
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS, special_tokens={})
    for text in HARD:
        assert bpe.Codec(RANKS, pattern).encode(text).tolist() == theirs.encode_ordinary(text)


def test_characters_that_chunks_of_ids_split():
    for text in ("日本語テキスト" * 40, "👩‍👩‍👧" * 40, "aé" * 200):
        ids = OURS.encode(text).tolist()
        for k in (1, 2, 3, 7):
            assert "".join(OURS.decode(ids[i : i + k] for i in range(0, len(ids), k))) == text


def test_table(spark):
    rows = [(1, "a b"), (1, "a b"), (None, None), (3, ""), (4, "né " * 3000), (5, "日本語👧" * 900)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int")
    got = bpe.bpe(docs, PATH, P.PATTERN).collect()
    assert sorted(map(repr, ((r.doc_id, r.ids, r.decoded) for r in got))) == sorted(map(repr, ((i, THEIRS.encode_ordinary(t or ""), t or "") for i, t in rows)))
    assert bpe.bpe(docs.limit(0), PATH, P.PATTERN).count() == 0
