"""Words of texts as 64-bit numbers: runs of bytes other than 09-0D and 20, A-Z in lower case."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of more bytes are hashed one by one.
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
#: what counts of eight bytes, by the number of bytes a word has left
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], "u8")
_STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words(text: bytes | None) -> list[bytes]:
    """The words of one text."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, text after text, and where each text begins (and the last ends) among them.

    A word is read eight bytes at a time, each of which is mixed into what came before.
    """
    b = _LOWER[np.frombuffer(b" ".join([*texts, b"", bytes(8)]), "u1")]
    size = len(b) - 8
    gap = _SPACE[b[:size]]
    begin = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if size else np.zeros(0, "i8")
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]])) if size else np.zeros(0, "i8")
    starts = np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in texts]))
    eight = np.ndarray((size + 1,), "<u8", b.data, 0, (1,))
    length = end - begin
    out = mix((eight[begin] & _MASK[np.minimum(length, 8)]) + length.astype("u8") * _SIZE)
    more = np.flatnonzero((length > 8) & (length <= LONG))
    at = 8
    while len(more):
        out[more] = mix(out[more] * _STEP ^ (eight[begin[more] + at] & _MASK[np.minimum(length[more] - at, 8)]))
        at += 8
        more = more[length[more] > at]
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(b[begin[i] : end[i]].tobytes())
    return out, starts
