"""Monotone sequences in Elias-Fano form, read in bulk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ONES = np.array([bin(i).count("1") for i in range(256)], "u1")
#: place of the k-th one of each byte
_SELECT = np.zeros((256, 8), "u1")
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_at)] = _at


class EliasFano:
    """values[i] for a non-decreasing sequence: low bits packed, high bits as unary gaps, and the ones before each eight bytes.

    All three are plain arrays, which may be memory maps: nothing is unfolded to read from them.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, rank: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.rank = n, low_bits, low, high, rank

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype("u8")
        bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits, dtype="u8")) & np.uint64(1)).astype("u1"), bitorder="little") if bits else np.zeros(0, "u1")
        at = (values >> np.uint64(bits)).astype("i8") + np.arange(n)
        unary = np.zeros((int(at[-1]) + 64) // 64 * 64 if n else 64, "u1")
        unary[at] = 1
        high = np.packbits(unary, bitorder="little")
        ones = np.cumsum(_ONES[high].reshape(-1, 8).sum(1, dtype="i8"))
        rank = np.concatenate([[0], ones[:-1]])
        return cls(n, bits, np.concatenate([packed, np.zeros(9, "u1")]), high, rank.astype("u4" if n < 1 << 32 else "u8"))

    def get(self, i: np.ndarray) -> np.ndarray:
        """values[i] for an array of places."""
        i = i.astype("i8")
        if not len(i):
            return i
        group = np.searchsorted(self.rank, i.astype(self.rank.dtype), "right") - 1
        left = i - self.rank[group].astype("i8")
        eight = self.high.reshape(-1, 8)[group]
        passed = np.cumsum(_ONES[eight], axis=1, dtype="u1")
        byte = (passed <= left[:, None]).sum(1)
        each = np.arange(len(i))
        left -= np.where(byte > 0, passed[each, byte - 1], 0)
        high = group * 64 + byte * 8 + _SELECT[eight[each, byte], left] - i
        if not self.low_bits:
            return high
        bit = i * self.low_bits
        first = bit >> 3
        word = np.zeros(len(i), "u8")
        for k in range((self.low_bits + 7) // 8 + 1):
            if k < 8:
                word |= self.low[first + k].astype("u8") << np.uint64(8 * k)
        low = (word >> (bit & 7).astype("u8")) & np.uint64((1 << self.low_bits) - 1)
        return high << self.low_bits | low.astype("i8")


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers for transport: their byte planes, compressed."""
    return pa.compress(np.ascontiguousarray(values.view("u1").reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str = "i8") -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), "u1").reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted sequence for transport: its gaps."""
    return pack(np.diff(values.astype("u8"), prepend=np.uint64(0)))


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(data, n, "u8"), dtype="u8")
