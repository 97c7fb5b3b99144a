"""Byte-level BPE encoding and decoding.

Encoding runs a finite-state transducer over the bytes of each pattern match.  Its states are pairs (last token that is
certain, bytes still undecided); states and moves are determinised only when a text first needs them.  A byte's move emits
every token that all continuations share, so that a token leaves after a bounded lookahead (no more than two longest
tokens are ever undecided).  That last tokens of prefixes determine an encoding, and that an encoding is right when each
pair of neighbours is, are known properties of BPE.

Decoding is streaming: ids turn into bytes, and a UTF-8 state machine turns bytes into text as soon as characters end.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import Memory, keeps, still, taken, using

#: States a worker holds before it starts anew, and chunks it remembers in each generation: bounds of memory, not of results.
MAX_STATES = 80_000
MAX_PAIRS = 400_000
MAX_CHUNKS = 900_000
#: Ids that the decoder takes at once: a character may begin in one chunk and end in the next.
DECODE_IDS = 256
#: Rows, and characters, of one output batch.
BATCH_ROWS, BATCH_CHARS = 256, 4_000_000

_LOADED: dict[tuple[str, str], Codec] = {}
keeps("bpe", _LOADED.clear)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _State:
    """What is undecided: the last certain token, the bytes after it, and how their prefixes may be reached."""

    __slots__ = ("back", "end", "last", "live", "next", "pending")

    def __init__(self, last: int, pending: bytes, back: list[tuple[int, int] | None], live: list[int]):
        self.last, self.pending = last, pending
        #: for each prefix of pending its last token and where that begins; None where no chain from the certain part leads
        self.back = back
        #: places where a token may begin that is not complete yet, the end of pending among them
        self.live = live
        self.next: dict[int, tuple] = {}
        self.end: tuple[int, ...] | None = None


class Transducer:
    """Bytes to token ids, one byte a move."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        #: bytes that are a token or begin one: twice the token (-1: none) plus whether a longer token begins so
        self.known = {b[:k]: 2 * ranks.get(b[:k], -1) + 1 for b in ranks for k in range(1, len(b))}
        for b, i in ranks.items():
            self.known.setdefault(b, 2 * i)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, dict[int, list[tuple[bytes, int]]]] = {0: {}, -1: {}}
        self._start_anew()

    def _start_anew(self) -> None:
        self.start = _State(-1, b"", [(-1, 0)], [0])
        self.states = {(-1, b""): self.start}

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition: join the leftmost pair of lowest rank until none, or no more than least parts, are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the token's left (0) or right (-1) end while it is made: parts in order, with the rank that ends each."""
        if (edge := self.edges[side].get(token)) is None:
            whole, edge, until = self.token[token], [], 1 << 60
            while True:
                edge.append((whole, until))
                if len(whole) == 1:
                    break
                until, whole = self.ranks[whole], self.merge(whole, 2)[side]
            edge.reverse()
            self.edges[side][token] = edge
        return edge

    def fits(self, a: int, b: int) -> bool:
        """Token b may follow a: while both are made, no pair across their border comes first."""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            left, right, ranks = self._edge(a, -1), self._edge(b, 0), self.ranks
            i = j = 0
            ok = True
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                across = ranks.get(x + y)
                if across is not None and across < x_until and across <= y_until:
                    ok = False
                    break
                if x_until == y_until == 1 << 60:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            self.pairs[a, b] = ok
        return ok

    @staticmethod
    def _walk(back: list[tuple[int, int] | None], at: int) -> list[int]:
        """Ends of the tokens on the way to a prefix, last first, 0 included."""
        way = [at]
        while at:
            at = back[at][1]
            way.append(at)
        return way

    def _extend(self, pending: bytes, back: list[tuple[int, int] | None], live: list[int], begin: int) -> list[int]:
        """Reads pending from begin on; back grows by each prefix, and the places that live afterwards are returned."""
        known, pairs = self.known, self.pairs
        for n in range(begin + 1, len(pending) + 1):
            found, still = None, []
            for j in live:
                if (code := known.get(pending[j:n])) is None:
                    continue
                if found is None and code >= 0:
                    last, t = back[j][0], code >> 1
                    if last < 0 or ((ok := pairs.get((last, t))) is None and self.fits(last, t)) or ok:
                        found = (t, j)
                if code & 1:
                    still.append(j)
            still.append(n)
            back.append(found)
            live = still
        return live

    def _move(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        pending, back = state.pending + bytes((byte,)), list(state.back)
        live = self._extend(pending, back, state.live, len(state.pending))
        # the furthest place that all ways to live places pass
        cut, ways = live[0], [self._walk(back, j) for j in live]
        for cut in ways[0]:
            if all(cut in w for w in ways):
                break
        out = tuple([back[e][0] for e in self._walk(back, cut)[:-1]][::-1])
        key = (out[-1] if out else state.last, pending[cut:])
        if (to := self.states.get(key)) is None:
            if len(self.states) >= MAX_STATES:
                for old in self.states.values():
                    old.next.clear()  # states refer to each other in circles
                self._start_anew()
            rest = [(key[0], 0), *((b[0], b[1] - cut) if b and b[1] >= cut else None for b in back[cut + 1 :])]
            to = self.states[key] = _State(*key, rest, [j - cut for j in live])
        state.next[byte] = step = to, out
        return step

    def _ended(self, state: _State, rest: bytes) -> list[int]:
        """The tokens still to come when rest is all that follows: the moves that are not determinised, taken at once."""
        pending, back = state.pending + rest, list(state.back)
        self._extend(pending, back, state.live, len(state.pending))
        return [back[e][0] for e in self._walk(back, len(pending))[:-1]][::-1]

    def run(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for i, byte in enumerate(piece):
            if (step := state.next.get(byte)) is None:
                # A move that was wanted before is made for good; a first visitor goes on without.
                state.next[byte] = ()
                return out + self._ended(state, piece[i:])
            if not step:
                step = self._move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        if state.end is None:
            state.end = tuple(self._ended(state, b""))
        out += state.end
        return out


class Utf8Machine:
    """Incremental UTF-8: feed() returns the text that is complete; a byte that can't go on becomes U+FFFD."""

    def __init__(self) -> None:
        self.part, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        at = 0
        while at < len(data):
            if not self.need:  # whole characters at once, up to what needs a closer look
                try:
                    return "".join([*out, data[at:].decode()]) if out or at else data.decode()
                except UnicodeDecodeError as e:
                    out.append(data[at : at + e.start].decode())
                    at += e.start
            out.append(self._step(data[at]))
            at += 1
        return "".join(out)

    def _step(self, b: int) -> str:
        """One byte: what it completes."""
        out = ""
        if self.need:
            if self.low <= b <= self.high:
                self.part.append(b)
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if not self.need:
                    out = self.part.decode()
                    self.part.clear()
                return out
            out = "�"
            self._reset()
        if b < 0x80:
            return out + chr(b)
        if 0xC2 <= b <= 0xF4:
            self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            # overlong forms, surrogates and values past the last code point end at the second byte
            self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            self.part.append(b)
            return out
        return out + "�"

    def end(self) -> str:
        left = "�" if self.need else ""
        self._reset()
        return left

    def _reset(self) -> None:
        self.part.clear()
        self.need, self.low, self.high = 0, 0x80, 0xBF


class Codec:
    """Encoder and decoder for one vocabulary and split pattern."""

    #: White space other than single blanks and line ends inside the text: there the pattern's matches may cross a cut.
    odd_space = regex.compile(r"\s\s|[^\S \n]|\A\s|\s\Z|\x00")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.machine = regex.compile(pattern), Transducer(ranks)
        self.cuts = pattern == public_tokenizers.PATTERN  # the cut below is known to be right for this one only
        self.chunks = Memory(None, MAX_CHUNKS)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b

    def _cut(self, text: str) -> list[str]:
        """Stretches that begin and end where matches do: before each single blank and around each single line end one begins."""
        if not self.cuts or self.odd_space.search(text):
            return self.pattern.findall(text)
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _packed(self, piece: str) -> bytes:
        data = piece.encode()
        known = self.machine.ranks.get(data)
        ids = self.machine.run(data) if known is None else (known,)
        return struct.pack(f"<{len(ids)}i", *ids)

    def _learn(self, chunks: list[str], made: dict[str, bytes]) -> dict[str, bytes]:
        """Adds the ids of new chunks to made: by match, where a chunk has several."""
        split = [(c, self.pattern.findall(c)) for c in chunks]
        several = [(c, ms) for c, ms in split if len(ms) > 1]
        matches = list({m for _, ms in several for m in ms}.difference(made))
        inner = self.chunks.found(matches)
        for m in [*[c for c, ms in split if len(ms) < 2], *[m for m in matches if m not in inner]]:
            if m not in inner:
                inner[m] = made[m] = self._packed(m) if m else b""
        inner |= made
        for c, ms in several:
            made[c] = b"".join(taken(inner, ms))
        return made

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; special tokens' strings are ordinary text."""
        cut = [self._cut(t) for t in texts]
        wanted = list(set().union(*cut))
        known = self.chunks.found(wanted)
        if len(known) < len(wanted):
            made = self._learn([c for c in wanted if c not in known], {})
            self.chunks.learn({c: b for c, b in made.items() if len(c) <= 64})
            known |= made
        return [np.frombuffer(b"".join(taken(known, c)), "<i4") for c in cut]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of chunks of ids, as far as each chunk completes it."""
        machine, table = Utf8Machine(), self.bytes
        for part in ids:
            yield machine.feed(b"".join([table[i] for i in part]))
        yield machine.end()


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def slices(batch: pa.RecordBatch, text_col: str, most_rows: int = BATCH_ROWS, most_chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few rows and characters each."""
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    begin = chars = 0
    for i, n in enumerate(size):
        if i > begin and (i - begin >= most_rows or chars + n > most_chars):
            yield batch.slice(begin, i - begin)
            begin, chars = i, 0
        chars += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def bpe(docs: DataFrame, vocabulary: str, pattern: str, decode: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, token ids, and (decode) the text that the ids decode to.

    Null text counts as empty, which has no tokens and decodes to the empty text.  Texts of any length are whole; their ids
    are decoded in chunks of DECODE_IDS.  Rows are never joined or compared, so repeated rows and null ids simply come
    back.  Other columns of docs, whatever their names, play no part.  An empty table gives an empty result.
    """
    fields = [("doc_id", docs.schema[id_col].dataType), ("ids", T.ArrayType(T.IntegerType()))] + [("decoded", T.StringType())] * decode
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("bpe")
        c = codec(vocabulary, pattern)
        for whole in batches:
            for batch in slices(whole, "text", 400, 4_000_000):
                with still():
                    ids = c.encode_all([t or "" for t in batch.column("text").to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                flat = np.concatenate(ids) if ids else np.empty(0, "i4")
                columns = [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))]
                if decode:
                    columns.append(pa.array(["".join(c.decode(x[k : k + DECODE_IDS].tolist() for k in range(0, len(x), DECODE_IDS))) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, schema)
