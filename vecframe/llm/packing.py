"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document gives full sequences and a rest.  Rests fall in reciprocal-capacity classes: class k holds lengths above
C/(k+1) and up to C/k, and each of its bins takes exactly k of them.  The room that a full bin still has, less than
C/(k+1), is filled with the head of the next document that arrives, so that bins have no padding.  Each worker packs its
input split on its own: nothing is shuffled, and a rerun of a lost task gives the same bins.  What a worker has left at
the end it lays end to end, and the last part it cuts into sequences of powers of two, which need no padding.  So only
the room of a worker's last full bin can stay empty.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .memory import Memory, keeps, still, taken, using

#: Words, and pieces of words, that a worker remembers in each generation: a bound of memory.
MAX_WORDS = 900_000
#: Classes above this one share its bins: rests are short there, and a bin of class k takes k of them.
MAX_CLASS = 64
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_LOADED: dict[str, WordTokenizer] = {}
keeps("packing", _LOADED.clear)


class WordTokenizer:
    """Ids of the tokenizers library, remembered by word.

    The vocabulary's rules cut a text into pieces (below) and look at each on its own.  That cut is made here for texts
    that have only characters whose case and kind all Unicode versions agree on; other texts go to the library whole.
    """

    #: Fixed value: the cut of the vocabulary's own rules.
    piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    unusual = regex.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u0148\\u014a-\\u017e]")

    def __init__(self, path: str, remember: int = MAX_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.words, self.pieces = Memory(None, remember), Memory(None, remember)
        vocabulary = self.library.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _pieces(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces; new ones go to the library together, as words of one text."""
        known = self.pieces.found(words)
        new = [p for p in words if p not in known]
        made: dict[str, bytes] = {}
        for begin in range(0, len(new), 5000):
            part = new[begin : begin + 5000]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                data = ids.tobytes()
                made.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)]))
            else:  # the vocabulary has no end for some letter: each piece on its own
                made.update((p, np.array(self.library.encode(p, add_special_tokens=False).ids, "<u4").tobytes()) for p in part)
        self.pieces.learn(made)
        return known | made

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words; of new ones from the ids of their pieces."""
        words = list(words)
        known = self.words.found(words)
        if len(known) < len(words):
            new = [w for w in words if w not in known]
            plain = [w for w in new if w.isalpha()]  # one piece each
            mixed = [w for w in new if not w.isalpha()]
            split = [self.piece.findall(w) for w in mixed]
            pieces = self._pieces(list(set(plain).union(*split)))
            made = dict(zip(plain, map(pieces.__getitem__, plain)))
            made.update(zip(mixed, [b"".join(taken(pieces, ps)) for ps in split]))
            self.words.learn(made)
            known |= made
        return known

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if self.unusual.search(t) else t.lower().split() for t in texts]
        known = self._words(set().union(*[ws for ws in split if ws]))
        whole = iter(self.library.encode_batch_fast([t for t, ws in zip(texts, split, strict=True) if ws is None], add_special_tokens=False))
        return [np.array(next(whole).ids, "<u4") if ws is None else np.frombuffer(b"".join(taken(known, ws)), "<u4") for ws in split]


class Packer:
    """One worker's bins.  add() and end() yield pieces (document number, start, ids, sequence, offset) as they are placed."""

    def __init__(self, capacity: int):
        self.capacity, self.next_sequence = capacity, 0
        self.bins: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        self.gap: tuple[int, int] | None = None  # sequence and offset of a full bin's room

    def _new(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def add(self, doc: int, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
        at, n, c = 0, len(ids), self.capacity
        if self.gap and n:
            sequence, offset = self.gap
            at = min(n, c - offset)
            yield doc, 0, ids[:at], sequence, offset
            self.gap = (sequence, offset + at) if offset + at < c else None
        while n - at >= c:
            yield doc, at, ids[at : at + c], self._new(), 0
            at += c
        if at < n:
            k = min(c // (n - at), MAX_CLASS)
            held = self.bins.setdefault(k, [])
            held.append((doc, at, ids[at:]))
            if len(held) == k:
                del self.bins[k]
                sequence, offset = self._new(), 0
                for d, a, x in held:
                    yield d, a, x, sequence, offset
                    offset += len(x)
                # a worker has one gap at most: whoever closes a bin has filled the gap before it
                self.gap = (sequence, offset) if offset < c else None

    def end(self) -> Iterator[tuple[int, int, np.ndarray, int, int]]:
        rests = [r for k in sorted(self.bins) for r in self.bins[k]]
        self.bins = {}
        total = sum(len(x) for _, _, x in rests)
        rooms: list[tuple[int, int, int]] = []  # sequence, offset, length
        if self.gap:
            sequence, offset = self.gap
            rooms.append((sequence, offset, self.capacity - offset))
            total -= min(total, self.capacity - offset)
        while total > 0:
            size = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            rooms.append((self._new(), 0, size))
            total -= size
        self.gap = None
        room = 0
        for doc, at, x in rests:
            while len(x):
                sequence, offset, left = rooms[room]
                m = min(left, len(x))
                yield doc, at, x[:m], sequence, offset
                at, x = at + m, x[m:]
                rooms[room] = (sequence, offset + m, left - m)
                room += left == m


def packing(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, remember: int = MAX_WORDS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (keep_ids) the piece's ids.

    A document is its ids and the end id, so that null and empty texts are one token each.  Repeated rows and rows with
    a null id are documents of their own.  remember bounds a worker's memory of words, not the result.  sequence_id has the input split in its upper bits.  An empty table gives an
    empty result.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(SCHEMA).fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("packing")
        if vocabulary not in _LOADED:
            _LOADED[vocabulary] = WordTokenizer(vocabulary, remember)
        tokenizer = _LOADED[vocabulary]
        packer = Packer(capacity)
        first = TaskContext.get().partitionId() << 40
        tail = np.array([end_id], "<u4")
        waiting: dict[int, list] = {}  # id, tokens and open pieces of the documents that bins still hold
        out: list[tuple] = []
        number = 0

        def place(pieces) -> None:
            for doc, at, x, sequence, offset in pieces:
                held = waiting[doc]
                out.append((held[0], at, len(x), zlib.crc32(x.tobytes()), held[1], first + sequence, offset, x))
                held[2] -= len(x)
                if not held[2]:
                    del waiting[doc]

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True))[:7], arrow, strict=False)] if out else [pa.array([], f.type) for f in arrow[:7]]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(r[7]) for r in out])]).astype("i4")
                flat = np.concatenate([r[7] for r in out]).astype("i4") if out else np.empty(0, "i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in arrow])

        arrow = None
        for whole in batches:
            if arrow is None:
                arrow = [pa.field("doc_id", whole.schema.field("doc_id").type), *[pa.field(f.name, pa.int64()) for f in schema.fields[1:7]], *[pa.field("ids", pa.list_(pa.int32()))] * keep_ids]
            for batch in slices(whole, "text", 400, 4_000_000):
                with still():
                    ids = tokenizer.ids([t or "" for t in batch.column("text").to_pylist()])
                for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    x = np.concatenate([x, tail])
                    waiting[number] = [doc_id, len(x), len(x)]
                    place(packer.add(number, x))
                    number += 1
                if out:
                    yield batch_of()
        place(packer.end())
        if out:
            yield batch_of()

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(work, schema)
