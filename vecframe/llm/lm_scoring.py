"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has three levels.  The first holds the training words by hash, with exact counts.  The second holds, for each
word as a context, its successors in order, and the third those of each pair of words that the second holds: Elias-Fano
pointers bound a context's stretch, successors are word ids, and their smoothed probabilities, like the contexts' backoff
weights, are quantised to one byte.  Queries look for a successor relative to its context only.  All levels are dealt over
files, lie in the shared folder and are memory-mapped, as they are, by the tasks that build the next level or score.

Counts come from all training texts: tasks combine what they have read, ship sorted runs, and each part of a level is
merged by one task; what follows a hot context is spread over all parts.  Probabilities are interpolated by absolute
discounting with the next lower level, down to the additive unigram model.  The discounts and the values of the one-byte
codes come from the counts of all parts, so that scores don't depend on how many there are.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop_path, held_out, settle, stage, stage_path, workers_of
from .elias_fano import EliasFano, pack, pack_sorted, unpack, unpack_sorted
from .memory import keeps, using
from .words import numbered

#: Tokens a task counts before it combines, and entries a merge holds before it compacts.
COUNT_TOKENS, MERGE_ENTRIES = 2_000_000, 8_000_000
#: Training tokens of a part of the trie at most, about: more text makes more parts.
PART_TOKENS = 8_000_000
#: A context is hot if it has more than so large a share (one in HOT) of a part's tokens.
HOT = 4
#: Rows, and characters, that are looked up at once.
BATCH_ROWS, BATCH_CHARS = 1024, 4_000_000
#: The hash of the end of a text, the additive constant.
END, ADD = np.uint64(0xE0D), 0.5
#: Steps of log10 probabilities that are counted for the codes: so many, of one GRID-th each.
STEPS, GRID = 4096, 256


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text followed by END, and the number of tokens of each text."""
    h, starts = numbered(texts)
    h[h == END] ^= np.uint64(1)
    n = np.diff(starts) + 1
    out = np.empty(int(n.sum()), "u8")
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(n) - 1] = True
    out[is_end] = END
    out[~is_end] = h
    return out, n


def _summed(part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (part, key), in order, with their counts added up."""
    if len(keys) and (bits := int(keys.max()).bit_length()) + int(part.max()).bit_length() <= 64:
        order = np.argsort(part.astype("u8") << np.uint64(bits % 64) | keys if bits < 64 else keys)
    else:
        order = np.lexsort((keys, part))
    part, keys, counts = part[order], keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])])) if len(keys) else np.zeros(0, "i8")
    return part[first], keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Sorted keys of parts with counts, compacted now and then."""

    def __init__(self, limit: int):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((part, keys, counts))
        self.size += len(keys)
        if self.size > self.limit and len(self.held) > 1:
            self.held = [self.total()]
            self.size = len(self.held[0][0])
            self.limit = max(self.limit, 2 * self.size)

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8")
        return _summed(*(np.concatenate([h[k] for h in self.held]) for k in range(3)))


_RUN = "part int, n long, ids binary, counts binary"
_RUN_TYPES = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])


def _runs(counter: _Counter) -> Iterator[pa.RecordBatch]:
    """The counter's content as one run for each part of the level."""
    part, keys, counts = counter.total()
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if a < z:
            yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), pa.array([z - a]), pa.array([pack_sorted(keys[a:z])], pa.binary()), pa.array([pack(counts[a:z].astype("i8"))], pa.binary())], schema=_RUN_TYPES)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each part's keys and counts, from runs that come sorted by part."""
    part, counter = None, _Counter(MERGE_ENTRIES)
    for batch in batches:
        for i in range(batch.num_rows):
            p, n = batch.column("part")[i].as_py(), batch.column("n")[i].as_py()
            if p != part:
                if part is not None:
                    yield part, *counter.total()[1:]
                part, counter = p, _Counter(MERGE_ENTRIES)
            counter.add(np.zeros(n, "u1"), unpack_sorted(batch.column("ids")[i].as_py(), n), unpack(batch.column("counts")[i].as_py(), n))
    if part is not None:
        yield part, *counter.total()[1:]


def _write(uri: str, name: str, array: np.ndarray) -> None:
    """A file of the shared folder, complete or absent: a second attempt writes the same, and may find the first one's."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    temporary, place = f"{root}/_{name}.{task.taskAttemptId() if task else uuid.uuid4().hex}", f"{root}/{name}"
    with store.open_output_stream(temporary) as f:
        np.save(_Sink(f), array, allow_pickle=False)
    settle(store, temporary, place)


class _Sink:
    def __init__(self, f):
        self.f = f

    def write(self, data) -> int:
        self.f.write(bytes(data))
        return len(data)


_MAPPED: dict[str, np.ndarray] = {}
_COPIES: list[str] = []


def _let_go() -> None:
    _MAPPED.clear()
    while _COPIES:
        shutil.rmtree(_COPIES.pop(), True)


keeps("lm_scoring", _let_go)
atexit.register(_let_go)


def mapped(uri: str, name: str) -> np.ndarray:
    """A file as a memory map: in place where the shared folder is a mounted one, else from this worker's copy, which goes with it."""
    key = f"{uri}/{name}"
    if key not in _MAPPED:
        if len(_MAPPED) > 20_000:
            _let_go()
        if uri.startswith(("file:", "/")):
            path = f"{uri.removeprefix('file://').removeprefix('file:')}/{name}"
        else:
            from pyarrow import fs

            if not _COPIES:
                _COPIES.append(tempfile.mkdtemp(prefix="vecframe-lm-"))
            path = os.path.join(_COPIES[0], f"{len(_MAPPED)}-{name}")
            fs.copy_files(key, f"file://{path}")
        _MAPPED[key] = np.load(path, mmap_mode="r", allow_pickle=False).view(np.ndarray)
    return _MAPPED[key]


def _read(uri: str, name: str) -> np.ndarray:
    """A file that is read once, into memory."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same numbers, none negative, in as few bytes as the largest needs."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(k for k, bits in (("u1", 8), ("u2", 16), ("u4", 32), ("i8", 63)) if most < 1 << bits))


def _deal(runs: DataFrame, parts: int) -> DataFrame:
    return runs.repartition(parts, "part").sortWithinPartitions("part")


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _by_part(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, with the places where."""
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(bounds)).tolist():
        yield p, order[bounds[p] : bounds[p + 1]]


class Words:
    """The first level: ids are places in the order of hashes.  Id `size` is the start of a text, as a context."""

    def __init__(self, uri: str, parts: int, sizes: list[int], total: int):
        self.uri, self.parts, self.total = uri, parts, total
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype("i8")  # id of each part's first word
        self.size = int(self.first[-1])

    def part_of(self, h: np.ndarray) -> np.ndarray:
        """Words by ranges of their hash."""
        return ((h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype("i8")

    def ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: unknown) and count of each of sorted hashes."""
        out, count = np.full(len(h), -1, "i8"), np.zeros(len(h), "i8")
        bounds = np.searchsorted(self.part_of(h), np.arange(self.parts + 1))
        for p in range(self.parts):
            a, b = bounds[p], bounds[p + 1]
            if a == b or self.first[p] == self.first[p + 1]:
                continue
            known, c = mapped(self.uri, f"words-{p}.npy"), mapped(self.uri, f"counts-{p}.npy")
            at = np.searchsorted(known, h[a:b])
            at[at == len(known)] = 0
            hit = known[at] == h[a:b]
            out[a:b][hit] = at[hit] + self.first[p]
            count[a:b][hit] = c[at[hit]]
        return out, count

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted word ids."""
        out = np.zeros(len(ids), "i8")
        bounds = np.searchsorted(ids, self.first)
        for p in range(self.parts):
            a, b = bounds[p], bounds[p + 1]
            if a < b:
                out[a:b] = mapped(self.uri, f"counts-{p}.npy")[ids[a:b] - self.first[p]]
        return out

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / (self.total + ADD * (self.size + 1)))


class Level:
    """Successors of contexts 0 .. contexts - 1, dealt over parts: by context, and those of hot contexts by word."""

    def __init__(self, uri: str, order: int, parts: int, words: int, contexts: int, hot: np.ndarray):
        self.uri, self.order, self.parts, self.words, self.contexts, self.hot = uri, order, parts, words, contexts, hot
        self.bits, self.regular = max(1, words.bit_length()), contexts // parts + 1
        self.local_contexts = self.regular + len(hot)
        self.sizes, self.codes = [0] * parts, np.zeros((2, 256), "f4")
        self._open: dict[int, tuple] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    @property
    def first(self) -> np.ndarray:
        """The number of each part's first entry, over all parts."""
        return np.concatenate([[0], np.cumsum(self.sizes)]).astype("i8")

    def place(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part, and number of the context there."""
        part, local = context % self.parts, context // self.parts
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            hot = self.hot[at] == context
            part = np.where(hot, np.maximum(word, 0) * self.parts // (self.words + 1), part)
            local = np.where(hot, self.regular + at, local)
        return part, local

    def file(self, name: str, p: int) -> np.ndarray:
        return mapped(self.uri, f"{name}{self.order}-{p}.npy")

    def write(self, name: str, p: int, array: np.ndarray) -> None:
        _write(self.uri, f"{name}{self.order}-{p}.npy", array)

    def part(self, p: int) -> tuple:
        if p not in self._open:
            head = self.file("head", p)
            self._open[p] = (EliasFano(int(head[0]), int(head[1]), *(self.file(n, p) for n in ("low", "high", "rank"))), self.file("next", p))
        return self._open[p]

    def find(self, context: np.ndarray, word: np.ndarray, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of the entry of word after context (-1: none), and with lower, log10 of the word's probability at the
        level below, that at this one.  All contexts are known; word -1 is unknown."""
        entry = np.full(len(context), -1, "i8")
        score = None if lower is None else np.array(lower, float)
        part, local = self.place(context, word)
        first = self.first
        for p, at in _by_part(part, self.parts):
            here, w = local[at], word[at]
            if not self.sizes[p]:
                hit = np.zeros(len(at), bool)
            else:
                pointers, successors = self.part(p)
                new = np.concatenate([[True], here[1:] != here[:-1]])  # questions about one context mostly stand together
                low, end = (pointers.get(here[new] + k)[np.cumsum(new) - 1] for k in (0, 1))
                high = end.copy()
                while (open_ := np.flatnonzero(low < high)).size:
                    middle = (low[open_] + high[open_]) >> 1
                    less = successors[middle] < w[open_]
                    low[open_] = np.where(less, middle + 1, low[open_])
                    high[open_] = np.where(less, high[open_], middle)
                hit = low < end
                hit[hit] = successors[low[hit]] == w[hit]
                entry[at[hit]] = low[hit] + first[p]
            if score is not None:
                if hit.any():
                    score[at[hit]] = self.codes[0][self.file("probability", p)[low[hit]]]
                score[at[~hit]] += self.codes[1][self.file("backoff", p)[here[~hit]]]
        return entry, score

    def words_of(self, entries: np.ndarray) -> np.ndarray:
        """The successor that each entry is."""
        out, first = np.zeros(len(entries), "i8"), self.first
        for p, at in _by_part(np.searchsorted(first, entries, "right") - 1, self.parts):
            out[at] = self.file("next", p)[entries[at] - first[p]]
        return out


class Trie:
    """All levels, as they lie below a path of the shared folder."""

    def __init__(self, words: Words, pairs: Level | None = None, triples: Level | None = None):
        self.words, self.pairs, self.triples = words, pairs, triples

    def seen(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the tokens of texts: word ids, counts, and the word that each follows (the start's id for the first)."""
        distinct, where = np.unique(h, return_inverse=True)
        ids, counts = self.words.ids(distinct)
        word = ids[where]
        context = np.concatenate([[self.words.size], word[:-1]])
        context[np.cumsum(n)[:-1]] = self.words.size
        return word, counts[where], context

    def after_two(self, entry: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The pair that each token follows, by the pairs that end with each token; -1 for none, as for a text's first token."""
        out = np.concatenate([[-1], entry[:-1]])
        out[np.cumsum(n)[:-1]] = -1
        return out

    @staticmethod
    def look(level: Level, context: np.ndarray, word: np.ndarray, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """find() for all tokens, each distinct question once; context -1 is unknown."""
        entry, score = np.full(len(context), -1, "i8"), None if lower is None else lower.copy()
        at = np.flatnonzero(context >= 0)
        if len(at) and level.contexts:
            c, w = context[at], word[at]
            fits = (level.contexts + 1).bit_length() + level.bits <= 63
            by = np.argsort(c << level.bits | w & (1 << level.bits) - 1) if fits else np.lexsort((w, c))
            order, c, w = at[by], c[by], w[by]
            new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
            back, pick = np.cumsum(new) - 1, order[new]
            found, s = level.find(context[pick], word[pick], None if lower is None else lower[pick])
            entry[order] = found[back]
            if s is not None:
                score[order] = s[back]
        return entry, score


def _steps(x: np.ndarray) -> np.ndarray:
    return np.clip(-x * GRID, 0, STEPS - 1).astype("u2")


def _codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each step, and the values of the 256 codes: means of groups about equal in entries and steps, a step each where they suffice."""
    code = np.zeros(STEPS, "u1")
    used = np.flatnonzero(counts)
    if not len(used):
        return code, np.zeros(256, "f4")
    share = counts[used] / counts.sum() + 1 / len(used)
    group = np.arange(len(used)) if len(used) <= 256 else ((np.cumsum(share) - share / 2) * 128).astype("i8")
    code[used] = group
    n = np.bincount(group, counts[used], 256)
    return code, (np.bincount(group, counts[used] * -((used + 0.5) / GRID), 256) / np.maximum(n, 1)).astype("f4")


def _discount(once: int, twice: int) -> float:
    """The absolute discount, from how many entries of a level occur once and twice."""
    return min(0.95, max(0.1, once / (once + 2 * twice) if once else 0.5))


def _build_words(texts: DataFrame, uri: str, parts: int) -> Words:
    nothing = Words(uri, parts, [0] * parts, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lm_scoring")
        counter = _Counter(COUNT_TOKENS)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_ROWS, BATCH_CHARS):
                keys, n = np.unique(tokens(_texts(batch))[0], return_counts=True)
                counter.add(nothing.part_of(keys), keys, n)
        yield from _runs(counter)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, keys, counts in _merged(batches):
            _write(uri, f"words-{p}.npy", keys)
            _write(uri, f"counts-{p}.npy", _narrow(counts))
            yield pa.RecordBatch.from_pydict({"part": [p], "n": [len(keys)], "total": [int(counts.sum())]})

    found = _deal(texts.mapInArrow(count, _RUN), parts).mapInArrow(merge, "part long, n long, total long").collect()  # a row for each part
    sizes = {r["part"]: r["n"] for r in found}
    return Words(uri, parts, [sizes.get(p, 0) for p in range(parts)], sum(r["total"] for r in found))


def _hot_words(words: Words, threshold: int, spark) -> np.ndarray:
    """Ids of the words that occur more often: fewer than total / threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("id").to_pylist():
                if words.first[p] < words.first[p + 1]:
                    yield pa.RecordBatch.from_pydict({"id": np.flatnonzero(mapped(words.uri, f"counts-{p}.npy") > threshold).astype("i8") + words.first[p]})

    return np.array(sorted(r["id"] for r in spark.range(0, words.parts, 1, words.parts).mapInArrow(work, "id long").collect()), "i8")


def _build_level(texts: DataFrame, trie: Trie, level: Level, threshold: int) -> np.ndarray:
    """Counts, smooths and writes a level; returns its hot entries, which are contexts of the next."""
    spark, merged, parts = texts.sparkSession, f"{level.uri}-merged", level.parts
    low = np.uint64((1 << level.bits) - 1)

    def asked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of each training token that has a context at this level."""
        h, n = tokens(_texts(batch))
        word, _, context = trie.seen(h, n)
        if level.order == 3:
            context = trie.after_two(trie.look(trie.pairs, context, word)[0], n)
            at = np.flatnonzero(context >= 0)
            context, word = context[at], word[at]
        return context, word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lm_scoring")
        counter = _Counter(COUNT_TOKENS)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_ROWS, BATCH_CHARS):
                context, word = asked(batch)
                part, local = level.place(context, word)
                counter.add(*_summed(part, local.astype("u8") << np.uint64(level.bits) | word.astype("u8"), np.ones(len(word), "i8")))
        yield from _runs(counter)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the parts hold as rows: the part's own (hot -1), and one for each hot context that it has some of."""
        for p, keys, counts in _merged(batches):
            _write(merged, f"keys-{p}.npy", np.frombuffer(pack_sorted(keys), "u1"))
            _write(merged, f"times-{p}.npy", np.frombuffer(pack(counts.astype("i8")), "u1"))
            at = np.searchsorted(keys, np.arange(level.regular, level.local_contexts + 1).astype("u8") << np.uint64(level.bits))
            total = np.concatenate([[0], np.cumsum(counts)])
            hot = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_pydict({
                "part": np.full(len(hot) + 1, p), "hot": np.concatenate([[-1], hot]), "n": np.concatenate([[len(keys)], np.diff(at)[hot]]), "total": np.concatenate([[counts.sum()], (total[at[1:]] - total[at[:-1]])[hot]]),
                "once": np.full(len(hot) + 1, int((counts == 1).sum())), "twice": np.full(len(hot) + 1, int((counts == 2).sum())),
                "often": pa.array([np.flatnonzero(counts > threshold).tolist()] + [[]] * len(hot), pa.list_(pa.int64())),
            })

    found = stage(_deal(texts.mapInArrow(count, _RUN), parts).mapInArrow(merge, "part long, hot long, n long, total long, once long, twice long, often array<long>"), "lm-parts")
    rows = found.where("hot < 0").collect()  # a row for each part
    for r in rows:
        level.sizes[r["part"]] = r["n"]
    discount = _discount(sum(r["once"] for r in rows), sum(r["twice"] for r in rows))
    kinds_hot, heads_hot = np.zeros(len(level.hot)), np.zeros(len(level.hot))
    for r in found.where("hot >= 0").groupBy("hot").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # a row for each hot context
        kinds_hot[r["hot"]], heads_hot[r["hot"]] = r["n"], r["total"]

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes pointers, successors and steps of the probabilities and backoffs; how often each step occurs."""
        using("lm_scoring")
        for batch in batches:
            for p in batch.column("id").to_pylist():
                n = level.sizes[p]
                keys, counts = (f(_read(merged, f"{name}-{p}.npy").tobytes(), n) for f, name in ((unpack_sorted, "keys"), (unpack, "times"))) if n else (np.zeros(0, "u8"), np.zeros(0, "i8"))
                local, word = (keys >> np.uint64(level.bits)).astype("i8"), (keys & low).astype("i8")
                pointers = np.searchsorted(local, np.arange(level.local_contexts + 1))
                heads, kinds = np.bincount(local, counts, level.local_contexts), np.diff(pointers).astype(float)
                heads[level.regular :], kinds[level.regular :] = heads_hot, kinds_hot
                with np.errstate(divide="ignore", invalid="ignore"):
                    backoff = np.where(heads > 0, np.log10(discount * kinds / heads), 0.0)
                e = EliasFano.encode(pointers, n)
                for name, array in (("head", np.array([e.n, e.low_bits])), ("low", e.low), ("high", e.high), ("rank", e.rank), ("next", _narrow(word))):
                    level.write(name, p, array)
                distinct, where = np.unique(word, return_inverse=True)
                lower = trie.words.unigram(trie.words.counts(distinct))[where]
                if level.order == 3:
                    hot = np.concatenate([level.hot, [0]])[np.maximum(local - level.regular, 0)]
                    context = np.where(local < level.regular, local * parts + p, hot)
                    lower = trie.look(trie.pairs, trie.pairs.words_of(context), word, lower)[1]
                probability = np.log10((counts - discount) / heads[local] + 10 ** (backoff[local] + lower))
                for kind, name, x, some in ((0, "probability", probability, slice(None)), (1, "backoff", backoff, heads > 0)):
                    steps = _steps(x)
                    _write(merged, f"{name}-{p}.npy", steps)
                    step, times = np.unique(steps[some], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"kind": np.full(len(step), kind), "step": step.astype("i8"), "n": times})

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("id").to_pylist():
                for name, code in (("probability", codes[0][0]), ("backoff", codes[1][0])):
                    level.write(name, p, code[_read(merged, f"{name}-{p}.npy")])
                yield pa.RecordBatch.from_pydict({"part": [p]})

    every = spark.range(0, parts, 1, parts)
    steps = np.zeros((2, STEPS), "i8")
    for r in stage(every.mapInArrow(model, "kind long, step long, n long"), "lm-steps").groupBy("kind", "step").agg(F.sum("n").alias("n")).collect():  # 2 x STEPS rows at most
        steps[r["kind"], r["step"]] = r["n"]
    codes = [_codes(x) for x in steps]
    level.codes = np.stack([codes[0][1], codes[1][1]])
    every.mapInArrow(quantise, "part long").collect()
    drop_path(spark, merged)
    first = level.first
    return np.array(sorted(int(first[r["part"]]) + k for r in rows for k in r["often"]), "i8")


def build(texts: DataFrame, uri: str, parts: int) -> Trie:
    """The trie of (text) rows."""
    spark = texts.sparkSession
    words = _build_words(texts, uri, parts)
    trie = Trie(words)
    parts = max(parts, words.total // PART_TOKENS)
    threshold = max(1, words.total // (parts * HOT))
    # The start of texts is a context like a word, and may be hot too.
    hot = np.concatenate([_hot_words(words, threshold, spark), [words.size]])
    pairs = Level(uri, 2, parts, words.size, words.size + 1, hot)
    often = _build_level(texts, trie, pairs, threshold)
    trie.pairs = pairs
    triples = Level(uri, 3, parts, words.size, int(sum(pairs.sizes)), often)
    _build_level(texts, trie, triples, threshold)
    trie.triples = triples
    return trie


def lm_scoring(docs: DataFrame, mod: int = 5, rest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: one token, the end.  Texts of any length are scored whole.  A null id is not held out, so
    that its text teaches.  Repeated rows each count in training and get equal scores.  Other columns of docs, whatever
    their names, play no part.  An empty table gives an empty result; if nothing teaches, every word is unknown and both
    scores are those of one symbol out of one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    trie = build(rows.where(~held_out(F.col("doc_id"), mod, rest)).select("text"), stage_path(spark, "lm"), workers_of(spark))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("lm_scoring")
        for whole in batches:
            for batch in slices(whole, "text", BATCH_ROWS, BATCH_CHARS):
                h, n = tokens(_texts(batch))
                word, counts, context = trie.seen(h, n)
                lower = trie.words.unigram(counts)
                entry, score = trie.look(trie.pairs, context, word, lower)
                score = trie.look(trie.triples, trie.after_two(entry, n), word, score)[1]
                doc, size = np.repeat(np.arange(len(n)), n), len(n)
                columns = [n.astype("i8"), np.bincount(doc, counts > 0, size).astype("i8"), np.full(size, trie.words.total), np.bincount(doc, lower, size), np.bincount(doc, score, size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in columns]], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(work, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
