"""Quality rules: counted base rules, and a hashed n-gram logistic regression for what they let pass.

Words, word pairs and short character runs are hashed into one table of weights.  A document's raw score is the sum, over
these families, of the mean weight of its n-grams; logistic regression learns the weights on a bounded sample of labelled
documents, a second sample calibrates the probability, and all documents are scored in Arrow batches against a fixed
threshold.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .classify import bounded, logistic, sigmoid, teaching
from .memory import using

#: Fixed values of the base rules: symbols, words of a window (a power of two), fewest words, largest share (per cent) of repeated words.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: A document passes the classifier from here.
THRESHOLD = 0.5
#: Bits of a hash, lengths of character n-grams, documents of each label in the fit sample (half as many calibrate), passes over it, step.
BITS, CHARACTERS, FIT_DOCUMENTS, EPOCHS, STEP = 18, (3, 4), 1000, 8, 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), "u8", len(words))


def _hashed(x: np.ndarray, family: int) -> np.ndarray:
    return (((x + np.uint64(family + 1)) * _MIX) >> np.uint64(64 - BITS)).astype("i4")


def families(data: bytes, codes: np.ndarray) -> list[np.ndarray]:
    """Table places of the n-grams of each family: words, word pairs, character n-grams of each length."""
    out = [_hashed(codes, 0), _hashed(codes[:-1] * _MIX + codes[1:], 1) if len(codes) > 1 else np.empty(0, "i4")]
    b = np.frombuffer(data.lower(), "u1").astype("u8")
    for k in CHARACTERS:
        if len(b) < k:
            out.append(np.empty(0, "i4"))
            continue
        x = b[: len(b) - k + 1].copy()
        for i in range(1, k):
            x |= b[i : len(b) - k + 1 + i] << np.uint64(8 * i)
        out.append(_hashed(x, k))
    return out


def windows(words: list[bytes]) -> np.ndarray:
    """A number for each run of WINDOW words: equal for equal runs, and only for those."""
    seen: dict[bytes, int] = {}
    x = np.fromiter((seen.setdefault(w, len(seen)) for w in words), "i8", len(words))
    held = 1
    while held < WINDOW:  # runs of twice the length, by the numbers of their halves
        left, right = x[:-held], x[held:]
        x = np.unique(left * (int(x.max()) + 1) + right, return_inverse=True)[1]
        held *= 2
    return x


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > WINDOW and len(set(words)) < n:
        _, where, count = np.unique(windows(words), return_inverse=True, return_counts=True)
        twice = np.flatnonzero(count[where] > 1)
        if len(twice):
            step = np.zeros(n + 1, "i8")
            np.add.at(step, twice, 1)
            np.add.at(step, twice + WINDOW, -1)
            repeated = int((np.cumsum(step) > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def read(text: str | None) -> tuple[str, bytes, list[bytes], np.ndarray]:
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at 09-0D and 20 only
    return text, data, words, word_codes(words)


class Model:
    def __init__(self, weights: np.ndarray, slope: float, intercept: float):
        self.weights, self.slope, self.intercept = weights.astype("f4"), slope, intercept

    def raw(self, data: bytes, codes: np.ndarray) -> float:
        return sum(float(self.weights[f].mean()) for f in families(data, codes) if len(f))

    def score(self, raw: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * raw + self.intercept)


def _sampled(docs: DataFrame, sample: DataFrame) -> list[tuple[int, bool, np.ndarray, np.ndarray]]:
    """y, calibrates, table places and their values of each sampled document, in the order of ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                places, values = [], []
                for text in batch.column("text").to_pylist():
                    _, data, _, codes = read(text)
                    found = [f for f in families(data, codes) if len(f)]
                    at, where = np.unique(np.concatenate(found), return_inverse=True) if found else (np.empty(0, "i4"), None)
                    places.append(at.tobytes())
                    values.append((np.bincount(where, np.concatenate([np.full(len(f), 1 / len(f)) for f in found])) if found else np.empty(0)).astype("f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("calibrates"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "y", "calibrates", "places", "mass"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.join(sample, "doc_id").select("doc_id", "text", "y", "calibrates").mapInArrow(work, f"doc_id {kind}, y int, calibrates boolean, places binary, mass binary").toArrow()
    seen: dict = {}  # rows with one id teach once
    for doc, *rest in sorted(zip(*[table.column(c).to_pylist() for c in ("doc_id", "y", "calibrates", "places", "mass")], strict=True)):
        seen.setdefault(doc, rest)
    return [(y, c, np.frombuffer(p, "i4"), np.frombuffer(v, "f4")) for y, c, p, v in seen.values()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Learns from (doc_id, text) and the labels that teach.  Without labels of both kinds every score is 0.75: nothing is known against a text."""
    rows = _sampled(docs, bounded(teaching(labels, label), fit_documents))
    fits, rest = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    weights = np.zeros(1 << BITS)
    if len({r[0] for r in fits}) < 2 or len({r[0] for r in rest}) < 2:
        return Model(weights, 0.0, float(np.log(3)))
    order = np.random.default_rng(7)
    squares = np.full(len(weights), 1e-6)
    intercept = 0.0
    share = sum(r[0] for r in fits) / len(fits)
    for _ in range(EPOCHS):
        places = order.permutation(len(fits))
        for begin in range(0, len(fits), 16):
            part = [fits[i] for i in places[begin : begin + 16]]
            y = np.array([r[0] for r in part], float)
            raw = np.array([weights[r[2]] @ r[3] for r in part]) + intercept
            g = (sigmoid(raw) - y) * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
            at = np.concatenate([r[2] for r in part])
            at, where = np.unique(at, return_inverse=True)
            d = np.bincount(where, np.concatenate([r[3] * x for r, x in zip(part, g, strict=True)]))
            squares[at] += d * d
            weights[at] -= STEP * d / np.sqrt(squares[at])
            intercept -= 0.05 * g.mean()
    raw = np.array([weights[r[2]] @ r[3] for r in rest])
    y = np.array([r[0] for r in rest], float)
    scale = raw.std() + 1e-9
    w = logistic(raw[:, None] / scale, y, ridge=0.01)
    return Model(weights, float(w[0] / scale), float(w[1]))


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """A row per row of docs: doc_id, the base counts, base_failed, kept, score.

    Null text has no words and counts like an empty text: base_failed, so not kept.  Texts of any length count whole.  A
    null id is treated like any other.  Repeated rows get equal results, and rows that share an id each their own.  Other
    columns of docs, whatever their names, play no part.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    shipped = rows.sparkSession.sparkContext.broadcast(fit(rows, labels, label, fit_documents))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality_rules")
        model = shipped.value
        for whole in batches:
            for batch in slices(whole, "text"):
                counts, raw = [], []
                for t in batch.column("text").to_pylist():
                    text, data, words, codes = read(t)
                    counts.append(base_counts(text, data, words))
                    raw.append(model.raw(data, codes))
                c = np.array(counts, "i8").reshape(len(raw), len(names))
                score = model.score(np.array(raw))
                failed = (c[:, 0] < LEAST_WORDS) | (100 * c[:, 4] > MOST_REPEATED * c[:, 0])
                columns = [batch.column("doc_id"), *[pa.array(c[:, i]) for i in range(len(names))], pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, score double")
