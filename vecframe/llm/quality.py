"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each document becomes a short vector of statistics.  Random Fourier features approximate a Gaussian kernel over them;
each partition sums its part of the normal equations, Spark adds the parts up row by row, and the driver solves one
system of fixed size.  Labelled documents outside the fit calibrate the scores: counts in fixed bins of the raw score,
made monotone by pooling adjacent violators.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .classify import teaching
from .common import carried, held_out, stage
from .memory import using

#: Features, ridge penalty for each teaching row, bins of the raw score, seed: fixed values of the method.
FEATURES, RIDGE, BINS, SEED = 256, 1e-4, 2000, 20240101
#: From here a document counts as good.
THRESHOLD = 0.7
#: Kinds of bytes that are counted: name and members.
KINDS = (
    ("digit", b"0123456789"),
    ("upper", bytes(range(65, 91))),
    ("lower", bytes(range(97, 123))),
    ("space", b" "),
    ("line", b"\n"),
    ("stop", b".,;:?'\"-"),
    ("bang", b"!"),
    ("symbol", b"#*$%&|<>{}[]()=_@~^+/\\"),
    ("high", bytes(range(128, 256))),
)
NAMES = ("log_words", "log_lines", "word_length", "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "words_in_line", "capital_words", "odd_words", *(f"share_{k}" for k, _ in KINDS))
_TABLE = np.zeros(256, "u1")
for _i, (_, _members) in enumerate(KINDS):
    _TABLE[list(_members)] = _i + 1
_PLAIN = re.compile(r"[^\W\d_]+[.,;:?!]?\Z")


def statistics(text: str) -> list[float]:
    """The document's vector: counts as logarithms, everything else as shares and means.  All 0 for an empty text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text.encode(), "u1")
    shares = np.bincount(_TABLE[data], minlength=len(KINDS) + 1)[1:] / len(data)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    counts = Counter(words)
    kinds = len(counts)
    odd = sum(c for w, c in counts.items() if not _PLAIN.match(w))
    capital = sum(c for w, c in counts.items() if w[0].isupper())
    pairs = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    return [np.log1p(n), np.log1p(len(lines)), min(sum(map(len, counts)) / kinds, 50.0), kinds / n, max(counts.values()) / n, pairs, len(set(lines)) / len(lines), np.log1p(n / len(lines)), capital / n, odd / n, *shares.tolist()]


def tabulated(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, x array<double>), and with carry row, of (doc_id, text)."""
    extra = ["doc_id", *["row"] * carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("quality")
        for whole in batches:
            for batch in slices(whole, "text"):
                x = [statistics(t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(x, pa.list_(pa.float64()))], names=[*extra, "x"])

    return docs.mapInArrow(work, T.StructType([*[docs.schema[c] for c in extra], T.StructField("x", T.ArrayType(T.DoubleType()))]))


class Kernel:
    """Random Fourier features: cosines of random projections of the standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED):
        r = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.directions = r.normal(size=(d, features)) / np.sqrt(d) * 1.5
        self.phases = r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(x))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(NAMES))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    at = [F.element_at("x", i + 1) for i in range(len(NAMES))]
    r = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)]).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(NAMES))])
    scale = np.array([r[f"s{i}"] or 0.0 for i in range(len(NAMES))])
    return mean, np.where(scale > 1e-9, scale, 1.0)


def _normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows.  Each partition sums its own; the sums of one matrix row meet in one small group."""
    size = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros((size, size + 2))
        for batch in batches:
            z = kernel(_matrix(batch))
            a[:, :size] += z.T @ z
            a[:, size] += z.T @ np.asarray(batch.column("y"), float)
            a[:, size + 1] += z.sum(0)
        if a.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(a), pa.list_(pa.float64()))], names=["i", "a"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, a in zip(batch.column("i").to_pylist(), np.asarray(batch.column("a").flatten()).reshape(batch.num_rows, size + 2), strict=True):
                sums[i] = sums[i] + a if i in sums else a
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "a"])

    parts = rows.select("x", "y").mapInArrow(part, "i int, a array<double>")
    total = np.zeros((size, size + 2))
    for r in parts.repartition(16, "i").mapInArrow(add, "i int, a array<double>").collect():  # one matrix of fixed size
        total[r["i"]] += np.array(r["a"])
    return total[:, :size], total[:, size], int(round(total[-1, size + 1]))


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def bin_of(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype("i4")


class Model:
    def __init__(self, kernel: Kernel, weights: np.ndarray, curve: tuple[np.ndarray, np.ndarray]):
        self.kernel, self.weights, self.curve = kernel, weights, curve

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)


def fit(table: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from (doc_id, x) and the labels that teach; all of them, as only sums leave a partition."""
    spark = table.sparkSession
    rows = stage(table.join(teaching(labels, label), "doc_id").select("x", "y", "calibrates"), "quality-teaching")
    fits = rows.where("not calibrates")
    kernel = Kernel(*_moments(fits))
    a, b, n = _normal_equations(fits, kernel)
    weights = np.linalg.solve(a + np.eye(len(a)) * max(RIDGE * n, 1e-6), b)
    shipped = spark.sparkContext.broadcast((kernel, weights))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((BINS, 2))
        k, w = shipped.value
        for batch in batches:
            np.add.at(count, (bin_of(k(_matrix(batch)) @ w), np.asarray(batch.column("y"))), 1)
        at = np.flatnonzero(count.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at, 0]), pa.array(count[at, 1])], names=["bin", "n0", "n1"])

    found = rows.where("calibrates").select("x", "y").mapInArrow(bins, "bin int, n0 double, n1 double").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).orderBy("bin").collect()  # BINS rows at most
    n0, n1 = np.array([r["n0"] for r in found]), np.array([r["n1"] for r in found])
    if not len(found):
        return Model(kernel, weights, (np.array([0.0, 1.0]), np.array([0.25, 0.75])))
    # Half a document of the general share in each bin keeps the ends off 0 and 1.
    share = (n1.sum() + 0.5) / (n0.sum() + n1.sum() + 1)
    level = monotone((n1 + 0.5 * share) / (n0 + n1 + 0.5), n0 + n1)
    centre = (np.array([r["bin"] for r in found]) + 0.5) / BINS * 2 - 0.5
    # Blocks of equal level become one point each, so that scores rise between them and keep the order of raw scores.
    points, levels = [], []
    for v in np.unique(level):
        at = level == v
        points.append(float(np.average(centre[at], weights=(n0 + n1)[at])))
        levels.append(float(v))
    points = [points[0] - 2.0, *points, points[-1] + 2.0]
    levels = [levels[0] / 2, *levels, (1 + levels[-1]) / 2]
    return Model(kernel, weights, (np.array(points), np.array(levels)))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted; with carry, the row of docs as a struct too.

    Null text counts as empty; an empty text's statistics are all 0, and it gets the score of that vector.  A null id is
    scored like any other and not held out.  Repeated rows get equal scores.  An empty table gives an empty result;
    without labels the score follows no text.  Only the texts enter a score.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *carried(docs, carry))
    table = stage(tabulated(rows, carry), "quality-statistics")
    shipped = rows.sparkSession.sparkContext.broadcast(fit(table.select("doc_id", "x"), labels, label))
    extra = ["doc_id", *["row"] * carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(model.score(_matrix(batch)))], names=[*extra, "score"])

    out = table.mapInArrow(work, T.StructType([*[rows.schema[c] for c in extra], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *extra[1:])
