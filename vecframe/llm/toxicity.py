"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary documents, back off to counts they share.  A word's
evidence is the difference of its log-likelihoods.  A document's evidence is length-normalised: the mean over all its
words, and means over its few strongest ones, so that a short outburst in a long text still shows.  A logistic fit on
labelled documents that the models have not seen turns these means into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .classify import bounded, logistic, sigmoid, teaching
from .common import carried, held_out
from .kneser_ney import Ratio
from .memory import Memory, using

#: Documents of each class that the models count at most (half as many calibrate): a bound of the fit sample, which also bounds the models.
FIT_DOCUMENTS = 3000
#: Numbers of strongest words whose evidence is averaged; evidence (in nats) that is clear, and the most that one word adds to it.
STRONGEST, CLEAR, LIMIT = (1, 2, 3, 5, 8), 2.0, 4.0
FEATURES = len(STRONGEST) + 4
#: From here a document counts as toxic.
THRESHOLD = 0.3
#: Words a worker remembers the evidence of in each generation.
MAX_WORDS = 100_000


def evidence(words: Memory, text: str) -> list[float]:
    """The document's features, normalised for its length.  All 0 for an empty text.

    The mean over all words; means over its strongest distinct words; what exceeds CLEAR by the distinct word, and the
    same cut off at LIMIT and scaled as noise is; how many distinct words there are.
    """
    found = text.lower().split()
    if not found:
        return [0.0] * FEATURES
    own = {w: words[w] for w in set(found)}
    best = np.sort(np.fromiter(own.values(), float, len(own)))[::-1]
    over = np.maximum(best - CLEAR, 0)
    return [sum([own[w] for w in found]) / len(found), *(float(best[:k].mean()) for k in STRONGEST), float(over.mean()), float(np.minimum(over, LIMIT).sum() / np.sqrt(len(best))), float(np.log(len(best)))]


class Model:
    """The ratio model and the calibration of its evidence."""

    def __init__(self, ratio: Ratio, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.ratio, self.mean, self.scale, self.weights = ratio, mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1])


def _counted(docs: DataFrame, sample: DataFrame) -> list[tuple[str, int, int]]:
    """Words of the fit sample with the number of documents of each class that have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                counts[y].update(set((text or "").lower().split()))
        for y in (0, 1):
            yield pa.RecordBatch.from_pydict({"word": list(counts[y]), "y": [y] * len(counts[y]), "n": list(counts[y].values())}, schema=pa.schema([("word", pa.string()), ("y", pa.int32()), ("n", pa.int64())]))

    words = docs.join(sample.where("not calibrates"), "doc_id").select("text", "y").mapInArrow(work, "word string, y int, n long")
    each = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    rows = words.groupBy("word").agg(each(0).alias("n0"), each(1).alias("n1")).toArrow()
    return sorted(zip(*[rows.column(c).to_pylist() for c in ("word", "n0", "n1")], strict=True))


def _evidence_of(docs: DataFrame, shipped, extra: list[str], schema: T.StructType | str) -> DataFrame:
    """The columns extra and evidence array<double>."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using("toxicity")
        words = Memory(shipped.value.word, MAX_WORDS)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [evidence(words, t or "") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(found, pa.list_(pa.float64()))], names=[*extra, "evidence"])

    return docs.select(*extra, "text").mapInArrow(work, schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Learns from the labels that teach.  Without any label 1, or any label 0, the score is constant: that label's share."""
    spark = docs.sparkSession
    sample = bounded(teaching(labels, label), fit_documents)
    ratio = Ratio(_counted(docs, sample))
    shipped = spark.sparkContext.broadcast(ratio)
    rows = _evidence_of(docs.join(sample.where("calibrates"), "doc_id"), shipped, ["doc_id", "y"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, evidence array<double>")
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("evidence").alias("evidence")).toArrow()  # a bounded sample
    y = np.array(rows.column("y").to_pylist(), float)
    x = np.array(rows.column("evidence").to_pylist(), float).reshape(len(y), FEATURES)
    shipped.unpersist()
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        flat = np.zeros(FEATURES + 1)
        flat[-1] = np.log(share / (1 - share))
        return Model(ratio, np.zeros(FEATURES), np.ones(FEATURES), flat)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    return Model(ratio, mean, scale, logistic((x - mean) / scale, y, ridge=0.05))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", fit_documents: int = FIT_DOCUMENTS, carry: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, held_out, score, predicted and the evidence behind the score; with carry, the row of docs as a struct too.

    Null text counts as empty; an empty text has evidence 0 and gets the score of that.  Texts of any length are whole.  A
    null id is scored like any other and not held out.  Repeated rows get equal scores.  Other columns of docs, whatever
    their names, play no part.  An empty table gives an empty result; without labels every
    score is 0.5.  Only the texts enter a score.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *carried(docs, carry))
    model = fit(rows.select("doc_id", "text"), labels, label, fit_documents)
    shipped = rows.sparkSession.sparkContext.broadcast(model.ratio)
    extra = ["doc_id", *["row"] * carry]
    out = _evidence_of(rows, shipped, extra, T.StructType([*[rows.schema[c] for c in extra], T.StructField("evidence", T.ArrayType(T.DoubleType()))]))
    z = F.lit(float(model.weights[-1]))
    for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights[:-1], strict=True)):
        z = z + (F.element_at("evidence", i + 1) - float(m)) * float(w / s)
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
    out = out.withColumn("score", score)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "evidence", *extra[1:])
