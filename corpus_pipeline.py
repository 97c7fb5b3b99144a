"""The corpus pipeline: toxicity, quality, exact dedup, near-duplicate join, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All stages but the last return the columns of documents.

In all stages: a null text counts as empty; texts of any length are whole; repeated rows are judged alike; columns beyond
doc_id and text, whatever their names, stay as they are; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecframe.llm.common import ship, stage, table
from vecframe.llm.exact_dedup import exact_dedup
from vecframe.llm.ngram_join import ngram_join
from vecframe.llm.packing import packing
from vecframe.llm.quality import quality
from vecframe.llm.toxicity import toxicity

#: Near copies: words of a shingle, and per cent of the union that two documents share at least.
SHINGLE_WORDS, SIMILAR_PER_CENT = 5, 80
#: Words that packing remembers here, where its workers serve other stages too.
REMEMBER = 200_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts 1 for go.  Rows without an id, or without a label, are judged by their text like others."""
    return toxicity(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 0").select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts 0 for go.  Rows without an id, or without a label, are judged by their text like others."""
    return quality(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays (without an id: only where no row of the group has one; of ties one)."""
    return exact_dedup(docs).kept()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents that with the smallest doc_id stays.

    Rows without an id link others, but are never dropped here; nor are rows that share the smallest id of their
    component.  Empty texts are similar to nothing and stay.
    """
    gone = ngram_join(docs, n=SHINGLE_WORDS, per_cent=SIMILAR_PER_CENT).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of training sequences, with their ids.  Empty texts are one id, the end; null ids stay null."""
    return packing(docs, public_tokenizers.path("word_bpe_49k.json"), remember=REMEMBER)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("packing", pack),
]

#: Classifiers, sets of shingles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again but the last."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
