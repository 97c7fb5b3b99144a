"""Vectors from nothing.  Each is a frame of position (from 0) and x, ordered by position."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import Vec, hash_uniform, lift
from .frame import POSITION, Frame

_ZERO = {"logical": False, "integer": 0, "double": 0.0, "character": ""}


def _range(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n)).select(F.col("id").alias(POSITION))


def _frame(df: DataFrame, x) -> Frame:
    return Frame(df.select(POSITION, x.alias("x")), POSITION)


def vector(spark: SparkSession, kind: str, n: int) -> Frame:
    """n times the kind's zero."""
    return _frame(_range(spark, n), lift(_ZERO[kind]).col)


def seq(spark: SparkSession, start: Any, by: Any, n: int) -> Frame:
    """start, start + by, ...: n elements, integers if both are."""
    i = Vec(F.col(POSITION), "integer")
    return _frame(_range(spark, n), (lift(start) + lift(by) * i).col)


def colon(spark: SparkSession, start: float, end: float) -> Frame:
    """start to end by 1, up or down, in the kind of start."""
    return seq(spark, start, 1 if end >= start else -1, int(abs(end - start) + 1e-10) + 1)


def seq_len(spark: SparkSession, n: int) -> Frame:
    return seq(spark, 1.0, 1.0, n)


def seq_int(spark: SparkSession, start: int, end: int, by: int) -> Frame:
    return seq(spark, start, by, (end - start) // by + 1)


def index(spark: SparkSession, n: int, each: int, length: int) -> Frame:
    """1 .. n, each element each times, again and again to length."""
    return _frame(_range(spark, length), F.floor(F.col(POSITION) / each) % n + 1)


def rep(spark: SparkSession, values: list, times: int = 1, length: int | None = None, each: int = 1) -> Frame:
    """Short values, repeated."""
    n = len(values) * times * each if length is None else length
    lifted = [lift(v) for v in values]
    return _frame(_range(spark, n), F.element_at(F.array(*[v.col for v in lifted]), (F.floor(F.col(POSITION) / each) % len(values) + 1).cast("int")))


def rep_times(frame: Frame, name: str, times: str) -> DataFrame:
    """Each element as often as its row says (NA and less than 1: not at all); copy counts from 1."""
    return frame.df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times).cast("bigint"))))


def runif(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Frame:
    return _frame(_range(spark, n), hash_uniform(Vec(F.col(POSITION), "integer"), seed, low, high).col)
