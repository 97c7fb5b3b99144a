"""Attributes of vectors and frames: names, dimensions, and anything else as column metadata.

Attributes describe a column and don't take part in arithmetic: results of operations have none.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attr(df: DataFrame, column: str, name: str) -> Any:
    """The attribute, or None."""
    return df.schema[column].metadata.get(name)


def set_attr(df: DataFrame, column: str, **attributes: Any) -> DataFrame:
    """Adds attributes; one set to None goes."""
    kept = {k: x for k, x in (df.schema[column].metadata | attributes).items() if x is not None}
    return df.withMetadata(column, kept)


def strip(df: DataFrame, column: str) -> DataFrame:
    """Without attributes."""
    return df.withMetadata(column, {})


def names(df: DataFrame) -> list[str]:
    return list(df.columns)


def set_names(df: DataFrame, new: list[str]) -> DataFrame:
    if len(new) != len(df.columns):
        raise ValueError("as many names as columns")
    return df.toDF(*new)


def dim(df: DataFrame) -> tuple[int, int]:
    """Rows and columns; the rows are counted."""
    return df.count(), len(df.columns)


def check_dim(length: int, dims: list[int]) -> None:
    """A vector can be an array of these dimensions if their product is its length."""
    product = 1
    for d in dims:
        product *= d
    if product != length:
        raise ValueError(f"dims [product {product}] do not match the length of object [{length}]")


def set_levels(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Makes a column of codes (from 0) a factor."""
    return set_attr(df, column, levels=list(levels))


def label(df: DataFrame, column: str, out: str) -> DataFrame:
    """The level of each code of a factor; NA outside."""
    levels = attr(df, column, "levels") or []
    return df.withColumn(out, F.get(F.array(*[F.lit(x) for x in levels]), F.col(column)) if levels else F.lit(None).cast("string"))
