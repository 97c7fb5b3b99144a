"""Lookups, products, concatenation, sorting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Vec, kind_of, meet
from .frame import SMALL, Frame


def match(x: DataFrame, name: str, table: Frame, key: str, out: str = "match", nomatch: int | None = None) -> DataFrame:
    """Position (from 1) in table of the first element equal to x, compared as text; nomatch where there is none.

    The table's keys are made distinct before they meet x, so that x is never multiplied.
    """
    from .frame import POSITION

    first = table.index().df.where(F.col(key).isNotNull()).groupBy(table[key].to("character").alias("_key")).agg((F.min(POSITION) + 1).alias(out))
    text = Vec(F.col(name), kind_of(x.schema[name].dataType)).to("character").col
    joined = x.withColumn("_key", text).join(first, "_key", "left").drop("_key")
    return joined if nomatch is None else joined.withColumn(out, F.coalesce(out, F.lit(nomatch)))


def outer(rows: DataFrame, columns: DataFrame, fun: Callable[..., Column], x: str, y: str, out: str = "v") -> DataFrame:
    """fun of each pair.  columns is the short side: a matrix's second dimension.

    Up to SMALL rows go to every task; beyond that, blocks of both sides meet.
    """
    few = columns.limit(SMALL + 1).count() <= SMALL
    return (rows.join(F.broadcast(columns)) if few else rows.crossJoin(columns)).withColumn(out, fun(F.col(x), F.col(y)))


def c(*parts: tuple[DataFrame, str], out: str = "x") -> DataFrame:
    """Vectors end to end at the meet of their kinds; part tells which one a row is from."""
    kinds = [kind_of(df.schema[n].dataType) for df, n in parts]
    kind = meet(*kinds)
    tables = [df.select(F.lit(i).cast("bigint").alias("part"), Vec(F.col(n), k).to(kind).alias(out)) for i, ((df, n), k) in enumerate(zip(parts, kinds, strict=True))]
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole


def unlist(df: DataFrame, name: str, keys: list[str], out: str = "x") -> DataFrame:
    """Elements of nested arrays, flattened, with their place (from 0) in their row."""
    inner = F.flatten(name) if df.schema[name].dataType.elementType.typeName() == "array" else F.col(name)
    return df.select(*keys, F.posexplode(inner).alias("place", out))


def cbind(first: Frame, second: Frame, names: list[str], others: list[str]) -> DataFrame:
    """Columns side by side, by position; the shorter one ends in NA."""
    from .frame import POSITION

    a, b = first.index().df.select(POSITION, *names), second.index().df.select(POSITION, *others)
    return a.join(b, POSITION, "full")


def sort(frame: Frame, name: str) -> DataFrame:
    """Ascending, NA last."""
    return frame.df.orderBy(F.col(name).asc_nulls_last(), *frame.order)


def any_duplicated(frame: Frame, name: str, out: str = "first") -> DataFrame:
    """Position (from 1) of the second occurrence of the earliest element that has one; 0 if none has."""
    from .frame import POSITION

    rows = frame.index().df.select(POSITION, F.col(name).alias("_x"))
    twice = rows.groupBy("_x").agg(F.min(POSITION).alias("_one"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    earliest = twice.agg(F.min("_one").alias("_one"))
    value = twice.join(F.broadcast(earliest), "_one").select("_x", "_one")
    second = rows.join(F.broadcast(value), rows["_x"].eqNullSafe(value["_x"])).where(F.col(POSITION) > F.col("_one"))
    return second.agg(F.coalesce(F.min(POSITION) + 1, F.lit(0)).cast("bigint").alias(out))


def paste_collapse(frame: Frame, name: str, by: list[str], sep: str, out: str) -> DataFrame:
    """One text of all elements of a group, in order; NA as the text NA."""
    rows = frame.df.select(*by, F.struct(*frame.order, F.coalesce(frame[name].to("character").col, F.lit("NA")).alias("_t")).alias("_r"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_t"]), sep).alias(out))

