"""Applying functions: to array elements, to several columns, to groups, to rows as a table function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lapply(array: Column, f: Callable[[Column], Column]) -> Column:
    """f over the elements; f is inlined in the plan."""
    return F.transform(array, f)


def mapply(f: Callable[..., Column], *arrays: Column) -> Column:
    """f over elements side by side, shorter arrays repeated; no elements if one array has none."""
    n = F.greatest(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    some = F.least(*[F.size(a) for a in arrays]) if len(arrays) > 1 else F.size(arrays[0])
    made = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: f(*[F.try_element_at(a, (F.try_mod(i, F.size(a)) + 1).cast("int")) for a in arrays]))
    return F.when(some > 0, made).otherwise(F.slice(made, 1, 0))


def pandas_map(f: Callable[..., pd.Series], returns: str) -> Callable[..., Column]:
    """A Python function over batches of columns, for what expressions can't say."""
    return F.pandas_udf(f, returns)


def group_map(df: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function over whole groups, each of which must fit in a task's memory."""
    return df.groupBy(*keys).applyInPandas(f, schema)


@F.udtf(returnType="x: double, copy: bigint")
class Repeat:
    """Table function: a value so many times."""

    def eval(self, x: float, times: int) -> Iterator[tuple[float, int]]:
        for k in range(times or 0):
            yield x, k + 1


_TESTS: dict[str, tuple[type, ...]] = {
    "logical": (T.BooleanType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "double": (T.FloatType, T.DoubleType, T.DecimalType),
    "numeric": (T.NumericType,),
    "character": (T.StringType,),
    "list": (T.ArrayType, T.StructType),
    "complex": (T.StructType,),
    "raw": (T.BinaryType,),
    "atomic": (T.AtomicType,),
    "recursive": (T.ArrayType, T.StructType, T.MapType),
    "null": (T.NullType,),
}


def is_kind(df: DataFrame, name: str, kind: str) -> bool:
    """Type test of a column, from the schema alone."""
    t = df.schema[name].dataType
    if kind == "complex":
        return isinstance(t, T.StructType) and t.names == ["re", "im"]
    return isinstance(t, _TESTS[kind])


def type_of(df: DataFrame, name: str) -> str:
    """Kind of a column; nothing is computed."""
    from ..functions.vec import kind_of

    return "complex" if is_kind(df, name, "complex") else kind_of(df.schema[name].dataType)
