"""Frames: DataFrames whose columns are vectors of one length, with a declared order where position matters."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import Vec, kind_of, lift
from .folds import Fold

#: Name of the position column (from 0), added only by operators that need it.
POSITION = "_i"
#: Ranges of the order that global scans and positions are computed in side by side, at most: their bounds are in the plan.
MOST_RANGES = 4096
#: A looked-up vector of at most so many rows is broadcast.
SMALL = 100_000


def place(key: Column, bounds: list[Column]) -> Column:
    """How many of the ascending bounds are less than key: a tree of comparisons, and below it, where there are many, short lists.  0 for NA."""

    def tree(low: int, high: int, some: list[Column]) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(some[middle] < key, tree(middle + 1, high, some)).otherwise(tree(low, middle, some))

    if len(bounds) < 64:
        return tree(0, len(bounds), bounds)
    step = int(len(bounds) ** 0.5)
    coarse = tree(0, len(bounds) // step, bounds[step - 1 :: step])
    lists = F.array(*[F.array(*bounds[k : k + step]) for k in range(0, len(bounds), step)], F.array(bounds[-1]))
    return F.when(key.isNull(), 0).otherwise(coarse * step + F.size(F.filter(F.element_at(lists, coarse + 1), lambda b: b < key)) - F.when(coarse * step >= len(bounds), 1).otherwise(0))


class Frame:
    """A table as vectors.  order: the columns that define position, a unique key in ascending order."""

    def __init__(self, df: DataFrame, order: str | list[str] | None = None):
        self.df, self.order = df, [order] if isinstance(order, str) else order or []

    def __getitem__(self, name: str) -> Vec:
        kind = kind_of(self.df.schema[name].dataType)
        c = F.col(f"`{name}`")
        if kind == "integer" and not isinstance(self.df.schema[name].dataType, T.LongType):
            c = c.cast("bigint")
        return Vec(c.cast("double") if kind == "double" and not isinstance(self.df.schema[name].dataType, T.DoubleType) else c, kind)

    def with_(self, **vectors: Any) -> Frame:
        return Frame(self.df.withColumns({n: lift(v).col for n, v in vectors.items()}), self.order)

    def select(self, *names: str, **vectors: Any) -> DataFrame:
        return self.df.select(*names, *[lift(v).alias(n) for n, v in vectors.items()])

    # -- filters
    def filter(self, mask: Vec, keep_na: bool = False) -> Frame:
        """Rows whose mask is TRUE.  keep_na: a row whose mask is NA stays, with every other column NA."""
        m = mask.to("logical").col
        if not keep_na:
            return Frame(self.df.where(m), self.order)
        kept = self.df.where(m | m.isNull())
        return Frame(kept.select(*[F.col(f"`{c}`") if c in self.order else F.when(m, F.col(f"`{c}`")).alias(c) for c in self.df.columns]), self.order)

    # -- folds
    def fold(self, **folds: Fold) -> DataFrame:
        """All folds in one pass: one row."""
        return self.df.agg(*[f.alias(n) for n, f in folds.items()])

    def split(self, *keys: str) -> Split:
        return Split(self, keys)

    # -- positions
    def _ranged(self) -> tuple[DataFrame, str]:
        """The frame with its range number: consecutive stretches of the order, about equally long, as many as the session's
        shuffle has partitions.  The bounds are literals, so that every pass over the frame cuts it in the same way."""
        if not self.order:
            raise ValueError("position needs a declared order")
        ranges = min(MOST_RANGES, max(2, int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        keys = []
        for name in self.order:
            key, kind = F.col(f"`{name}`"), self.df.schema[name].dataType
            keys.append(F.unix_micros(key.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else key)
        if len(keys) == 1 and (isinstance(self.df.schema[self.order[0]].dataType, (T.IntegralType, T.FractionalType, T.DatetimeType, T.TimestampNTZType))):
            bounds = self.df.agg(F.percentile_approx(keys[0], [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
            at = place(keys[0], [F.lit(b) for b in sorted(set(bounds))])
        else:  # orders of any type and of several columns: the greatest key of each partition of a range partitioning
            named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
            dealt = self.df.select(*named).repartitionByRange(ranges, *[f"k{i}" for i in range(len(keys))])
            most = dealt.groupBy(F.spark_partition_id().alias("_p")).agg(F.max(F.struct(*[f"k{i}" for i in range(len(keys))])).alias("k"))
            types = [f.dataType for f in dealt.schema.fields]
            found = [r["k"] for r in most.orderBy("k").collect()][:-1]  # a row for each partition
            at = place(F.struct(*named), [F.struct(*[F.lit(x).cast(t).alias(f"k{i}") for i, (x, t) in enumerate(zip(r, types, strict=True))]) for r in dict.fromkeys(found)])
        return self.df.withColumn("_range", at), "_range"

    def _in_range(self, partition: list[str] | None = None) -> Window:
        return Window.partitionBy("_range", *(partition or [])).orderBy(*self.order)

    def index(self) -> Frame:
        """Adds the position column.  Ranges count on their own; their sizes, a few rows, are added up and broadcast."""
        df, r = self._ranged()
        starts = df.groupBy(r).count()
        starts = starts.select(r, (F.sum("count").over(Window.orderBy(r)) - F.col("count")).alias("_start"))
        out = df.withColumn(POSITION, F.row_number().over(self._in_range()).cast("bigint") - 1).join(F.broadcast(starts), r)
        return Frame(out.withColumn(POSITION, F.col(POSITION) + F.col("_start")).drop(r, "_start"), self.order)

    def scan(self, how: str, name: str, out: str, by: list[str] | None = None) -> Frame:
        """Inclusive prefix folds: sum, prod, min, max, any or all of column name.  After the first NA all is NA.

        Each range scans on its own, and what the ranges before it fold to comes from a table with a row for each (and each
        group of by).
        """
        agg = {"sum": F.sum, "prod": F.product, "min": F.min, "max": F.max, "any": F.bool_or, "all": F.bool_and}[how]
        x = self[name]
        x = x.to("logical") if how in ("any", "all") else x.to("double") if how == "prod" else x.to("integer") if x.kind == "logical" else x
        by = by or []
        df, r = self._ranged()
        df = df.withColumn("_x", x.col)
        parts = df.groupBy(r, *by).agg(agg("_x").alias("_part"), F.count_if(F.col("_x").isNull()).alias("_nas"))
        before = Window.partitionBy(*by).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select(r, *by, agg("_part").over(before).alias("_before"), F.coalesce(F.sum("_nas").over(before), F.lit(0)).alias("_nas_before"))
        w = self._in_range(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns({"_own": agg("_x").over(w), "_na": F.count_if(F.col("_x").isNull()).over(w)})
        df = df.join(parts if by else F.broadcast(parts), [r, *by])
        joined = {"sum": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": F.least, "max": F.greatest, "any": lambda a, b: a | b, "all": lambda a, b: a & b}[how](F.col("_before"), F.col("_own"))
        value = F.when(F.col("_na") + F.col("_nas_before") == 0, F.when(F.col("_before").isNull(), F.col("_own")).otherwise(joined))
        return Frame(df.withColumn(out, value).drop(r, "_x", "_own", "_na", "_before", "_nas_before"), self.order)

    # -- lookup by position (from 1, as vectors count)
    def _side(self, df: DataFrame, rows: int | None) -> DataFrame:
        return F.broadcast(df) if rows is not None and rows <= SMALL else df

    def gather(self, indices: DataFrame, at: str, names: list[str], rows: int | None = None) -> DataFrame:
        """Elements of names at the positions in column at: 0 drops out, NA and positions past the end give NA.

        rows: how many indices there are, if known; a small number is broadcast.
        """
        mine = self.index().df.select((F.col(POSITION) + 1).alias("_at"), *names)
        asked = indices.where(F.col(at).isNull() | (F.col(at) != 0))
        return asked.join(mine, asked[at] == mine["_at"], "left").drop("_at")

    def exclude(self, positions: list[int] | DataFrame, at: str | None = None) -> Frame:
        """All but the elements at the positions; positions past the end are ignored."""
        me = self.index()
        if isinstance(positions, list):
            return Frame(me.df.where(~F.col(POSITION).isin([p - 1 for p in positions])).drop(POSITION), self.order)
        gone = positions.select((F.col(at) - 1).alias(POSITION)).where(F.col(POSITION).isNotNull())
        return Frame(me.df.join(gone, POSITION, "left_anti").drop(POSITION), self.order)

    def slice(self, first: int, last: int) -> Frame:
        """Elements first to last, both included.  Near the beginning no position is counted: the first ones are enough."""
        if not self.order:
            raise ValueError("position needs a declared order")
        if last <= SMALL:
            return Frame(self.df.orderBy(*self.order).offset(max(first - 1, 0)).limit(max(last - max(first, 1) + 1, 0)), self.order)
        return Frame(self.index().df.where(F.col(POSITION).between(first - 1, last - 1)).drop(POSITION), self.order)

    def assign(self, name: str, mask: Vec, value: Any) -> Frame:
        """name[mask] <- value: a value, or a list that is dealt out over the TRUE rows in order, again and again.

        The value is cast to the column's kind.
        """
        old, m = self[name], mask.to("logical").col
        if not isinstance(value, list):
            return Frame(self.df.withColumn(name, F.when(m, lift(value).to(old.kind).col).otherwise(old.col)), self.order)
        hit = Frame(self.df.withColumn("_hit", F.when(m, 1).otherwise(0).cast("bigint")), self.order).scan("sum", "_hit", "_nth")
        values = F.array(*[lift(v).to(old.kind).col for v in value])
        new = F.element_at(values, (F.pmod(F.col("_nth") - 1, F.lit(len(value))) + 1).cast("int"))
        return Frame(hit.df.withColumn(name, F.when(F.col("_hit") == 1, new).otherwise(old.col)).drop("_hit", "_nth"), self.order)

    def assign_at(self, name: str, updates: DataFrame, at: str, value: str) -> Frame:
        """name[at] <- value for the rows of updates, whose positions are distinct."""
        old = self[name]
        new = updates.select((F.col(at) - 1).alias(POSITION), Vec(F.col(value), kind_of(updates.schema[value].dataType)).to(old.kind).alias("_new"), F.lit(True).alias("_set"))
        joined = self.index().df.join(new, POSITION, "left")
        return Frame(joined.withColumn(name, F.when(F.col("_set"), F.col("_new")).otherwise(old.col)).drop(POSITION, "_new", "_set"), self.order)

    def stencil(self, name: str, taps: list[float], out: str, block: int = 65_536) -> DataFrame:
        """sum of taps[k] * x[i + k], k from 1, for all i that have all taps, by position of i (from 1).

        Positions fall in blocks; the few rows that a neighbour needs too are sent to both, so that blocks are independent.
        """
        n = len(taps)
        rows = self.index().df.select(POSITION, self[name].to("double").alias("_x"))
        own, back = F.floor(F.col(POSITION) / block), F.floor((F.col(POSITION) - n) / block)
        rows = rows.withColumn("_block", F.explode(F.array_distinct(F.array(own, back)))).where("_block >= 0")
        w = Window.partitionBy("_block").orderBy(POSITION)
        total = F.lit(0.0)
        for k, t in enumerate(taps, 1):
            total = total + F.lead("_x", k).over(w) * t
        rows = rows.withColumn("_sum", total).withColumn("_far", F.lead(POSITION, n).over(w))
        return rows.where((F.floor(F.col(POSITION) / block) == F.col("_block")) & F.col("_far").isNotNull()).select((F.col(POSITION) + 1).alias("i"), F.col("_sum").alias(out))


class Split:
    """A frame in groups, to be folded."""

    def __init__(self, frame: Frame, keys: tuple[str, ...]):
        self.frame, self.keys = frame, keys

    def fold(self, **folds: Fold) -> DataFrame:
        """A row for each group that occurs."""
        return self.frame.df.groupBy(*self.keys).agg(*[f.alias(n) for n, f in folds.items()])

    def dense(self, levels: int, strict: bool = False, **folds: Fold) -> DataFrame:
        """A row for each code 0 .. levels - 1 of the one key, in which empty groups have the folds' empty values.

        Codes outside are dropped, or (strict) an error.
        """
        (key,) = self.keys
        c = F.col(key)
        df = self.frame.df
        inside = c.between(0, levels - 1)
        df = df.withColumn(key, F.when(F.coalesce(inside, F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("code out of range: "), F.coalesce(c.cast("string"), F.lit("NA")))))) if strict else df.where(inside)
        found = df.groupBy(key).agg(*[f.alias(n) for n, f in folds.items()], F.lit(True).alias("_found"))
        every = df.sparkSession.range(levels).select(F.col("id").alias(key))
        out = every.join(F.broadcast(found) if levels <= SMALL else found, key, "left")
        return out.select(key, *[F.when(F.col("_found"), F.col(n)).otherwise(F.lit(f.empty)).alias(n) for n, f in folds.items()])


def encode(x: Vec, levels: list) -> Column:
    """Codes from 0 of the levels; NA for values that are none."""
    return F.when(F.array_contains(F.array(*[F.lit(v) for v in levels]), x.col), F.array_position(F.array(*[F.lit(v) for v in levels]), x.col) - 1)
