"""Folds: aggregates with the algebra's rules for NA and for empty input, and grouped folds with dense levels."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vec import Vec, lift

#: What an empty vector folds to.
LEAST_INTEGER, GREATEST_INTEGER = -(2**63), 2**63 - 1


class Fold:
    """An aggregate column and the value of an empty group (None: NA)."""

    def __init__(self, col: Column, kind: str, empty: Any):
        self.col, self.kind, self.empty = col, kind, empty

    def alias(self, name: str) -> Column:
        return self.col.alias(name)


def _fold(x: Vec, agg, kind: str, empty: Any, na_rm: bool, where: Vec | None) -> Fold:
    """agg over the elements that where selects; unless na_rm, one NA among them makes the result NA."""
    c = x.col if where is None else F.when(where.to("logical").col, x.col)
    out = agg(c)
    if empty is not None:
        out = F.coalesce(out, F.lit(empty))
    if not na_rm:
        missing = x.col.isNull() if where is None else x.col.isNull() & F.coalesce(where.to("logical").col, F.lit(False))
        out = F.when(F.count_if(missing) == 0, out)
    return Fold(out, kind, empty)


def sum_(x: Any, na_rm: bool = False, where: Vec | None = None) -> Fold:
    """Logical and integer vectors sum to an integer (NA beyond 64 bits), doubles to a double; empty: 0."""
    x = lift(x)._number()
    return _fold(x, F.try_sum if x.kind == "integer" else F.sum, x.kind, 0 if x.kind == "integer" else 0.0, na_rm, where)


def prod(x: Any, na_rm: bool = False, where: Vec | None = None) -> Fold:
    """Always double; empty: 1."""
    return _fold(lift(x)._number().to("double"), F.product, "double", 1.0, na_rm, where)


def _extreme(x: Any, agg, least: bool, na_rm: bool, where: Vec | None) -> Fold:
    x = lift(x)
    x = x.to("integer") if x.kind == "logical" else x
    empty = {"integer": GREATEST_INTEGER if least else LEAST_INTEGER, "double": float("inf") if least else float("-inf"), "character": "ÿ" if least else ""}[x.kind]
    return _fold(x, agg, x.kind, empty, na_rm, where)


def min_(x: Any, na_rm: bool = False, where: Vec | None = None) -> Fold:
    """Empty: the greatest value of the kind."""
    return _extreme(x, F.min, True, na_rm, where)


def max_(x: Any, na_rm: bool = False, where: Vec | None = None) -> Fold:
    """Empty: the least value of the kind."""
    return _extreme(x, F.max, False, na_rm, where)


def any_(x: Any, na_rm: bool = False) -> Fold:
    """TRUE if an element is; else NA if one is NA (and not na_rm); else FALSE."""
    c = lift(x).to("logical").col
    some = F.coalesce(F.bool_or(c), F.lit(False))
    return Fold(some if na_rm else F.when(some, True).when(F.count_if(c.isNull()) > 0, None).otherwise(False), "logical", False)


def all_(x: Any, na_rm: bool = False) -> Fold:
    """FALSE if an element is; else NA if one is NA (and not na_rm); else TRUE."""
    c = lift(x).to("logical").col
    every = F.coalesce(F.bool_and(c), F.lit(True))
    return Fold(every if na_rm else F.when(~every, False).when(F.count_if(c.isNull()) > 0, None).otherwise(True), "logical", True)


def length(x: Any = None, where: Vec | None = None) -> Fold:
    """Number of elements, NA included."""
    return Fold(F.count(F.lit(1)) if where is None else F.count_if(F.coalesce(where.to("logical").col, F.lit(False))), "integer", 0)


def mean(x: Any, na_rm: bool = False, where: Vec | None = None) -> Fold:
    """Empty: NA."""
    return _fold(lift(x)._number().to("double"), F.avg, "double", None, na_rm, where)


def _moment(x: Any, y: Any, agg, na_rm: bool) -> Fold:
    a, b = lift(x)._number().to("double").col, lift(y)._number().to("double").col
    out = agg(a, b)
    return Fold(out if na_rm else F.when(F.count_if(a.isNull() | b.isNull()) == 0, out), "double", None)


def cm2(x: Any, y: Any, na_rm: bool = False) -> Fold:
    """Sum of products of deviations from the means."""
    return _moment(x, y, lambda a, b: F.regr_sxy(b, a), na_rm)


def cov(x: Any, y: Any, na_rm: bool = False) -> Fold:
    return _moment(x, y, F.covar_samp, na_rm)


def var(x: Any, na_rm: bool = False) -> Fold:
    return _moment(x, x, lambda a, _: F.var_samp(a), na_rm)


def sd(x: Any, na_rm: bool = False) -> Fold:
    return _moment(x, x, lambda a, _: F.stddev_samp(a), na_rm)
