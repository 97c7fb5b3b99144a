"""Vectors: columns that know their kind.

A Vec is a lazy column with one of the kinds of the type lattice (logical < integer < double < character).  Its operators
lower to Catalyst expressions with the algebra's rules for NA, NaN, overflow and division by zero; nothing here needs
Python at run time.  NA is NULL; NaN is a double and not NA.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATTICE = ("logical", "integer", "double", "character")
SPARK_TYPE = {"logical": "boolean", "integer": "bigint", "double": "double", "character": "string"}
_KINDS = {T.BooleanType: "logical", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer", T.FloatType: "double", T.DoubleType: "double", T.DecimalType: "double", T.StringType: "character"}
#: From here a double has no fraction, and BIGINT can't hold all values.
WHOLE, LIMIT = float(2**52), float(2**63)


def kind_of(data_type: T.DataType) -> str:
    return _KINDS.get(type(data_type), "other")


def meet(*kinds: str) -> str:
    """The least kind that holds all."""
    if "other" in kinds:
        raise TypeError(f"no common kind of {kinds}")
    return max(kinds, key=LATTICE.index)


def lift(x: Any) -> Vec:
    """A Vec, of a Python value a constant one.  None is a logical NA."""
    if isinstance(x, Vec):
        return x
    if x is None:
        return Vec(F.lit(None).cast("boolean"), "logical")
    if isinstance(x, bool):
        return Vec(F.lit(x), "logical", x)
    if isinstance(x, int):
        return Vec(F.lit(x).cast("bigint"), "integer", x)
    if isinstance(x, float):
        return Vec(F.lit(x), "double", x)
    if isinstance(x, str):
        return Vec(F.lit(x), "character", x)
    raise TypeError(f"{x!r} is no vector")


class Vec:
    """A column, its kind, and its value where it is a constant."""

    __slots__ = ("col", "kind", "value")
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, col: Column, kind: str, value: Any = None):
        self.col, self.kind, self.value = col, kind, value

    # -- coercion
    def to(self, kind: str) -> Vec:
        """The cast rules of the lattice.

        double to integer truncates, and gives NA out of range and for NaN; text that is no number gives NA; only TRUE and
        FALSE are logical texts; numbers are TRUE unless 0.
        """
        a, c = self.kind, self.col
        if a == kind:
            return self
        if kind == "integer":
            if a == "double":
                c = F.when(F.isnan(c) | (F.abs(c) >= LIMIT), None).otherwise(c.cast("bigint"))
            elif a == "character":
                c = c.try_cast("bigint")
            else:
                c = c.cast("bigint")
        elif kind == "double":
            c = c.try_cast("double") if a == "character" else c.cast("bigint").cast("double") if a == "logical" else c.cast("double")
        elif kind == "logical":
            if a == "character":
                c = F.when(c == "TRUE", True).when(c == "FALSE", False)
            else:
                c = F.when(F.isnan(c), None).otherwise(c != 0) if a == "double" else c != 0
        elif kind == "character":
            c = F.when(c, "TRUE").otherwise(F.when(~c, "FALSE")) if a == "logical" else c.cast("string")
        else:
            raise TypeError(kind)
        return Vec(c, kind)

    def _number(self) -> Vec:
        if self.kind not in ("logical", "integer", "double"):
            raise TypeError(f"{self.kind} is not a number")
        return self.to("integer") if self.kind == "logical" else self

    def _arithmetic(self, other: Any, whole: str, double) -> Vec:
        a, b = self._number(), lift(other)._number()
        if "double" in (a.kind, b.kind):
            return Vec(double(a.to("double").col, b.to("double").col), "double")
        return Vec(getattr(F, whole)(a.col, b.col), "integer")

    # -- arithmetic
    def __add__(self, o: Any) -> Vec:
        o = lift(o)
        return self if self.kind == "double" and o.value == 0 and o.kind != "character" else self._arithmetic(o, "try_add", lambda a, b: a + b)

    def __sub__(self, o: Any) -> Vec:
        o = lift(o)
        return self if self.kind == "double" and o.value == 0 and o.kind != "character" else self._arithmetic(o, "try_subtract", lambda a, b: a - b)

    def __mul__(self, o: Any) -> Vec:
        o = lift(o)
        return self if self.kind == "double" and o.value == 1 and o.kind != "character" else self._arithmetic(o, "try_multiply", lambda a, b: a * b)

    def __radd__(self, o: Any) -> Vec:
        return lift(o) + self

    def __rsub__(self, o: Any) -> Vec:
        return lift(o) - self

    def __rmul__(self, o: Any) -> Vec:
        return self * o

    def __truediv__(self, o: Any) -> Vec:
        """Always double, by IEEE rules: x/0 is signed infinity or NaN."""
        a, b = self._number().to("double").col, lift(o)._number().to("double").col
        return Vec(F.when(b != 0, F.try_divide(a, b)).otherwise(a * F.pow(b, F.lit(-1.0))), "double")

    def __rtruediv__(self, o: Any) -> Vec:
        return lift(o) / self

    def __floordiv__(self, o: Any) -> Vec:
        """Integers truncate and give NA for 0; doubles floor the quotient."""
        a, b = self._number(), lift(o)._number()
        if "double" in (a.kind, b.kind):
            return floor(a / b)
        return Vec(F.when(b.col != 0, F.call_function("div", a.col, F.when(b.col != 0, b.col))), "integer")

    def __mod__(self, o: Any) -> Vec:
        """Integers have the dividend's sign and give NA for 0; doubles have the divisor's sign."""
        a, b = self._number(), lift(o)._number()
        if "double" in (a.kind, b.kind):
            a, b = a.to("double"), b.to("double")
            return a - floor(a / b) * b
        return Vec(F.try_mod(a.col, b.col), "integer")

    def __pow__(self, o: Any) -> Vec:
        """Always double; exponents 0, 1, 2, 0.5 and -1 become cheaper operations."""
        x, e = self._number().to("double"), lift(o)
        if e.value is not None and not isinstance(e.value, str):
            v = float(e.value)
            if v == 0:
                return Vec(F.lit(1.0), "double", 1.0)
            if v == 1:
                return x
            if v == 2:
                return x * x
            if v == 0.5:
                return sqrt(x)
            if v == -1:
                return lift(1.0) / x
        return Vec(F.pow(x.col, e._number().to("double").col), "double")

    def __rpow__(self, o: Any) -> Vec:
        return lift(o) ** self

    def __neg__(self) -> Vec:
        x = self._number()
        return Vec(F.try_subtract(F.lit(0).cast("bigint"), x.col) if x.kind == "integer" else -x.col, x.kind)

    def __pos__(self) -> Vec:
        return self._number()

    def __abs__(self) -> Vec:
        x = self._number()
        return Vec(F.when(x.col < 0, (-x).col).otherwise(x.col) if x.kind == "integer" else F.abs(x.col), x.kind)

    # -- comparison, at the meet of the kinds
    def _compare(self, o: Any, how) -> Vec:
        o = lift(o)
        k = meet(self.kind, o.kind)
        return Vec(how(self.to(k).col, o.to(k).col), "logical")

    def __eq__(self, o: Any) -> Vec:  # type: ignore[override]
        return self._compare(o, lambda a, b: a == b)

    def __ne__(self, o: Any) -> Vec:  # type: ignore[override]
        return self._compare(o, lambda a, b: a != b)

    def __lt__(self, o: Any) -> Vec:
        return self._compare(o, lambda a, b: a < b)

    def __le__(self, o: Any) -> Vec:
        return self._compare(o, lambda a, b: a <= b)

    def __gt__(self, o: Any) -> Vec:
        return self._compare(o, lambda a, b: a > b)

    def __ge__(self, o: Any) -> Vec:
        return self._compare(o, lambda a, b: a >= b)

    # -- three-valued logic
    def __and__(self, o: Any) -> Vec:
        return Vec(self.to("logical").col & lift(o).to("logical").col, "logical")

    def __or__(self, o: Any) -> Vec:
        return Vec(self.to("logical").col | lift(o).to("logical").col, "logical")

    def __rand__(self, o: Any) -> Vec:
        return self & o

    def __ror__(self, o: Any) -> Vec:
        return self | o

    def __invert__(self) -> Vec:
        return Vec(~self.to("logical").col, "logical")

    def alias(self, name: str) -> Column:
        return self.col.alias(name)


def _double(x: Any) -> Column:
    return lift(x)._number().to("double").col


def _mapped(f):
    def op(x: Any) -> Vec:
        return Vec(f(_double(x)), "double")

    return op


def _whole(c: Column, rounded: Column) -> Column:
    """Spark's floor and ceil are BIGINT: values without a fraction, infinities and NaN stay as they are."""
    return F.when(F.abs(c) < WHOLE, rounded.cast("double")).otherwise(c)


sqrt, exp, sign = _mapped(F.sqrt), _mapped(F.exp), _mapped(F.signum)
cos, sin, tan, acos, asin, atan = map(_mapped, (F.cos, F.sin, F.tan, F.acos, F.asin, F.atan))
floor = _mapped(lambda c: _whole(c, F.floor(F.when(F.abs(c) < WHOLE, c))))
ceiling = _mapped(lambda c: _whole(c, F.ceil(F.when(F.abs(c) < WHOLE, c))))
log = _mapped(lambda c: F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf"))).when(c < 0, F.lit(float("nan"))).otherwise(c))


def trunc(x: Any) -> Vec:
    c = _double(x)
    return Vec(F.when(c < 0, ceiling(Vec(c, "double")).col).otherwise(floor(Vec(c, "double")).col), "double")


def atan2(y: Any, x: Any) -> Vec:
    return Vec(F.atan2(_double(y), _double(x)), "double")


def hypot(x: Any, y: Any) -> Vec:
    return Vec(F.hypot(_double(x), _double(y)), "double")


def round_(x: Any, digits: Any = 0) -> Vec:
    """Half away from zero.  digits may be a vector."""
    c, d = _double(x), lift(digits)
    if isinstance(d.value, int):
        return Vec(F.round(c, d.value), "double")
    ten = F.pow(F.lit(10.0), d.to("double").col)
    return Vec(F.signum(c) * F.floor(F.abs(c) * ten + 0.5).cast("double") / ten, "double")


def signif(x: Any, digits: int) -> Vec:
    """So many significant digits; 0 stays 0."""
    c = _double(x)
    ten = F.pow(F.lit(10.0), F.lit(float(digits)) - F.ceil(F.log10(F.when(c != 0, F.abs(c)))).cast("double"))
    return Vec(F.when(c == 0, c).otherwise(F.signum(c) * F.floor(F.abs(c) * ten + 0.5).cast("double") / ten), "double")


def _extreme(a: Any, b: Any, pick) -> Vec:
    a, b = lift(a), lift(b)
    k = meet(a.kind, b.kind, "integer")
    a, b = a.to(k), b.to(k)
    return Vec(F.when(a.col.isNotNull() & b.col.isNotNull(), pick(a.col, b.col)), k)


def pmin(a: Any, b: Any) -> Vec:
    """Element by element; NA if either is."""
    return _extreme(a, b, F.least)


def pmax(a: Any, b: Any) -> Vec:
    return _extreme(a, b, F.greatest)


def is_na(x: Any) -> Vec:
    return Vec(lift(x).col.isNull(), "logical")


def is_nan(x: Any) -> Vec:
    x = lift(x)
    return Vec(F.coalesce(F.isnan(x.col), F.lit(False)) if x.kind == "double" else F.lit(False), "logical")


def is_finite(x: Any) -> Vec:
    c = _double(x)
    return Vec(F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)), "logical")


def is_infinite(x: Any) -> Vec:
    return Vec(F.coalesce(F.abs(_double(x)) == float("inf"), F.lit(False)), "logical")


def ifelse(test: Any, yes: Any, no: Any) -> Vec:
    """yes where test is TRUE, no where it is FALSE or NA."""
    yes, no = lift(yes), lift(no)
    k = meet(yes.kind, no.kind)
    return Vec(F.when(lift(test).to("logical").col, yes.to(k).col).otherwise(no.to(k).col), k)


def switch(x: Any, cases: dict[Any, Any], default: Any = None) -> Vec:
    """The case whose key equals x; the default for all others and NA.  A case None falls through to the next."""
    x = lift(x)
    values, held = [], []
    for k, v in cases.items():
        held.append(k)
        if v is not None:
            values.append((held, lift(v)))
            held = []
    kind = meet(*[v.kind for _, v in values], lift(default).kind)
    out: Column | None = None
    for keys, v in values:
        hit = x.col.isin(keys)
        out = F.when(hit, v.to(kind).col) if out is None else out.when(hit, v.to(kind).col)
    return Vec(out.otherwise(lift(default).to(kind).col), kind)


def recycle(values: list, position: Any) -> Vec:
    """Short vector against a long one: the element at position (from 0) modulo its length."""
    lifted = [lift(v) for v in values]
    k = meet(*[v.kind for v in lifted])
    array = F.array(*[v.to(k).col for v in lifted])
    return Vec(F.element_at(array, (F.pmod(lift(position).col, F.lit(len(values))) + 1).cast("int")), k)


def as_logical(x: Any) -> Vec:
    return lift(x).to("logical")


def as_integer(x: Any) -> Vec:
    return lift(x).to("integer")


def as_double(x: Any) -> Vec:
    return lift(x).to("double")


def as_character(x: Any) -> Vec:
    return lift(x).to("character")


def paste(*parts: Any, sep: str = " ") -> Vec:
    """Texts side by side; NA becomes the text NA."""
    return Vec(F.concat_ws(sep, *[F.coalesce(lift(p).to("character").col, F.lit("NA")) for p in parts]), "character")


def nchar(x: Any) -> Vec:
    """Characters of a text; NA counts 2."""
    return Vec(F.coalesce(F.length(lift(x).to("character").col), F.lit(2)).cast("bigint"), "integer")


def nzchar(x: Any) -> Vec:
    return nchar(x) > 0


def hash_uniform(position: Any, seed: int = 0, low: float = 0.0, high: float = 1.0) -> Vec:
    """Uniform numbers that depend on position and seed only, however the rows are partitioned."""
    u = F.pmod(F.xxhash64(lift(position).col, F.lit(seed)), F.lit(2**53)).cast("double") / float(2**53)
    return Vec(u * (high - low) + low, "double")
