"""Complex numbers as structs of re and im."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import Vec, lift


class Complex:
    """A pair of vectors; real numbers join in with im 0."""

    def __init__(self, re: Any, im: Any = 0.0):
        self.re, self.im = lift(re).to("double"), lift(im).to("double")

    @classmethod
    def of(cls, x: Any) -> Complex:
        return x if isinstance(x, Complex) else cls(x)

    @classmethod
    def column(cls, c: Column) -> Complex:
        return cls(Vec(c["re"], "double"), Vec(c["im"], "double"))

    def __add__(self, o: Any) -> Complex:
        o = Complex.of(o)
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Any) -> Complex:
        o = Complex.of(o)
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o: Any) -> Complex:
        o = Complex.of(o)
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o: Any) -> Complex:
        o = Complex.of(o)
        d = o.re * o.re + o.im * o.im
        return Complex((self.re * o.re + self.im * o.im) / d, (self.im * o.re - self.re * o.im) / d)

    def struct(self) -> Column:
        return F.struct(self.re.col.alias("re"), self.im.col.alias("im"))
