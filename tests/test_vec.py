"""Edge matrices of the element-wise rules."""

import math

import pytest
from pyspark.sql import functions as F

from vecframe.functions import vec as v
from vecframe.functions.complexes import Complex
from vecframe.functions.vec import Vec, lift, meet
from vecframe.operators.frame import Frame

INF, NAN = float("inf"), float("nan")


def values(spark, rows, schema, make):
    f = Frame(spark.createDataFrame(rows, schema))
    return [r.x for r in f.df.select("i", make(f).alias("x")).orderBy("i").collect()]


def same(a, b):
    return len(a) == len(b) and all((x is None and y is None) or (x is not None and y is not None and (x == y and (x != 0 or math.copysign(1, x) == math.copysign(1, y)) or (x != x and y != y))) for x, y in zip(a, b, strict=True))


NA_DBL = [(0, 1.0), (1, None), (2, NAN), (3, INF), (4, -INF), (5, 0.0), (6, -0.0), (7, -1.9), (8, 1e300)]


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda x: v.sqrt(x), [1, None, NAN, INF, NAN, 0.0, -0.0, NAN, 1e150]),
        (lambda x: v.log(x), [0.0, None, NAN, INF, NAN, -INF, -INF, NAN, math.log(1e300)]),
        (lambda x: v.floor(x), [1, None, NAN, INF, -INF, 0.0, 0.0, -2, 1e300]),
        (lambda x: v.trunc(x), [1, None, NAN, INF, -INF, 0.0, 0.0, -1, 1e300]),
        (lambda x: v.ceiling(x), [1, None, NAN, INF, -INF, 0.0, 0.0, -1, 1e300]),
        (lambda x: v.is_na(x), [False, True] + [False] * 7),
        (lambda x: v.is_nan(x), [False, False, True] + [False] * 6),
        (lambda x: v.is_finite(x), [True, False, False, False, False, True, True, True, True]),
        (lambda x: v.is_infinite(x), [False, False, False, True, True] + [False] * 4),
        (lambda x: v.as_integer(x), [1, None, None, None, None, 0, 0, -1, None]),
        (lambda x: v.as_logical(x), [True, None, None, True, True, False, False, True, True]),
        (lambda x: v.ifelse(x > 0.5, 1, 2.5), [1.0, 2.5, 1.0, 1.0, 2.5, 2.5, 2.5, 2.5, 1.0]),
        (lambda x: 1.0 / x, [1, None, NAN, 0.0, -0.0, INF, -INF, 1 / -1.9, 1e-300]),
        (lambda x: x**2, [1, None, NAN, INF, INF, 0.0, 0.0, 3.61, INF]),
    ],
)
def test_doubles(spark, make, want):
    got = values(spark, NA_DBL, "i long, x double", lambda f: make(f["x"]))
    assert same([round(g, 9) if isinstance(g, float) and abs(g) < 1e6 and g == g else g for g in got], [round(w, 9) if isinstance(w, float) and w == w and abs(w) < 1e6 else w for w in want])


def test_division_has_ieee_signs(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (1.0, -1.0, 0.0, None) for b in (0.0, -0.0, 3.0, None))]
    got = values(spark, rows, "i long, x double, y double", lambda f: f["x"] / f["y"])
    import numpy as np

    with np.errstate(all="ignore"):
        want = [None if a is None or b is None else float(np.float64(a) / np.float64(b)) for _, a, b in rows]
    assert same(got, want)


def test_integers(spark):
    top = 2**63 - 1
    rows = [(0, 5, 3), (1, -5, 3), (2, 5, -3), (3, 5, 0), (4, top, 1), (5, None, 2), (6, top, top)]
    schema = "i long, x long, y long"
    assert values(spark, rows, schema, lambda f: f["x"] // f["y"]) == [1, -1, -1, None, top, None, 1]
    assert values(spark, rows, schema, lambda f: f["x"] % f["y"]) == [2, -2, 2, None, 0, None, 0]
    assert values(spark, rows, schema, lambda f: f["x"] + f["y"]) == [8, -2, 2, 5, None, None, None]
    assert values(spark, rows, schema, lambda f: f["x"] * f["y"]) == [15, -15, -15, 0, top, None, None]
    assert values(spark, rows[:3], schema, lambda f: (f["x"] + 0.5) % f["y"]) == [2.5, 1.5, -0.5]
    assert values(spark, rows[:3], schema, lambda f: +(f["x"] > 0)) == [1, 0, 1]


def test_texts(spark):
    rows = list(enumerate(["", "a", "TRUE", "FALSE", "t", "1", "1.5", " 12 ", "abc", None]))
    schema = "i long, x string"
    assert values(spark, rows, schema, lambda f: v.as_logical(f["x"])) == [None, None, True, False] + [None] * 6
    assert values(spark, rows, schema, lambda f: v.as_double(f["x"])) == [None] * 5 + [1.0, 1.5, 12.0, None, None]
    assert values(spark, rows, schema, lambda f: v.nchar(f["x"]))[-1] == 2
    assert values(spark, rows[:2], schema, lambda f: v.paste(f["x"], None, 1, True, sep="-")) == ["-NA-1-TRUE", "a-NA-1-TRUE"]
    assert values(spark, [(0, "a"), (1, "B")], schema, lambda f: f["x"] < "B") == [False, False]


def test_three_valued_logic(spark):
    three = [True, False, None]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in three for b in three)]
    assert values(spark, rows, "i long, x boolean, y boolean", lambda f: f["x"] & f["y"]) == [True, False, None, False, False, False, None, False, None]
    assert values(spark, rows, "i long, x boolean, y boolean", lambda f: f["x"] | f["y"]) == [True, True, True, True, False, None, True, None, None]


def test_pmin_rounding_and_recycling(spark):
    rows = [(0, 1.0, 2.0), (1, None, 2.0), (2, NAN, 2.0), (3, -2.5, -2.5), (4, 123456.0, 0.0)]
    schema = "i long, x double, y double"
    assert same(values(spark, rows, schema, lambda f: v.pmin(f["x"], f["y"])), [1.0, None, 2.0, -2.5, 0.0])
    assert values(spark, rows, schema, lambda f: v.round_(f["y"], 0)) == [2.0, 2.0, 2.0, -3.0, 0.0]
    assert values(spark, rows[4:], schema, lambda f: v.signif(f["x"], 2)) == [120000.0]
    assert values(spark, rows[4:], schema, lambda f: v.signif(f["y"], 2)) == [0.0]
    assert values(spark, rows, schema, lambda f: v.recycle([2, 4.5], f["i"])) == [2.0, 4.5, 2.0, 4.5, 2.0]


def test_switch_falls_through(spark):
    assert values(spark, [(0, "a"), (1, "b"), (2, "c"), (3, None)], "i long, x string", lambda f: v.switch(f["x"], {"a": None, "b": 1}, 0)) == [1, 1, 0, 0]


def test_smart_constructors_and_meet():
    assert meet("logical", "integer") == "integer" and meet("double", "character") == "character"
    with pytest.raises(TypeError):
        meet("other", "double")
    with pytest.raises(TypeError):
        lift([1])
    with pytest.raises(TypeError):
        lift("a") + 1


def test_constructors_need_no_work(spark):
    x = Vec(F.col("x"), "double")
    assert x + 0 is x and x * 1 is x and x**1 is x


def test_complex(spark):
    (r,) = spark.range(1).select((Complex(1.0, 2.0) / Complex(3.0, -4.0)).struct().alias("q"), (Complex(1.0, 2.0) - 1).struct().alias("d")).collect()
    q = (1 + 2j) / (3 - 4j)
    assert math.isclose(r.q.re, q.real) and math.isclose(r.q.im, q.imag) and (r.d.re, r.d.im) == (0.0, 2.0)
