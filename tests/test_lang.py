import math

import pytest

from vecframe.lang.parse import Call, Name, SyntaxProblem, parse
from vecframe.lang.run import Program, evaluate, select
from vecframe.operators.frame import Frame


def show(t):
    return f"({t.function} {' '.join(('' if n is None else n + '=') + show(a) for n, a in t.arguments)})" if isinstance(t, Call) else t.name if isinstance(t, Name) else repr(t)


@pytest.mark.parametrize(
    "text, tree",
    [
        ("-2^2", "(- (^ 2.0 2.0))"),
        ("a+b*c %% d", "(+ a (* b (%% c d)))"),
        ("-1:3", "(: (- 1.0) 3.0)"),
        ("!x == y & z", "(& (! (== x y)) z)"),
        ("2^3^2", "(^ 2.0 (^ 3.0 2.0))"),
        ("x <- y <- 3L", "(<- x (<- y 3))"),
        ("3 -> x", "(<- x 3.0)"),
        ("f(a, k = 2)[m > 1]", "([ (f a k=2.0) (> m 1.0))"),
        ("x[y[[1]]]", "([ x ([[ y 1.0))"),
        ("x[[y[1]]]", "([[ x ([ y 1.0))"),
        ("a %/% b %o% c", "(%o% (%/% a b) c)"),
        ("0xFFL; 1e3", "255 | 1000.0"),
        ("(1 +\n 2) # sum\n'it\\'s'", "(+ 1.0 2.0) | \"it's\""),
        ("r$x", "($ r x)"),
        ("2i", "(complex 0.0 2.0)"),
    ],
)
def test_trees(text, tree):
    assert " | ".join(map(show, parse(text))) == tree


@pytest.mark.parametrize("text", ["1 +", "f(", "a b", "'x", "x[1"])
def test_mistakes(text):
    with pytest.raises((SyntaxProblem, IndexError)):
        parse(text)


@pytest.fixture(scope="module")
def frame(spark):
    return Frame(spark.createDataFrame([(i, float(x), x % 3) for i, x in enumerate([3, 1, 4, 1, 5, 9, 2, 6])], "i long, x double, g long"), "i")


XS = [3, 1, 4, 1, 5, 9, 2, 6]


def test_folds(frame):
    assert evaluate(frame, "sum(x)") == sum(XS)
    m = sum(XS) / 8
    s = math.sqrt(sum((x - m) ** 2 for x in XS) / 7)
    assert evaluate(frame, "sum(abs((x - mean(x)) / sd(x)) > 1)") == sum(abs((x - m) / s) > 1 for x in XS)
    assert evaluate(frame, "length(x[x > 3 & g != 0L])") == sum(x > 3 and x % 3 != 0 for x in XS)
    p = Program(frame)
    assert p.run("z <- x * 2\nm = max(z)\nsum(z[z == m])") == 18.0
    with pytest.raises(NameError):
        evaluate(frame, "sum(nothing)")


def test_maps(frame):
    rows = select(frame, "i", y="ifelse(x >= 4, x ^ 2, -x)", r="round(x / 3, 2)", s="paste(g, x > 2, sep='-')", t="x[g == 1L]", m="x %% 2 + g %/% 2L").orderBy("i").collect()
    assert [r.y for r in rows] == [x * x if x >= 4 else -x for x in XS]
    assert [r.r for r in rows] == [round(x / 3, 2) for x in XS]
    assert [r.s for r in rows] == [f"{x % 3}-{str(x > 2).upper()}" for x in XS]
    assert [r.t for r in rows] == [x if x % 3 == 1 else None for x in XS]
    assert [r.m for r in rows] == [x % 2 + (x % 3) // 2 for x in XS]


CONTROL = [
    ("s <- 0; for (i in 1:10) { if (i == 3) next; if (i > 6) break; s <- s + i }; s", 18),
    ("f <- function(n, base = 2) {\n  if (n <= 0) return(1)\n  base * f(n - 1, base)\n}\nf(5)", 32.0),
    ("f <- function(value, scale = 10) value * scale\nf(scale = 3, 2) + f(v = 1)", 16.0),
    ("k <- 0\nwhile (k * k < 50) k <- k + 1\nk", 8.0),
    ("k <- 0; repeat { k <- k + 2; if (k >= 7) break }; k", 8.0),
    ("if (sum(x) > 1000) 'large' else 'small'", "small"),
    ("g <- function(a) { b <- a + 1; b }; b <- 5; g(1); b", 5.0),
    ("v <- c(1, 2); v[5] <- 9; length(v)", 5),
    ("sum(lapply(1:4, function(i) i * 2))", 20),
    ("if (FALSE && stop('never')) 1 else 2", 2.0),
]


@pytest.mark.parametrize("text, want", CONTROL)
def test_control_flow_and_functions(spark, text, want):
    f = Frame(spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "i long, x double"), "i")
    assert Program(f).run(text) == want


def test_parts_scans_groups_and_assignment(spark):
    f = Frame(spark.createDataFrame([(i, float(i), i % 3) for i in range(1, 11)], "i long, x double, g long"), "i").df.repartition(3)
    p = Program(Frame(f, "i"))
    assert p.run("x[3]") == 3.0 and p.run("x[[10]]") == 10.0 and p.run("x[11]") is None and p.run("x[2:4]") == [2.0, 3.0, 4.0]
    with pytest.raises(IndexError):
        p.run("x[[11]]")
    assert p.run("max(cumsum(x))") == 55.0 and p.run("sum(cumsum(x)[x < 3])") == 4.0
    assert p.run("lapply(split(x, g, 4), sum)") == [18.0, 22.0, 15.0, 0.0]
    p.run("x[x > 8] <- 0\nx[c(1, 2)] <- c(100, 200)")
    assert p.run("sum(x)") == 300 + 3 + 4 + 5 + 6 + 7 + 8
    p.run("y <- x * 2; y[x > 50] <- 1")
    assert p.run("sum(y)") == 2 + 2 * 33
    # one Newton step after another, each on the folds of the one before
    assert abs(p.run("m <- 1; for (k in 1:20) m <- m - (m * m - mean(g + 1)) / (2 * m); m") - 2.0**0.5) < 1e-9
    with pytest.raises(ValueError):
        p.run("if (NA) 1")
    with pytest.raises(TypeError):
        p.run("if (x > 1) 1")
    with pytest.raises(RuntimeError, match="no"):
        p.run("stop('no')")
    with pytest.raises(TypeError, match="unused"):
        p.run("f <- function(a) a; f(1, 2)")
