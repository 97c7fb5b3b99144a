"""Running trees on a frame.

Names are columns of the frame or variables set before.  Maps stay lazy: they become one expression.  A fold is a number for
what comes after it, so that the folds an expression needs are computed first, all of one depth in one pass; x[mask] selects
for the folds and for the result.  Control flow and functions run at the driver, on numbers that folds have made; scans add
a column to the frame.
"""

from __future__ import annotations

import math
from collections import ChainMap
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import registry
from ..functions import vec as v
from ..functions.vec import Vec, lift
from ..operators import folds as fo
from ..operators.frame import Frame
from .parse import MISSING, Call, Name, parse

_MAPS = {n: getattr(v, n) for n in ("sqrt", "exp", "sign", "cos", "sin", "tan", "acos", "asin", "atan", "floor", "ceiling", "log", "trunc", "atan2", "hypot", "signif", "pmin", "pmax", "ifelse", "nchar", "nzchar")}
_MAPS |= {"abs": abs, "round": v.round_, "is.na": v.is_na, "is.nan": v.is_nan, "is.finite": v.is_finite, "is.infinite": v.is_infinite, "as.integer": v.as_integer, "as.double": v.as_double, "as.numeric": v.as_double, "as.logical": v.as_logical, "as.character": v.as_character}
_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "^": lambda a, b: a**b, "%%": lambda a, b: a % b, "%/%": lambda a, b: a // b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "&": lambda a, b: a & b, "|": lambda a, b: a | b, "&&": lambda a, b: a & b, "||": lambda a, b: a | b}
_FOLDS = {"sum": fo.sum_, "prod": fo.prod, "min": fo.min_, "max": fo.max_, "any": fo.any_, "all": fo.all_, "mean": fo.mean, "var": fo.var, "sd": fo.sd, "cov": fo.cov, "cm2": fo.cm2, "length": fo.length}


#: The same on two numbers that are known already: only what has no rules of its own for integers, zero or NA.
_PLAIN = {n: _BINARY[n] for n in ("==", "!=", "<", "<=", ">", ">=")}
_PLAIN |= {n: lambda a, b, f=_BINARY[n]: f(float(a), float(b)) if isinstance(a, float) or isinstance(b, float) else f(a, b) for n in ("+", "-", "*")}
_PLAIN["/"] = lambda a, b: a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a) * math.copysign(1.0, b)


class Selected:
    """A vector and the mask that selects from it."""

    def __init__(self, x: Vec, mask: Vec):
        self.x, self.mask = x, mask


class Grouped:
    """A vector dealt to groups by codes from 0 up to size."""

    def __init__(self, x: Vec, by: Vec, size: int):
        self.x, self.by, self.size = x, by, size


class Closure:
    """A function of a program: parameters with defaults, body, and the variables where it was made."""

    def __init__(self, parameters: list[tuple[str, Any]], body: Any, scope: ChainMap):
        self.parameters, self.body, self.scope = parameters, body, scope

    def bound(self, positional: list[Any], named: dict[str, Any]) -> dict[str, Any]:
        """Values of parameters: by whole name, then by the beginning of a name, then in order."""
        free, out = [n for n, _ in self.parameters], {}
        for how in (lambda p, n: p == n, lambda p, n: p.startswith(n)):
            for n in [n for n in named if n not in out.values()]:
                fits = [p for p in free if how(p, n)]
                if len(fits) == 1:
                    free.remove(fits[0])
                    out[fits[0]] = n
        if len(out) < len(named) or len(positional) > len(free):
            raise TypeError("unused argument")
        return {p: named[n] for p, n in out.items()} | dict(zip(free, positional, strict=False))


class _Waiting(Exception):
    """A fold isn't computed yet."""


class _Leave(Exception):
    """break, next or return on its way."""

    def __init__(self, how: str, value: Any = None):
        self.how, self.value = how, value


#: What a statement is that has parts of its own.
_CONTROL = {"<-", "{", "if", "for", "while", "repeat", "break", "next", "function", "return"}
_SCANS = {"cumsum": "sum", "cumprod": "prod", "cummin": "min", "cummax": "max"}


class Program:
    """Variables over one frame."""

    def __init__(self, frame: Frame, variables: ChainMap | None = None):
        self.frame, self.variables = frame, ChainMap() if variables is None else variables
        self._done: dict[int, Any] = {}
        self._wanted: dict[int, fo.Fold] = {}

    def run(self, text: str) -> Any:
        """The value of the last expression: a Python value, a Vec, or a Selected."""
        out: Any = None
        for tree in parse(text):
            out = self._statement(tree)
        return out

    def _statement(self, tree: Any) -> Any:
        if isinstance(tree, Call) and tree.function in _CONTROL:
            return self._controlled(tree.function, [a for _, a in tree.arguments], tree)
        self._done = {}
        while True:
            self._wanted = {}
            try:
                return self._value(tree)
            except _Waiting:
                self._look(tree)
                row = self.frame.df.agg(*[f.alias(f"f{i}") for i, f in enumerate(self._wanted.values())]).first()
                self._done |= dict(zip(self._wanted, row, strict=True))

    def _controlled(self, word: str, parts: list[Any], tree: Call) -> Any:
        out: Any = None
        if word == "<-":
            return self._assign(parts[0], self._statement(parts[1]))
        if word == "{":
            for p in parts:
                out = self._statement(p)
        elif word == "function":
            out = Closure(tree.arguments[:-1], parts[-1], self.variables)
        elif word == "if":
            branch = parts[1:2] if self._true(parts[0]) else parts[2:]
            out = self._statement(branch[0]) if branch else None
        elif word in ("break", "next"):
            raise _Leave(word)
        elif word == "return":
            raise _Leave(word, self._statement(parts[0]) if parts else None)
        else:
            values = iter(self._listed(self._statement(parts[1]))) if word == "for" else iter(int, 1)
            for value in values:
                if word == "for":
                    self.variables[parts[0].name] = value
                elif word == "while" and not self._true(parts[0]):
                    break
                try:
                    self._statement(parts[-1])
                except _Leave as leave:
                    if leave.how == "return":
                        raise
                    if leave.how == "break":
                        break
        return out

    def _true(self, tree: Any) -> bool:
        """A condition: one value that isn't NA.  && and || look at their second part only where the first doesn't decide."""
        if isinstance(tree, Call) and tree.function in ("&&", "||"):
            first = self._true(tree.arguments[0][1])
            return first if first == (tree.function == "||") else self._true(tree.arguments[1][1])
        if isinstance(tree, Call) and tree.function == "!":
            return not self._true(tree.arguments[0][1])
        value = self._statement(tree)
        if isinstance(value, Vec):
            value = self._number(value)
        if value is None:
            raise ValueError("a condition is NA")
        if not isinstance(value, (bool, int, float)):
            raise TypeError("a condition is one value")
        return bool(value)

    def _number(self, x: Vec) -> Any:
        """The value of an expression of numbers only."""
        try:
            return self.frame.df.sparkSession.range(1).select(x.alias("x")).first()[0]
        except AnalysisException:
            raise TypeError("a condition is one value, not a vector") from None

    @staticmethod
    def _listed(value: Any) -> Any:
        return value if isinstance(value, (list, range)) else [value]

    def _assign(self, target: Any, value: Any) -> Any:
        """name <- value, or a part of a vector: name[mask] <- value, name[positions] <- value, name[[position]] <- value."""
        if isinstance(target, Name):
            self.variables[target.name] = value
            return value
        if not (isinstance(target, Call) and target.function in ("[", "[[") and isinstance(target.arguments[0][1], Name)):
            raise TypeError("names, and parts of named vectors, can be set")
        name, at = target.arguments[0][1].name, self._statement(target.arguments[1][1])
        old = self._value(Name(name))
        if isinstance(old, list) and isinstance(at, (int, float)):
            old[len(old) :] = [None] * (int(at) - len(old))  # beyond the end, NA fills the gap
            old[int(at) - 1] = value
            return value
        if name in self.variables or not (isinstance(old, Vec) and name in self.frame.df.columns):
            if not isinstance(at, Vec) or isinstance(value, list):
                raise TypeError("only a mask and one value can set parts of what isn't a column")
            self.variables[name] = v.ifelse(at, value, old)
        elif isinstance(at, Vec):
            self.frame = self.frame.assign(name, at, value)
        else:
            places, values = [int(p) for p in self._listed(at)], self._listed(value)
            rows = {p: values[i % len(values)] for i, p in enumerate(places)}  # of repeated positions the last counts
            kind = "double" if any(isinstance(x, float) for x in rows.values()) else "string" if any(isinstance(x, str) for x in rows.values()) else "bigint"
            new = self.frame.df.sparkSession.createDataFrame(list(rows.items()), f"at bigint, x {kind}")
            self.frame = self.frame.assign_at(name, new, "at", "x")
        return value

    def _part(self, c: Call, x: Any, at: Any) -> Any:
        """x[at] and x[[at]] by position from 1; past the end NA, or with [[ an error."""
        places = [int(p) for p in self._listed(at)]
        if isinstance(x, (list, range)):
            found = {i: y for i, y in enumerate(x, 1)}
        else:
            order = self.frame.order
            rows = self.frame.with_(_x=lift(x)).slice(min(places), max(places)).df.orderBy(*order).select("_x").collect()
            found = dict(enumerate((r[0] for r in rows), min(places)))
        if c.function == "[[" and (len(places) != 1 or places[0] not in found):
            raise IndexError("subscript out of bounds")
        out = [found.get(p) for p in places if p]
        return out if isinstance(at, (list, range)) else out[0] if out else None

    def _apply(self, f: Closure, positional: list[Any], named: dict[str, Any]) -> Any:
        inner = Program(self.frame, f.scope.new_child(f.bound(positional, named)))
        for n, default in f.parameters:
            if n not in inner.variables.maps[0]:
                if default is MISSING:
                    continue
                inner.variables[n] = inner._statement(default)
        try:
            out = inner._statement(f.body)
        except _Leave as leave:
            if leave.how != "return":
                raise
            out = leave.value
        self.frame = inner.frame
        return out

    def _look(self, tree: Any) -> None:
        """Notes every fold whose arguments are ready."""
        if isinstance(tree, Call):
            for _, a in tree.arguments:
                self._look(a)
            try:
                self._value(tree)
            except _Waiting:
                pass

    def _value(self, tree: Any) -> Any:
        if isinstance(tree, Name):
            if tree.name in self.variables:
                return self.variables[tree.name]
            if tree.name in self.frame.df.columns:
                return self.frame[tree.name]
            raise NameError(tree.name)
        return self._call(tree) if isinstance(tree, Call) else tree

    def _call(self, c: Call) -> Any:
        if c.function == "NA":
            return Vec(F.lit(None).cast("boolean"), "logical")
        if c.function in _FOLDS:
            return self._fold(c)
        if id(c) in self._done:
            return self._done[id(c)]
        if c.function in _CONTROL:
            return Program(self.frame, self.variables)._statement(c)
        if c.function in ("sapply", "lapply") and isinstance(c.arguments[1][1], Name) and c.arguments[1][1].name in _FOLDS:
            g = self._value(c.arguments[0][1])
            if isinstance(g, Grouped):
                out = self.frame.with_(_by=g.by, _g=g.x)
                rows = out.split("_by").dense(g.size, v=_FOLDS[c.arguments[1][1].name](out["_g"])).collect()  # size rows
                self._done[id(c)] = [r["v"] for r in sorted(rows, key=lambda r: r["_by"])]
                return self._done[id(c)]
        positional = [self._value(a) for n, a in c.arguments if n is None]
        named = {n: self._value(a) for n, a in c.arguments if n is not None}
        if isinstance(f := self.variables.get(c.function), Closure):
            self._done[id(c)] = self._apply(f, positional, named)
            return self._done[id(c)]
        if c.function in ("sapply", "lapply"):
            return [self._apply(positional[1], [y], {}) for y in self._listed(positional[0])]
        if c.function == "split":
            return Grouped(lift(positional[0]), lift(positional[1]), int(positional[2]))
        if c.function == ":":
            a, b = map(int, positional)
            return range(a, b + 1) if a <= b else range(a, b - 1, -1)
        if c.function in ("seq_len", "seq"):
            a, b, by = ([1, *positional, 1] if len(positional) == 1 else [*positional, 1])[:3]
            return range(int(a), int(b) + 1, int(by))
        if c.function == "rep":
            return list(self._listed(positional[0])) * int(positional[1])
        if c.function in _SCANS:
            name = f"_scan{len([n for n in self.frame.df.columns if n.startswith('_scan')])}"
            self.frame = self.frame.with_(_scanned=positional[0]).scan(_SCANS[c.function], "_scanned", name)
            self.frame = Frame(self.frame.df.drop("_scanned"), self.frame.order)
            self._done[id(c)] = self.frame[name]
            return self._done[id(c)]
        if c.function == "stop":
            raise RuntimeError("".join(map(str, positional)))
        if c.function in ("[", "[[") and not isinstance(positional[1], (Vec, bool, type(None))):
            return self._part(c, *positional)
        if c.function == "[":
            x, mask = positional
            return Selected(x.x, x.mask & mask) if isinstance(x, Selected) else Selected(lift(x), lift(mask))
        if c.function == "$":
            return self.frame[c.arguments[1][1].name]
        mask = next((p.mask for p in positional if isinstance(p, Selected)), None)
        args = [p.x if isinstance(p, Selected) else p for p in positional]
        if c.function == "c":
            return [y for a in args for y in self._listed(a)]
        if c.function in _BINARY and len(args) == 2 and all(isinstance(a, (bool, int, float)) for a in args) and c.function in _PLAIN:
            return _PLAIN[c.function](*args)
        if c.function == "paste":
            out = v.paste(*args, sep=named.get("sep", " "))
        elif c.function == "switch":
            out = v.switch(args[0], {k: None if x is None else x for k, x in named.items()}, args[1] if len(args) > 1 else None)
        elif c.function in ("-", "+", "!") and len(args) == 1:
            out = {"-": lambda a: -a, "+": lambda a: +a, "!": lambda a: ~a}[c.function](lift(args[0]))
        elif c.function in _BINARY:
            out = _BINARY[c.function](lift(args[0]), args[1])
        elif c.function in _MAPS:
            whole = {k: int(x) if isinstance(x, float) and x == int(x) else x for k, x in named.items()}
            if c.function in ("round", "signif"):
                args[1:] = [int(a) if isinstance(a, float) else a for a in args[1:]]
            out = _MAPS[c.function](lift(args[0]), *args[1:], **whole)
        else:
            out = registry.call(c.function, *args)
        return out if mask is None else Selected(out, mask)

    def _fold(self, c: Call) -> Any:
        if id(c) in self._done:
            return self._done[id(c)]
        args = [self._value(a) for n, a in c.arguments if n is None]
        if args and all(isinstance(a, (list, range)) for a in args) and c.function in ("sum", "length", "min", "max", "prod"):
            every = [y for a in args for y in a]
            return {"sum": sum, "length": len, "min": min, "max": max, "prod": math.prod}[c.function](every)
        options = {n.replace(".", "_"): self._value(a) for n, a in c.arguments if n is not None}
        if all(not isinstance(a, (Vec, Selected)) for a in args) and c.function != "length":
            args = [lift(a) for a in args]
        mask = next((a.mask for a in args if isinstance(a, Selected)), None)
        vectors = [a.x if isinstance(a, Selected) else lift(a) for a in args]
        if mask is not None:
            if c.function in ("any", "all", "var", "sd", "cov", "cm2"):
                m = mask.to("logical").col
                vectors = [Vec(F.when(m, x.col), x.kind) for x in vectors]
                options["na_rm"] = True
            else:
                options["where"] = mask
        self._wanted[id(c)] = _FOLDS[c.function](*vectors, **options)
        raise _Waiting


def evaluate(frame: Frame, text: str) -> Any:
    """The value of a program's last expression on the frame: folds give Python values, maps a Vec."""
    return Program(frame).run(text)


def select(frame: Frame, *keep: str, **texts: str) -> DataFrame:
    """Columns from expressions; what x[mask] leaves out is NA."""
    out = {}
    for n, t in texts.items():
        x = evaluate(frame, t)
        out[n] = Vec(F.when(x.mask.to("logical").col, x.x.col), x.x.kind) if isinstance(x, Selected) else lift(x)
    return frame.select(*keep, **out)
