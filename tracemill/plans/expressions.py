"""Conditions and expressions to columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from .ast import Binary, Call, Compare, Lit, Logic, Path, Template
from .parser import QueryError, epoch_nanos


@dataclass(frozen=True)
class Dialect:
    """What the query languages differ in."""

    name: str
    full: bool = True  # whether ~ and matches() match whole strings: ~
    full_matches: bool = False  # and matches()
    nulls: bool = False  # whether null is a literal that conditions can ask for
    descending: bool = True  # sortBy by default
    zero: bool = True  # whether arithmetic takes null as 0
    aliases: dict = field(default_factory=dict)


EVENTS = Dialect("events")
HEAP = Dialect("heap", full_matches=True, nulls=True, descending=False, zero=False, aliases={"class": "className", "shallow": "shallowSize", "retained": "retainedSize"})
SAMPLES = Dialect("samples", full=False)
NUMBER, TEXT, BOOL = T.DoubleType(), T.StringType(), T.BooleanType()


class Scope:
    """Names of one schema. under: columns of an element instead of a row's."""

    def __init__(self, schema: T.StructType, dialect: Dialect, under: tuple | None = None):
        self.schema, self.dialect, self.under = schema, dialect, under

    def path(self, parts: tuple) -> tuple:
        if self.under:
            c, t = self.under
            if parts == ("value",) and not isinstance(t, T.StructType):
                return c, t, False
            return C.walk(c, t, parts)
        return C.at_path(self.schema, parts, self.dialect.aliases)

    # values
    def value(self, e) -> tuple:
        """(column, type) of an expression; an array met on a path gives an array."""
        if isinstance(e, Lit):
            v = e.value
            return F.lit(v), NUMBER if isinstance(v, (int, float)) and not isinstance(v, bool) else BOOL if isinstance(v, bool) else TEXT
        if isinstance(e, Path):
            c, t, many = self.path(e.parts)
            return (c, T.ArrayType(t)) if many else C.unwrapped(c, t)
        if isinstance(e, Binary):
            return self.arithmetic(e)
        if isinstance(e, Template):
            parts = [F.lit(p) if isinstance(p, str) else F.coalesce(C.as_text(*self.value(p)), F.lit("")) for p in e.parts]
            return F.concat(*parts), TEXT
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, (Compare, Logic)):
            return self.condition(e), BOOL
        raise QueryError(f"not a value: {e}")

    def number(self, e) -> Column:
        return C.as_double(*self.value(e))

    def arithmetic(self, e: Binary) -> tuple:
        a, b = self.value(e.left), self.value(e.right)
        if e.op == "+" and self.dialect.zero and (isinstance(a[1], T.StringType) or isinstance(b[1], T.StringType)):
            return F.concat(*(F.coalesce(C.as_text(*x), F.lit("")) for x in (a, b))), TEXT
        x, y = (F.coalesce(C.as_double(*v), F.lit(0.0)) if self.dialect.zero else C.as_double(*v) for v in (a, b))
        if e.op == "/":
            return F.when(y == 0, F.lit(float("nan"))).otherwise(x / F.when(y == 0, 1.0).otherwise(y)), NUMBER
        return {"+": x + y, "-": x - y, "*": x * y}[e.op], NUMBER

    def call(self, e: Call) -> tuple:
        name, args = e.name.lower(), e.args
        if name == "if":
            (b, bt), (c, ct) = self.value(args[1]), self.value(args[2])
            if type(bt) is not type(ct):
                b, c, bt = C.as_text(b, bt), C.as_text(c, ct), TEXT
            return F.when(C.truthy(*self.value(args[0])), b).otherwise(c), bt
        if name == "coalesce":
            values = [self.value(a) for a in args]
            if len({type(t) for _, t in values}) > 1:
                return F.coalesce(*(C.as_text(*v) for v in values)), TEXT
            return F.coalesce(*(c for c, _ in values)), values[0][1]
        if name in ("upper", "lower", "trim"):
            return {"upper": F.upper, "lower": F.lower, "trim": F.trim}[name](C.as_text(*self.value(args[0]))), TEXT
        if name in ("length", "len"):
            return self.length(args[0]), T.LongType()
        if name == "substring":
            s = C.as_text(*self.value(args[0]))
            start = self.number(args[1]).cast("int") + 1
            size = self.number(args[2]).cast("int") if len(args) > 2 else F.length(s)
            return F.substring(s, start, size), TEXT
        if name == "asdatetime":
            return C.datetime_text(self.number(args[0]) if not self.is_long(args[0]) else self.value(args[0])[0], args[1].value if len(args) > 1 else None), TEXT
        if name == "formatduration":
            return C.duration_text(self.value(args[0])[0]), TEXT
        if name == "truncate":
            return C.truncated(self.value(args[0])[0], args[1].value), T.LongType()
        if name in ("abs", "round", "floor", "ceil"):
            x = self.number(args[0])
            return {"abs": F.abs, "round": C.half_up, "floor": F.floor, "ceil": F.ceil}[name](x), NUMBER
        if name in CONDITIONS:
            return self.condition(e), BOOL
        raise QueryError(f"unknown function {e.name}")

    def is_long(self, e) -> bool:
        return isinstance(self.value(e)[1], T.IntegralType)

    def length(self, e) -> Column:
        c, t = self.value(e)
        if isinstance(t, T.StringType):
            return F.length(c).cast("long")
        return F.when(c.isNotNull(), F.size(c)).cast("long") if isinstance(t, (T.ArrayType, T.MapType)) else F.lit(None).cast("long")

    # conditions
    def condition(self, e) -> Column:
        """A condition that is never null."""
        if isinstance(e, Logic):
            if e.op == "not":
                return ~self.condition(e.args[0])
            a, b = (self.condition(x) for x in e.args)
            return a & b if e.op == "and" else a | b
        if isinstance(e, Compare):
            return self.compare(e)
        if isinstance(e, Call) and e.name.lower() in CONDITIONS:
            return F.coalesce(self.test(e), F.lit(False))
        return C.truthy(*self.value(e))

    def compare(self, e: Compare) -> Column:
        if isinstance(e.left, Path):
            c, t, many = self.path(e.left.parts)
            if many or isinstance(t, T.ArrayType):
                kind = t if many else t.elementType
                own = lambda x: self.one(e.op, *C.unwrapped(x, kind), e.right)
                if e.mode == "all":
                    return F.coalesce((F.size(c) > 0) & F.forall(c, own), F.lit(False))
                hit = F.coalesce(F.exists(c, own), F.lit(False))
                return ~hit if e.mode == "none" else hit
        c, t = self.value(e.left)
        out = self.one(e.op, c, t, e.right)
        return ~out if e.mode == "none" else out

    def one(self, op: str, c: Column, t: T.DataType, right) -> Column:
        if isinstance(right, Lit) and right.value is None:
            if not self.dialect.nulls:
                return F.lit(False)
            return {"=": c.isNull(), "!=": c.isNotNull()}.get(op, F.lit(False))
        rc, rt = self.value(right)
        missing = c.isNull() if self.dialect.nulls and op == "!=" else F.lit(False)
        if op == "~":
            pattern = right.value if isinstance(right, Lit) else None
            if pattern is None:
                raise QueryError("a pattern must be a literal")
            s = C.as_text(c, t)
            return F.coalesce(C.full_match(s, str(pattern)) if self.dialect.full else s.rlike(str(pattern)), F.lit(False))
        textual = isinstance(rt, T.StringType)
        nanos = epoch_nanos(right.value) if textual and isinstance(right, Lit) and C.is_number(t) else None
        if nanos is not None:
            a, b = c.cast("long"), F.lit(nanos)
        elif isinstance(t, T.BooleanType) or isinstance(rt, T.BooleanType):
            a, b = C.as_text(c, t), C.as_text(rc, rt)
        elif textual and (op in ("=", "!=") or not C.is_number(t)):
            a, b = C.as_text(c, t), C.as_text(rc, rt)
        elif isinstance(t, T.IntegralType) and isinstance(right, Lit) and isinstance(right.value, int):
            a, b = c, rc  # as they are, so that the scan can take the filter
        else:
            a, b = C.as_double(c, t), C.as_double(rc, rt)
        out = {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        return F.coalesce(out, F.lit(False)) | missing

    def test(self, e: Call) -> Column:
        name, args = e.name.lower(), e.args
        if name in ("contains", "startswith", "endswith", "matches") and isinstance(args[0], Path):
            c, t, many = self.path(args[0].parts)
            if many:
                return F.exists(c, lambda x: F.coalesce(self.string_test(name, C.as_text(x, t), args), F.lit(False)))
        if name in ("contains", "startswith", "endswith", "matches"):
            return self.string_test(name, C.as_text(*self.value(args[0])), args)
        c, t = self.value(args[0])
        if name == "exists":
            return c.isNotNull()
        if name == "empty":
            return c.isNull() | ((F.length(c) == 0) if isinstance(t, T.StringType) else (F.size(c) == 0) if isinstance(t, (T.ArrayType, T.MapType)) else F.lit(False))
        bounds = []
        for a in args[1:]:
            ns = epoch_nanos(a.value) if isinstance(a, Lit) and isinstance(a.value, str) else None
            bounds.append((F.lit(ns) if ns is not None else self.number(a), ns))
        x = c.cast("long") if bounds and bounds[0][1] is not None else C.as_double(c, t)
        if name == "between":
            return (x >= bounds[0][0]) & (x <= bounds[1][0])
        if name == "before":
            return x < bounds[0][0]
        if name == "after":
            return x > bounds[0][0]
        day = 86_400 * C.NANOS
        start = bounds[0][1] // day * day if bounds[0][1] is not None else None
        if start is None:
            raise QueryError("on() needs a date")
        return (x >= start) & (x < start + day)

    def string_test(self, name: str, s: Column, args: tuple) -> Column:
        if name == "matches":
            pattern = ("(?i)" if len(args) > 2 and "i" in str(args[2].value) else "") + str(args[1].value)
            return C.full_match(s, pattern) if self.dialect.full_matches else s.rlike(pattern)
        other = C.as_text(*self.value(args[1]))
        return {"contains": s.contains, "startswith": s.startswith, "endswith": s.endswith}[name](other)


CONDITIONS = frozenset("contains startswith endswith matches exists empty between before after on".split())
