"""Query trees to DataFrame plans. Each operator maps rows to rows; order is kept as a list of sort columns and applied where it matters."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import decorate, stacks
from .ast import Call, Compare, Lit, Logic, Named, Op, Path, Query
from .expressions import EVENTS, Dialect, Scope
from .parser import QueryError

Key = C.Key

#: The place of a row in the order of arrival: its file, where there are several, its place there, and where several event types are read the place of its type among them.
FILE, ORD, TYPE = "_file", "_ord", "_type"
HIDDEN = (FILE, ORD, TYPE)
AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Rows:
    """df and its order. values: the column `value` is a projection. first: no operator has run yet."""

    df: DataFrame
    dialect: Dialect = EVENTS
    order: tuple = ()
    sorted: bool = False
    values: bool = False
    first: bool = True
    context: dict = field(default_factory=dict)

    @property
    def scope(self) -> Scope:
        return Scope(self.df.schema, self.dialect)

    @property
    def names(self) -> list:
        return [c for c in self.df.columns if c not in HIDDEN]

    def to(self, df: DataFrame, order: tuple = (), **more) -> Rows:
        return replace(self, df=df, order=order, first=False, **({"values": False, "sorted": False} | more))

    def keep(self, df: DataFrame) -> Rows:
        """Other rows with the same columns to sort by."""
        return replace(self, df=df, first=False)

    def ordering(self) -> list:
        return [*self.order, *(Key(F.col(c)) for c in self.hidden)]

    @property
    def hidden(self) -> list:
        return [c for c in HIDDEN if c in self.df.columns]

    def result(self) -> DataFrame:
        df = self.df.orderBy(*map(Key.sort, self.ordering())) if self.sorted and self.order else self.df
        return df.drop(*HIDDEN)


def option(op: Op, name: str, default=None, at: int | None = None):
    """An option, or a positional argument, as a plain value: literals and bare names give themselves."""
    v = op.options.get(name)
    if v is None and at is not None and len(op.args) > at:
        v = op.args[at]
    return default if v is None else v.value if isinstance(v, Lit) else v.text if isinstance(v, Path) else v


def target(rows: Rows, op: Op, name: str = "path"):
    """What an aggregate or transform works on: its argument, else the projected values, else the first column."""
    e = op.options.get(name) or next((a for a in op.args if isinstance(a, Path)), None)
    if e is not None:
        return e
    if rows.values:
        return Path(("value",))
    return Path((rows.names[0],)) if rows.names else None


# scans
def filtered(rows: Rows, conditions: tuple) -> Rows:
    for c in conditions:
        rows = replace(rows, df=rows.df.where(rows.scope.condition(c)))
    return rows


def projected(rows: Rows, path: tuple) -> Rows:
    """The values at a path: arrays on the way are iterated, nulls dropped; filters of a step see what the step gives."""
    df = rows.df
    for i, step in enumerate(path):
        c, t, _ = C.at_path(df.schema, (step.key,), rows.dialect.aliases) if i == 0 else C.walk(F.col("value"), df.schema["value"].dataType, (step.key,))
        keep = rows.hidden
        if isinstance(t, T.ArrayType) and step.span:
            c = F.array(F.get(c, F.lit(step.span[0]))) if len(step.span) == 1 else F.slice(c, step.span[0] + 1, F.greatest(F.lit(0), (F.lit(step.span[1]) if step.span[1] is not None else F.size(c)) - step.span[0]))
        last = i == len(path) - 1
        following_index = not last and isinstance(path[i + 1].key, int)
        df = df.select(*keep, (F.explode(c) if isinstance(t, T.ArrayType) and not following_index else c).alias("value")).where("value IS NOT NULL")
        for f in step.filters:
            own = Scope(df.schema, rows.dialect, under=(F.col("value"), df.schema["value"].dataType))
            df = df.where(own.condition(f))
    c, t = C.unwrapped(F.col("value"), df.schema["value"].dataType)
    return replace(rows, df=df.withColumn("value", c), values=True)


# aggregates
def count(rows: Rows, op: Op) -> Rows:
    return rows.to(rows.df.agg(F.count("*").alias("count")))


def numbers(rows: Rows, op: Op, name: str = "path") -> DataFrame:
    """A column x of the numbers that an aggregate takes; arrays are iterated."""
    e = target(rows, op, name)
    c, t = rows.scope.value(e)
    if isinstance(t, T.ArrayType):
        return rows.df.select(F.explode(c).alias("x")).select(C.as_double(F.col("x"), t.elementType).alias("x")).where("x IS NOT NULL")
    return rows.df.select(C.as_double(c, t).alias("x")).where("x IS NOT NULL")


def path_text(rows: Rows, op: Op) -> str:
    e = target(rows, op)
    return e.text if isinstance(e, Path) else "value"


def memory_field(name: str) -> bool:
    low = name.lower()
    return low.endswith("size") or any(w in low for w in ("shallow", "retained", "memory")) or low == "bytes"


def sum_(rows: Rows, op: Op) -> Rows:
    x = numbers(rows, op)
    total = F.coalesce(F.sum("x"), F.lit(0.0))
    if rows.first or rows.values:
        return rows.to(x.agg(total.alias("sum"), F.count("x").alias("count")))
    return rows.to(x.agg(total.alias(f"sum({path_text(rows, op)})")))


def stats(rows: Rows, op: Op) -> Rows:
    x = numbers(rows, op)
    if rows.dialect.name == "heap":
        name = path_text(rows, op)
        pre = f"{name}_" if memory_field(rows.dialect.aliases.get(name, name)) else ""
        return rows.to(x.agg(F.count("x").alias("count"), *(f("x").alias(pre + n) for n, f in (("sum", F.sum), ("min", F.min), ("max", F.max), ("avg", F.avg)))))
    if rows.dialect.name == "samples":
        name = path_text(rows, op)
        whole = lambda c: c.cast("long")
        return rows.to(x.agg(F.lit(name).alias("field"), F.count("x").alias("count"), whole(F.sum("x")).alias("sum"), whole(F.min("x")).alias("min"), whole(F.max("x")).alias("max"), whole(C.half_up(F.avg("x"))).alias("avg")))
    return rows.to(x.agg(F.count("x").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("avg"), F.stddev_pop("x").alias("stddev")))


#: Parts that a range of numbers is split into at each step towards a rank.
PARTS = 4096


def at_ranks(x: DataFrame, ranks: set, low: float, high: float) -> dict:
    """The numbers at some ranks (from 0) of the column x, all of them between low and high.

    Each step counts the numbers by equal parts of the ranges that hold a rank and goes on in the parts
    that do, between their least and greatest number. A step is an aggregation with map-side combine to
    PARTS rows a rank at most, so neither a task nor the driver gathers numbers.
    """
    found: dict = {}
    open_ = {(low, high): (0, set(ranks))}  # range: (numbers below it, ranks in it)
    while open_:
        found |= {r: lo for (lo, hi), (_, own) in open_.items() if lo == hi for r in own}
        open_ = {k: v for k, v in open_.items() if k[0] != k[1]}
        if not open_:
            break
        parts = [((lo, hi), F.least(F.floor((F.col("x") / 2 - lo / 2) / (hi / 2 - lo / 2) * PARTS), F.lit(PARTS - 1))) for lo, hi in open_]
        inside = [F.when(F.col("x").between(lo, hi), F.struct(F.lit(i).alias("range"), part.alias("part"))) for i, ((lo, hi), part) in enumerate(parts)]
        got = x.select("x", F.coalesce(*inside).alias("p")).where("p IS NOT NULL").groupBy("p").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("p").collect()
        following: dict = {}
        for i, (base, own) in enumerate(open_.values()):
            for row in (r for r in got if r.p.range == i):
                held = {r for r in own if base <= r < base + row.n}
                if held:
                    following[row.lo, row.hi] = (base, held)
                base += row.n
        open_ = following
    return found


def ranked(x: DataFrame, asked: list, aggregates: dict) -> DataFrame:
    """One row: count, other aggregates, and the quantiles that are asked for, by nearest rank; the median is the mean of the middle pair."""
    first = x.agg(F.count("x").alias("count"), F.min("x").alias("_low"), F.max("x").alias("_high"), *(f("x").alias(n) for n, f in aggregates.items())).first()
    n = first["count"]
    ends = {q: ((n - 1) // 2, n // 2) if q == 0.5 else (max(0, math.ceil(round(q * n, 9)) - 1),) * 2 for q in asked}
    got = at_ranks(x, {r for pair in ends.values() for r in pair}, first["_low"], first["_high"]) if n else {}
    values = [n, *(first[a] for a in aggregates), *(None if not n else got[a] if a == b else (got[a] + got[b]) / 2 for a, b in (ends[q] for q in asked))]
    names = ["count", *aggregates, *("p" + f"{100 * q:.10g}" for q in asked)]
    kind = "`count` long, " + ", ".join(f"`{c}` double" for c in names[1:])
    return x.sparkSession.createDataFrame([tuple(values)], kind)


def quantiles(rows: Rows, op: Op) -> Rows:
    asked = [float(a.value) for a in op.args if isinstance(a, Lit)] or [0.5, 0.9, 0.99]
    x = numbers(rows, Op(op.name, tuple(a for a in op.args if isinstance(a, Path)), op.options))
    return rows.to(ranked(x, asked, {}))


def sketch(rows: Rows, op: Op) -> Rows:
    return rows.to(ranked(numbers(rows, op), [0.5, 0.9, 0.99], {"min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_pop}))


def group_by(rows: Rows, op: Op) -> Rows:
    """Groups by one or more keys. Arrays on a key's path give a group for each element, each with the row's values."""
    keys, agg, value = [], option(op, "agg"), op.options.get("value")
    for a in op.args:
        e = a.expr if isinstance(a, Named) else a
        if isinstance(e, Call) and e.name in AGGREGATES:
            agg, value = e.name, (e.args[0] if e.args else None)
        else:
            keys.append(a)
    if isinstance(agg, Call):
        agg, value = agg.name, (agg.args[0] if agg.args else value)
    agg = agg if agg in AGGREGATES else "count"
    if rows.dialect.name == "samples" and agg != "sum":
        agg, value = "count", None
    scope, df, names = rows.scope, rows.df, []
    single = len(keys) == 1 and rows.dialect.name != "heap"
    if value is None and agg != "count":
        value = Path(("value",))
    vc, vt = scope.value(value) if value is not None else (F.lit(None), T.NullType())
    columns = [vc.alias("_v")]
    for k in keys:
        e, name = (k.expr, k.name) if isinstance(k, Named) else (k, None)
        kc, kt = scope.value(e)
        names.append(name or ("key" if single else str(e.parts[-1]) if isinstance(e, Path) else "key"))
        if rows.dialect.name == "samples":
            kc = F.coalesce(C.as_text(kc, kt), F.lit("<null>"))
        columns.append((F.explode(kc) if isinstance(kt, T.ArrayType) else kc).alias(names[-1]))
    df = df.select(*columns[:1], *columns[1:])
    if rows.first and rows.dialect.name == "events":
        df = df.where(C.all_of([C.named(n).isNotNull() for n in names]))
    if isinstance(vt, T.ArrayType):  # every value counts once for each key of its row
        each = lambda x: C.as_double(x, vt.elementType)
        part = {
            "sum": F.sum(F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.coalesce(each(x), F.lit(0.0)))),
            "min": F.min(F.array_min(F.transform("_v", each))),
            "max": F.max(F.array_max(F.transform("_v", each))),
            "avg": F.sum(F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.coalesce(each(x), F.lit(0.0)))) / F.nullif(F.sum(F.size(F.filter("_v", lambda x: each(x).isNotNull()))), F.lit(0)),
            "count": F.count("*"),
        }[agg]
    else:
        x = C.as_double(F.col("_v"), vt)
        x = F.when(~F.isnan(x), x) if rows.dialect.name == "heap" else x
        part = F.count("*") if agg == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[agg](x)
    if agg in ("sum", "avg"):
        part = F.coalesce(part, F.lit(0.0))
    label = agg
    if rows.dialect.name == "samples":
        label = "count" if agg == "count" else f"sum_{value.text}"
    elif rows.dialect.name == "heap" and isinstance(value, Path) and memory_field(rows.dialect.aliases.get(value.text, value.text)):
        label = value.text
    out = df.groupBy(*map(C.named, names)).agg(part.alias(label))
    by = option(op, "sortBy")
    if rows.dialect.name == "samples" or by:
        up = bool(option(op, "asc", False))
        first = Key(C.named(names[0] if by == "key" else label), not up, not up if rows.dialect.name == "heap" else None)
        return rows.to(out, (first, *(Key(C.named(n)) for n in names)), sorted=True)
    return rows.to(out, tuple(Key(C.named(n)) for n in names))


# order
def sort_key(rows: Rows, e, descending: bool) -> Key:
    c, t = rows.scope.value(e)
    if isinstance(c, Column) and isinstance(t, T.NullType) and rows.dialect.name == "events":
        raise QueryError(f"no field {e.text} to sort by")
    if rows.dialect.name == "samples":
        c = F.coalesce(C.as_double(c, t), F.lit(0.0))
    return Key(c, descending, descending if rows.dialect.name == "heap" else None)


def sort_by(rows: Rows, op: Op) -> Rows:
    down = rows.dialect.descending
    if "asc" in op.options:
        down = not option(op, "asc")
    if "desc" in op.options:
        down = bool(option(op, "desc"))
    fields = [a for a in op.args if isinstance(a, Path) and a.text not in ("asc", "desc")]
    for a in op.args:
        if isinstance(a, Path) and a.text in ("asc", "desc"):
            down = a.text == "desc"
    if "by" in op.options:
        fields.append(op.options["by"])
    keys = tuple(sort_key(rows, f, down) for f in (fields or [Path(("value",)) if rows.values else Path((rows.names[0],))]))
    return replace(rows, order=(*keys, *rows.order), sorted=True, first=False)


def top(rows: Rows, op: Op) -> Rows:
    n = next((int(a.value) for a in op.args if isinstance(a, Lit)), int(option(op, "n", 10)))
    by = op.options.get("by") or next((a for a in op.args if isinstance(a, Path) and a.text not in ("asc", "desc")), None)
    if by is None and rows.dialect.name == "heap":
        return head(rows, Op("head", (Lit(n),)))
    if by is None:
        numeric = [f.name for f in rows.df.schema.fields if C.is_number(f.dataType) and f.name not in HIDDEN]
        by = Path(("value",)) if "value" in rows.names else Path((numeric[0] if numeric else rows.names[0],))
    up = bool(option(op, "asc", False)) or any(isinstance(a, Path) and a.text == "asc" for a in op.args)
    order = (sort_key(rows, by, not up), *rows.order)
    rows = replace(rows, order=order, sorted=True)
    return rows.keep(rows.df.orderBy(*map(Key.sort, rows.ordering())).limit(n))


def head(rows: Rows, op: Op) -> Rows:
    n = int(option(op, "n", 10, 0))
    order = rows.ordering()
    return rows.keep(rows.df.orderBy(*map(Key.sort, order)).limit(n) if order else rows.df.limit(n))


def tail(rows: Rows, op: Op) -> Rows:
    n = int(option(op, "n", 10, 0))
    if not rows.ordering():
        raise QueryError("tail needs an order")
    # the last n are the first n of the order turned round; then the order is as it was
    last = rows.df.orderBy(*(k.sort(turned=True) for k in rows.ordering())).limit(n)
    return rows.keep(last.orderBy(*map(Key.sort, rows.ordering())))


def distinct(rows: Rows, op: Op) -> Rows:
    e = target(rows, op)
    if rows.dialect.name == "samples":
        c, t = rows.scope.value(e)
        return rows.to(rows.df.select(F.coalesce(C.as_text(c, t), F.lit("")).alias(e.text)).distinct())
    c, t = rows.scope.value(e)
    if not rows.ordering():
        return rows.keep(rows.df.withColumn("_key", C.as_text(c, t)).dropDuplicates(["_key"]).drop("_key"))
    if not rows.order:  # the first by arrival, with map-side combine
        first = rows.df.select(C.as_text(c, t).alias("_key"), F.struct(*rows.df.columns).alias("_row"), F.struct(*rows.hidden).alias("_at")).groupBy("_key").agg(F.min_by("_row", "_at").alias("_row"))
        return rows.keep(first.select("_row.*"))
    first = F.row_number().over(Window.partitionBy(C.as_text(c, t)).orderBy(*map(Key.sort, rows.ordering())))
    return rows.keep(rows.df.withColumn("_n", first).where("_n = 1").drop("_n"))


def where(rows: Rows, op: Op) -> Rows:
    return rows.keep(rows.df.where(C.all_of([rows.scope.condition(a) for a in op.args])))


def select(rows: Rows, op: Op) -> Rows:
    out = []
    for a in op.args:
        e, name = (a.expr, a.name) if isinstance(a, Named) else (a, None)
        if name is None and not isinstance(e, Path):
            raise QueryError("an expression needs a name: expr as name")
        c, _ = rows.scope.value(e)
        out.append(c.alias(name or (e.text if rows.dialect.name == "samples" else str(e.parts[-1]))))
    return rows.to(rows.df.select(*rows.hidden, *out))


def to_map(rows: Rows, op: Op) -> Rows:
    """One row with a map of key to value as strings' keys; null keys are skipped and the last of a key counts."""
    k, v = (rows.scope.value(a) for a in op.args[:2])
    at = F.struct(*rows.hidden) if rows.hidden else F.monotonically_increasing_id()
    df = rows.df.select(C.as_text(*k).alias("k"), v[0].alias("v"), at.alias("o")).where("k IS NOT NULL")
    last = df.groupBy("k").agg(F.max_by("v", "o").alias("v"))
    return rows.to(last.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("map")))


def timerange(rows: Rows, op: Op) -> Rows:
    e = op.options.get("path") or next((a for a in op.args if isinstance(a, Path)), Path(("startTime",)))
    x = rows.scope.value(e)[0].cast("long")
    d = op.options.get("duration")
    end = x + F.coalesce(rows.scope.value(d)[0].cast("long"), F.lit(0).cast("long")) if d is not None else x
    a = rows.df.select(x.alias("a"), end.alias("b")).where("a IS NOT NULL").agg(F.count("a").alias("count"), F.min("a").alias("lo"), F.greatest(F.max("b"), F.min("a")).alias("hi"))
    if not rows.first:
        return rows.to(a.select("count", F.lit(e.text).alias("field"), F.col("lo").alias("minTicks"), F.col("hi").alias("maxTicks"), (F.col("hi") - F.col("lo")).alias("durationTicks"), F.lit("times are taken as they are in rows").alias("note")))
    pattern, span = option(op, "format"), F.col("hi") - F.col("lo")
    return rows.to(a.select("count", F.lit(e.text).alias("field"), F.col("lo").alias("minEpochNanos"), F.col("hi").alias("maxEpochNanos"), C.datetime_text(F.col("lo"), pattern).alias("minTime"), C.datetime_text(F.col("hi"), pattern).alias("maxTime"), span.alias("durationNanos"), (span / 1_000_000.0).alias("durationMs"), C.duration_text(span).alias("duration")))


# transforms
def transform(rows: Rows, op: Op) -> Rows:
    """len, case, rounding, contains, replace and times: first in a pipe they give `value`, later they change a field in place."""
    name, path = op.name, target(rows, op)
    c, t = rows.scope.value(path)
    s, texts = C.as_text(c, t), [a.value for a in op.args if isinstance(a, Lit)]
    x, heap = C.as_double(c, t), rows.dialect.name == "heap"
    alone = (rows.first or rows.values) and not heap
    whole = isinstance(t, T.IntegralType)
    if name == "len":
        y = rows.scope.length(path)
        if alone:
            return rows.to(rows.df.select(*rows.hidden, y.alias("len")).where("len IS NOT NULL"), rows.order)
        return rows.keep(rows.df.withColumn("len" if not heap else rows.dialect.aliases.get(path.text, path.text), F.coalesce(y, F.lit(0).cast("long"))))
    if name == "contains" and not alone:
        return rows.keep(rows.df.where(F.coalesce(s.contains(texts[0]), F.lit(False))))
    long = lambda v: v.cast("long")
    y = {
        "uppercase": lambda: F.upper(s), "lowercase": lambda: F.lower(s), "trim": lambda: F.trim(s),
        "contains": lambda: s.contains(texts[0]), "replace": lambda: F.replace(s, F.lit(texts[0]), F.lit(texts[1])),
        "abs": lambda: F.abs(c) if alone and whole else F.abs(x),
        "round": lambda: long(C.half_up(x)) if alone or heap else C.half_up(x).cast("double"),
        "floor": lambda: long(F.floor(x)) if heap else F.floor(x).cast("double"), "ceil": lambda: long(F.ceil(x)) if heap else F.ceil(x).cast("double"),
        "asDateTime": lambda: C.datetime_text(c, texts[0] if texts else None), "formatDuration": lambda: C.duration_text(c), "truncate": lambda: C.truncated(c, texts[0]),
    }[name]()
    if alone:
        return rows.to(rows.df.select(*rows.hidden, y.alias("value")).where("value IS NOT NULL"), rows.order, values=True)
    return rows.keep(rows.df.withColumn(rows.dialect.aliases.get(path.text, path.text), y))


# joins and stacks
def decorated(rows: Rows, op: Op) -> Rows:
    other = rows.context["scan"](op.args[0].text if isinstance(op.args[0], Path) else op.args[0].value)
    fields = [f.text if isinstance(f, Path) else f.value for f in op.options.get("fields", [])]
    path = lambda name, default: op.options.get(name, Path(default))
    own, their = rows.scope, Scope(other.schema, rows.dialect)
    if op.name == "decorateByKey":
        k, d = path("key", ()), path("decoratorKey", ())
        return rows.keep(decorate.by_key(rows.df, other, C.as_text(*own.value(k)), C.as_text(*their.value(d)), fields))
    k, d = path("threadPath", ("eventThread", "javaThreadId")), path("decoratorThreadPath", ("eventThread", "javaThreadId"))
    span = lambda s: (s.value(Path(("startTime",)))[0].cast("long"), F.coalesce(s.value(Path(("duration",)))[0].cast("long"), F.lit(0).cast("long")))
    return rows.keep(decorate.by_time(rows.df, other, C.as_text(*own.value(k)), C.as_text(*their.value(d)), span(own), span(their), fields))


def frames_of(rows: Rows, op: Op) -> Column:
    e = op.options.get("path") or Path(("stackTrace",))
    c, t = rows.scope.value(e)
    if isinstance(t, T.StructType) and "frames" in t.fieldNames():
        c, t = c.getField("frames"), t["frames"].dataType
    return stacks.frame_names(c, t)


def flamegraph(rows: Rows, op: Op) -> Rows:
    direction = option(op, "direction", "bottom-up")
    return rows.to(stacks.flame_nodes(rows.df.select(frames_of(rows, op).alias("frames")), direction != "bottom-up"), (Key(F.col("path")),))


def stackprofile(rows: Rows, op: Op) -> Rows:
    if rows.dialect.name == "samples":
        e = next((a for a in op.args if isinstance(a, Path)), None)
        types = rows.context.get("value_types", [])
        value = e.text if e is not None else types[0] if types else None
        c = F.lit(1).cast("long") if value is None else C.named(value)
        return rows.to(stacks.folded(rows.df.select(frames_of(rows, op).alias("frames"), c.alias("v")), "count" if value is None else value), (Key(C.named("count" if value is None else value), True), Key(F.col("stack"))), sorted=True)
    thread = F.coalesce(*(C.as_text(*rows.scope.value(Path(p))) for p in stacks.THREAD_PATHS), F.lit("<unknown>"))
    time = rows.scope.value(Path(("startTime",)))[0].cast("long")
    df = rows.df.select(frames_of(rows, op).alias("frames"), time.alias("t"), thread.alias("thread"))
    out = stacks.profile(df, option(op, "direction", "top-down") == "top-down", int(option(op, "buckets", 10)), float(option(op, "minPct", 1)))
    return rows.to(out, (Key(F.col("order")),), sorted=True)


def callgraph(rows: Rows, op: Op) -> Rows:
    return rows.to(stacks.call_edges(rows.df.select(frames_of(rows, op).alias("frames"))), (Key(F.col("count"), True), Key(F.col("caller")), Key(F.col("callee"))), sorted=True)


OPERATORS = {
    "count": count, "sum": sum_, "stats": stats, "quantiles": quantiles, "sketch": sketch, "groupBy": group_by, "sortBy": sort_by, "top": top, "head": head, "tail": tail, "distinct": distinct,
    "filter": where, "select": select, "toMap": to_map, "timerange": timerange, "decorateByTime": decorated, "decorateByKey": decorated, "flamegraph": flamegraph, "stackprofile": stackprofile, "callgraph": callgraph,
    **dict.fromkeys(("len", "uppercase", "lowercase", "trim", "abs", "round", "floor", "ceil", "contains", "replace", "asDateTime", "formatDuration", "truncate"), transform),
}


def apply(rows: Rows, ops: tuple, more: dict | None = None) -> Rows:
    """The operators in turn. more: operators of a root besides those that all share."""
    table = OPERATORS | (more or {})
    for op in ops:
        if op.name not in table:
            raise QueryError(f"unknown operator {op.name}; operators are {', '.join(sorted(table))}")
        rows = table[op.name](rows, op)
    return rows


def compile_query(query: Query, rows: Rows, more: dict | None = None) -> Rows:
    rows = filtered(rows, query.filters)
    if query.path:
        rows = projected(rows, query.path)
    return apply(rows, query.ops, more)


def mentions(query: Query, names: set) -> bool:
    """Whether a query names any of the fields anywhere."""

    def look(e) -> bool:
        if isinstance(e, Path):
            return bool(names & set(map(str, e.parts)))
        if isinstance(e, (Compare, Logic, Call, Named, Op, Query)) or hasattr(e, "__dataclass_fields__"):
            return any(look(getattr(e, f)) for f in e.__dataclass_fields__)
        if isinstance(e, dict):
            return any(map(look, e.values()))
        return any(map(look, e)) if isinstance(e, (list, tuple)) else False

    return reduce(lambda a, b: a or b, map(look, (query.filters, query.path, query.ops)), False)
