"""Column builders: nested paths, numeric coercion, regular expressions and epoch-nanosecond times."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANOS = 1_000_000_000


@dataclass(frozen=True)
class Key:
    """A column to sort by. Nulls come first where it rises, unless told otherwise."""

    column: Column
    down: bool = False
    nulls_first: bool | None = None

    def sort(self, turned: bool = False) -> Column:
        """The sort column, or turned round."""
        first = (not self.down if self.nulls_first is None else self.nulls_first) != turned
        return getattr(self.column, ("desc" if self.down != turned else "asc") + ("_nulls_first" if first else "_nulls_last"))()


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def unwrapped(c: Column, t: T.DataType) -> tuple:
    """A struct of one field stands for that field, however deep."""
    while isinstance(t, T.StructType) and len(t.fields) == 1:
        c, t = c.getField(t.fields[0].name), t.fields[0].dataType
    return c, t


def walk(c: Column, t: T.DataType, parts: tuple) -> tuple:
    """(column, type, many) at a path below a column; many: arrays were met on the way, and the column is the array of what they hold."""
    if not parts:
        return c, t, False
    head, rest = parts[0], parts[1:]
    if isinstance(t, T.ArrayType):
        if isinstance(head, int):
            return walk(F.get(c, F.lit(head)), t.elementType, rest)
        found: list = []

        def each(x):
            y, kind, many = walk(x, t.elementType, parts)
            found.append((kind, many))
            return y

        out = F.transform(c, each)
        kind, many = found[0]
        return (F.flatten(F.filter(out, lambda x: x.isNotNull())) if many else out), kind, True
    if isinstance(t, T.MapType):
        return walk(F.try_element_at(c, F.lit(head).cast(t.keyType)), t.valueType, rest)
    if isinstance(t, T.StructType):
        for f in t.fields:
            if f.name == str(head):
                return walk(c.getField(f.name), f.dataType, rest)
        if len(t.fields) == 1:  # a wrapper
            return walk(c.getField(t.fields[0].name), t.fields[0].dataType, parts)
    return F.lit(None), T.NullType(), False


def at_path(schema: T.StructType, parts: tuple, aliases: dict | None = None) -> tuple:
    """walk() from a row. A name with points that is no column is a path; a missing field is null."""
    head = (aliases or {}).get(parts[0], parts[0])
    names = {f.name: f.dataType for f in schema.fields}
    if head in names:
        return walk(named(head), names[head], parts[1:])
    joined = "/".join(map(str, parts))
    if joined in names:
        return named(joined), names[joined], False
    if isinstance(head, str) and "." in head:
        pieces = head.split(".")
        for i in range(len(pieces) - 1, 0, -1):
            if ".".join(pieces[:i]) in names:
                return at_path(schema, (".".join(pieces[:i]), *pieces[i:], *parts[1:]))
    return F.lit(None), T.NullType(), False


def as_double(c: Column, t: T.DataType) -> Column:
    """A number, the number that a string spells, else null."""
    c, t = unwrapped(c, t)
    if is_number(t):
        return c.cast("double")
    return c.try_cast("double") if isinstance(t, T.StringType) else F.lit(None).cast("double")


def as_text(c: Column, t: T.DataType) -> Column:
    c, t = unwrapped(c, t)
    return F.to_json(c) if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def full_match(c: Column, pattern: str) -> Column:
    return c.rlike(f"^(?:{pattern})$")


def glob_pattern(glob: str) -> str:
    """A regular expression of a glob of * and ?."""
    return "".join({"*": ".*", "?": "."}.get(x, "\\" + x if x in ".$^+()[]{}|\\" else x) for x in glob)


def duration_text(ns: Column) -> Column:
    """Nanoseconds for people: ns, us, ms and s with two decimals, then minutes and hours."""
    n = ns.cast("long")
    s = F.floor(n / NANOS)
    two = lambda unit, text: F.format_string(f"%.2f{text}", n.cast("double") / F.lit(float(unit)))
    return (
        F.when(n < 1000, F.concat(n.cast("string"), F.lit("ns")))
        .when(n < 1_000_000, two(1000, "us"))
        .when(n < NANOS, two(1_000_000, "ms"))
        .when(n < 60 * NANOS, two(NANOS, "s"))
        .when(n < 3600 * NANOS, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .when(n.isNotNull(), F.format_string("%dh %dm %ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))
    )


def datetime_text(ns: Column, pattern: str | None = None) -> Column:
    """Epoch nanoseconds as a date and time of the session's zone; ISO with up to nine decimals if no pattern is given."""
    n = ns.cast("long")
    at = F.timestamp_micros(F.floor(n / 1000))
    if pattern:
        return F.date_format(at, pattern)
    rest = F.pmod(n, F.lit(NANOS))
    digits = F.lpad(rest.cast("string"), 9, "0")
    part = F.when(rest == 0, "").when(rest % 1_000_000 == 0, F.substring(digits, 1, 3)).when(rest % 1000 == 0, F.substring(digits, 1, 6)).otherwise(digits)
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))


def truncated(ns: Column, unit: str) -> Column:
    """Epoch nanoseconds cut to the start of a second, minute, hour, day, week (Monday) or month."""
    return F.unix_micros(F.date_trunc(unit, F.timestamp_micros(F.floor(ns.cast("long") / 1000)))) * 1000


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def truthy(c: Column, t: T.DataType) -> Column:
    """Null, false, zero and the empty string are false."""
    if isinstance(t, T.BooleanType):
        out = c
    elif is_number(t):
        out = c != 0
    elif isinstance(t, T.StringType):
        out = F.length(c) > 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))


def all_of(conditions: list) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
