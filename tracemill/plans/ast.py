"""What the parser yields and the compiler takes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Path:
    """Names (str) and indexes (int) from a row down."""

    parts: tuple

    @property
    def text(self) -> str:
        return "/".join(map(str, self.parts))


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Template:
    """Alternating strings and expressions."""

    parts: tuple


@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object
    mode: str = "any"


@dataclass(frozen=True)
class Logic:
    """op: and, or, not."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Named:
    """An expression with its output name."""

    expr: object
    name: str | None


@dataclass(frozen=True)
class Segment:
    """A step of a projection: a name or index, an optional slice (from, to) and predicates relative to it."""

    key: object
    span: tuple | None = None
    filters: tuple = ()


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Query:
    root: str
    types: tuple
    filters: tuple
    path: tuple
    ops: tuple
    options: dict = field(default_factory=dict)
