"""Queries and scripts from a shell: `python -m tracemill.cli --tables DIR "events/lineitem | count()"` or `--script FILE ARG...`.

A script has a command a line: a query (with or without `show`), `set NAME = QUERY|VALUE`, `unset NAME`,
`invalidate NAME`, `vars`, `types [PATTERN]`, `metadata TYPE`, `chunks`, `cp [TYPE]`, `info`, `echo TEXT`,
and if CONDITION / elif / else / endif. $1, ${1:-default}, ${1:?message} and $@ stand for arguments.
"""

from __future__ import annotations

import argparse
import re
import sys

from .plans.parser import QueryError
from .sources import sinks


def with_arguments(line: str, args: list[str]) -> str:
    def one(m):
        i, how, rest = int(m[1]) - 1, m[2], m[3]
        if i < len(args):
            return args[i]
        if how == ":?":
            raise QueryError(rest or f"argument {i + 1} is missing")
        return rest or ""

    line = re.sub(r"\$\{(\d+)(?:(:-|:\?)([^}]*))?\}", one, line)
    line = line.replace("$@", " ".join(args))
    return re.sub(r"\$(\d+)", lambda m: args[int(m[1]) - 1] if int(m[1]) <= len(args) else "", line)


#: Tokens of conditions; a name alone is its variable.
TOKEN = re.compile(r"\s*(\|\||&&|==|!=|>=|<=|[<>!()+\-*/]|\"[^\"]*\"|'[^']*'|\d+(?:\.\d+)?|[A-Za-z_][\w.]*)")


class Condition:
    """`||`, `&&`, `!`, comparisons, arithmetic, exists(name) and empty(name), by precedence."""

    LEVELS = (("||",), ("&&",), ("==", "!=", ">=", "<=", ">", "<"), ("+", "-"), ("*", "/"))

    def __init__(self, text: str, variables: dict):
        self.tokens, self.at, self.variables = [m[1] for m in TOKEN.finditer(text)], 0, variables

    def next(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def value(self, level: int = 0):
        if level == len(self.LEVELS):
            return self.single()
        left = self.value(level + 1)
        while self.next() in self.LEVELS[level]:
            op = self.tokens[self.at]
            self.at += 1
            left = self.apply(op, left, self.value(level + 1))
        return left

    @staticmethod
    def apply(op, a, b):
        if op in ("||", "&&"):
            return bool(a) or bool(b) if op == "||" else bool(a) and bool(b)
        if op in "+-*/" and (op != "+" or not isinstance(a, str) and not isinstance(b, str)):
            a, b = float(a or 0), float(b or 0)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else float("nan")}[op]
        if op == "+":
            return str(a) + str(b)
        try:
            a, b = float(a), float(b)
        except (TypeError, ValueError):
            a, b = str(a), str(b)
        return {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]

    def single(self):
        t = self.next()
        self.at += 1
        if t == "!":
            return not self.single()
        if t == "(":
            v = self.value()
            self.at += 1
            return v
        if t == "-":
            return -float(self.single())
        if t in ("exists", "empty") and self.next() == "(":
            name = self.tokens[self.at + 1]
            self.at += 3
            v = self.variables.get(name)
            return name in self.variables if t == "exists" else v is None or v == "" or (hasattr(v, "take") and not v.take(1))
        if t is None:
            raise QueryError("a condition ends early")
        if t[0] in "\"'":
            return t[1:-1]
        if t[0].isdigit():
            return float(t)
        return {"true": True, "false": False}.get(t, self.variables.get(t))


class Shell:
    """Runs commands over a session and returns what they print."""

    def __init__(self, session, limit: int = 50):
        self.session, self.limit = session, limit

    def run(self, line: str) -> str | None:
        s = self.session
        word, _, rest = line.strip().partition(" ")
        if not word or word.startswith("#"):
            return None
        if word == "echo":
            return s.substituted(rest)
        if word == "set":
            name, _, value = rest.partition("=")
            value = value.strip()
            s.set(name.strip(), s.query(value) if re.match(r"\w+(/|\s*\||\s*\[)", value) else value.strip("\"'"))
            return None
        if word in ("unset", "invalidate"):
            s.invalidate(rest.strip())
            return None
        if word == "vars":
            return "\n".join(f"{k} = {v if not hasattr(v, 'columns') else 'rows of ' + ', '.join(v.columns)}" for k, v in sorted(s.variables.items()))
        if word == "types":
            return "\n".join(s.types(rest.strip() or None))
        if word == "info":
            return f"{len(s.events)} event types" + (", a heap" if s.heap else "") + (", samples" if s.samples is not None else "")
        if word in ("metadata", "chunks", "cp") and "|" not in rest:
            return sinks.show(s.query(word + (f"/{rest.strip()}" if rest.strip() else "")), self.limit)
        return sinks.show(s.query(rest if word == "show" else line), self.limit)

    def script(self, text: str, args: list[str]) -> list[str]:
        """Prints of a script's commands; blocks of if are nested."""
        out, stack = [], []  # of (taken, some branch was taken)
        for raw in text.splitlines():
            line = with_arguments(raw.strip(), args)
            word, _, rest = line.partition(" ")
            live = all(taken for taken, _ in stack)
            if word == "if":
                hit = live and bool(Condition(rest, self.session.variables).value())
                stack.append((hit, hit))
            elif word == "elif":
                _, done = stack.pop()
                outer = all(taken for taken, _ in stack)
                hit = outer and not done and bool(Condition(rest, self.session.variables).value())
                stack.append((hit, done or hit))
            elif word == "else":
                _, done = stack.pop()
                stack.append((not done, True))
            elif word == "endif":
                stack.pop()
            elif live and (printed := self.run(line)) is not None:
                out.append(printed)
        return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--tables", required=True)
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--script")
    p.add_argument("rest", nargs="*")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .session import of_tables

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shell = Shell(of_tables(spark, a.tables), a.limit)
    try:
        if a.script:
            with open(a.script) as f:
                print("\n".join(shell.script(f.read(), a.rest)))
        else:
            for q in a.rest:
                print(shell.run(q))
    except QueryError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
