"""A session: named recordings (tables of events), heaps and sample profiles, their variables, and queries over them."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import heap as heaps
from .plans import compiler
from .plans.expressions import EVENTS, HEAP, SAMPLES
from .plans.parser import ROOTS, QueryError, parse

ORD = compiler.ORD


class Session:
    """Tables by name. Event types and the roots of queries resolve here; every query is one DataFrame plan."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.events: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}  # metadata, chunks, cp
        self.heap: heaps.Heap | None = None
        self.samples: DataFrame | None = None
        self.value_types: list[str] = []
        self.variables: dict[str, object] = {}

    # tables
    def add_events(self, name: str, df: DataFrame, order=None) -> Session:
        """An event type. order: a column that gives the order of arrival; without one, rows are numbered as they are read."""
        self.events[name] = df.withColumn(ORD, (order if order is not None else F.monotonically_increasing_id()).cast("long")) if ORD not in df.columns else df
        return self

    def add_heap(self, heap: heaps.Heap) -> Session:
        self.heap = heap
        return self

    def add_samples(self, df: DataFrame, value_types: list[str]) -> Session:
        self.samples, self.value_types = df, value_types
        return self

    def event_type(self, name: str) -> DataFrame:
        if name in self.events:
            if callable(self.events[name]):  # opened when first asked for
                self.events[name] = self.events[name]()
            return self.events[name]
        near = sorted((n for n in self.events if n.lower().startswith(name.lower())), key=len) or sorted((n for n in self.events if distance(n.lower(), name.lower()) <= 3), key=lambda n: distance(n.lower(), name.lower()))
        raise QueryError(f"no event type {name}" + (f"; did you mean {near[0]}?" if near else ""))

    def scan(self, name: str) -> DataFrame:
        return self.event_type(name)

    def types(self, pattern: str | None = None, regex: bool = False) -> list[str]:
        """Names of event types, by substring or regular expression."""
        keep = (lambda n: True) if not pattern else (lambda n: re.search(pattern, n)) if regex else (lambda n: pattern.lower() in n.lower())
        return sorted(n for n in self.events if keep(n))

    def all_types(self, kind: str | None = None) -> DataFrame:
        """(name, kind) of the classes that metadata tells of: event, primitive or other; `kind` keeps one."""
        if "metadata" not in self.tables:
            raise NotImplementedError("this recording has no metadata")
        basic = F.col("name").isin("boolean", "byte", "char", "short", "int", "long", "float", "double", "java.lang.String")
        out = self.tables["metadata"].select("name", F.when(F.col("superType") == "jdk.jfr.Event", "event").when(basic, "primitive").otherwise("other").alias("kind")).distinct().orderBy("name")
        return out.where(F.col("kind") == kind) if kind else out

    def type_counts(self) -> DataFrame:
        """(type, count) of all event types, each counted on its own scan."""
        if not self.events:
            return self.spark.createDataFrame([], "type string, count long")
        parts = [self.event_type(n).agg(F.count("*").alias("count")).select(F.lit(n).alias("type"), "count") for n in sorted(self.events)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    # queries
    def rows(self, text: str) -> compiler.Rows:
        m = re.match(r"\s*(\w+)", text)
        root = m[1] if m else ""
        if root not in ROOTS:
            raise QueryError(f"unknown root {root!r}; roots are {', '.join(sorted(ROOTS))}")
        query = parse(text, flat=root == "samples")
        context = {"scan": self.scan, "session": self, "value_types": self.value_types}
        if query.root == "events":
            if not query.types:
                raise QueryError("events needs a type")
            df = self.event_type(query.types[0])
            if len(query.types) > 1:  # rows of several types may share a place in the order of arrival
                parts = [self.event_type(name).withColumn(compiler.TYPE, F.lit(i)) for i, name in enumerate(query.types)]
                df = parts[0]
                for more in parts[1:]:
                    df = df.unionByName(more, allowMissingColumns=True)
            return compiler.compile_query(query, compiler.Rows(df, EVENTS, context=context))
        if query.root in ("metadata", "chunks", "cp"):
            if query.root not in self.tables:
                raise NotImplementedError(f"this recording has no {query.root}")
            df = self.tables[query.root]
            if query.types:
                key = {"metadata": "name", "chunks": "index", "cp": "type"}[query.root]
                df = df.where(F.col(f"`{key}`").cast("string") == query.types[0])
                if query.root == "metadata" and query.path and query.path[0].key == "fields":
                    return compiler.compile_query(replace(query, path=()), compiler.Rows(self.field_rows(df, query.path[1:]), EVENTS, context=context))
            elif query.root == "cp":
                df = df.groupBy("type").agg(F.count("*").alias("entries"), F.countDistinct("chunk").alias("chunks"))
            return compiler.compile_query(query, compiler.Rows(df, EVENTS, context=context), {"crossref": lambda rows, op: rows.to(self.crossref(query.types))})
        if query.root == "samples":
            if self.samples is None:
                raise QueryError("no samples are open")
            self.samples = self.samples() if callable(self.samples) else self.samples
            return compiler.compile_query(query, compiler.Rows(self.samples, SAMPLES, context=context))
        if self.heap is None:
            raise QueryError("no heap is open")
        return compiler.compile_query(query, compiler.Rows(heaps.root_rows(self.heap, query), HEAP, context=context | {"root": query.root}), heaps.operators(self))

    @staticmethod
    def field_rows(classes: DataFrame, path: tuple) -> DataFrame:
        """Of classes a row for each field, by name; a path names one field, and then one of its properties."""
        rows = classes.select(F.explode("fieldsByName").alias("_name", "f")).select("f.*").orderBy("name")
        if path:
            rows = rows.where(F.col("name") == str(path[0].key))
        return rows.select(F.col(str(path[1].key)).alias("value")) if len(path) > 1 else rows

    def crossref(self, types: tuple) -> DataFrame:
        """One row: how much of a constant pool events refer to, and by event type."""
        from .sources.recordings import crossref

        if not types or "references" not in self.tables:
            raise QueryError("crossref follows the constant pool of a type: cp/TYPE | crossref()")
        found = crossref(self, types[0])
        events = found["events"].agg(F.sort_array(F.collect_list(F.struct("eventType", "unique", "directRefs"))).alias("events"))
        return found["totals"].crossJoin(events)  # one row each

    def consume(self, text: str, take) -> int:
        """Gives a query's rows to a function one by one, a partition at a time on the driver; returns their number. An exception ends it."""
        n = 0
        for row in self.query(text).toLocalIterator():
            take(row)
            n += 1
        return n

    def merge(self, *names: str) -> dict:
        """The maps of some variables as one; of equal keys the last counts."""
        out: dict = {}
        for name in names:
            value = self.variables.get(name)
            if not isinstance(value, dict):
                raise QueryError(f"{name} is no map")
            out |= value
        return out

    def query(self, text: str) -> DataFrame:
        """The result of a path-and-pipe query."""
        return self.rows(self.substituted(text)).result()

    def set(self, name: str, value) -> None:
        """A variable: a scalar, a map, or a query's result, which is kept in memory until invalidate()."""
        self.variables[name] = value.cache() if isinstance(value, DataFrame) else value

    def invalidate(self, name: str) -> None:
        value = self.variables.pop(name, None)
        if isinstance(value, DataFrame):
            value.unpersist()

    def substituted(self, text: str) -> str:
        """${name}, ${name.size} and ${name[i].field} of variables; other ${...} stay."""

        def one(m):
            name, rest = re.match(r"(\w+)(.*)", m[1]).groups()
            if name not in self.variables:
                return m[0]
            v = self.variables[name]
            if isinstance(v, DataFrame):
                if rest == ".size":
                    return str(v.count())
                i, field = re.match(r"(?:\[(\d+)\])?\.?(\w*)", rest).groups()
                row = v.limit(int(i or 0) + 1).tail(1)
                return str(row[0][field] if field else row[0][0]) if row else ""
            for key in re.findall(r"\w+", rest):
                v = v.get(key) if isinstance(v, dict) else None
            return "" if v is None else str(v)

        return re.sub(r"\$\{(\w+[^}]*)\}", one, text)


def distance(a: str, b: str) -> int:
    """Edits between two names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def of_tables(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the star-schema tables of a folder; the event table is also there by type, with times, durations and threads."""
    s = Session(spark)
    keys = {"lineitem": F.col("l_orderkey") * 16 + F.col("l_linenumber"), "orders": F.col("o_orderkey"), "part": F.col("p_partkey"), "customer": F.col("c_custkey"), "supplier": F.col("s_suppkey"), "nation": F.col("n_nationkey"), "region": F.col("r_regionkey"), "events": F.col("event_id")}

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet").withColumn(ORD, keys[name].cast("long"))

    def timed() -> DataFrame:
        return s.event_type("events").withColumns({"startTime": F.unix_micros(F.col("ts").cast("timestamp")) * 1000, "duration": (F.col("value") * 1_000_000_000).cast("long"), "eventThread": F.struct(F.col("user_id").alias("javaThreadId"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("osName"))})

    # leaf first: two words, a type that recurs, a brand that some lack, and the same frame at the bottom
    stack = F.concat(F.split("p_name", " "), F.array_repeat("p_type", F.col("p_size") % 3), F.array(F.when(F.col("p_size") % 4 != 0, F.col("p_brand")), F.lit("main")))
    named = F.filter(stack, lambda x: x.isNotNull())
    s.events |= {name: lambda name=name: table(name) for name in keys}
    s.events |= {kind: lambda kind=kind: timed().where(F.col("event_type") == kind) for kind in ("click", "view", "purchase", "signup", "error")}
    s.events |= {"all_events": timed, "stacks": lambda: s.event_type("part").withColumn("stackTrace", stack), "timed_stacks": lambda: s.event_type("stacks").withColumns({"startTime": F.col("p_partkey").cast("long") * 1_000_000, "eventThread": F.struct(F.col("p_brand").alias("osName"))})}
    s.samples = lambda: s.event_type("part").select(ORD, F.col("p_size").cast("long").alias("cpu"), F.col("p_brand").alias("thread"), F.transform(named, lambda x: F.struct(x.alias("name"))).alias("stackTrace"))
    s.value_types = ["cpu"]
    return s
