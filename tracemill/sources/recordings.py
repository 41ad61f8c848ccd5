"""Flight recordings as event tables: chunks are decoded on the executors, one task a file, to one parquet table a type."""

from __future__ import annotations

import json
import struct
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import FILE
from ..session import ORD, Session

MAGIC, HEADER = b"FLR\0", struct.Struct(">4sHHqqqqqqqi")
#: How deep nested values go; types can hold themselves.
DEPTH = 6
#: First bytes of compressed files.
COMPRESSED = {b"\x1f\x8b": "gzip", b"\x28\xb5\x2f\xfd": "zstd", b"\x04\x22\x4d\x18": "lz4"}
KINDS = {"boolean": T.BooleanType(), "byte": T.ByteType(), "short": T.ShortType(), "char": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "java.lang.String": T.StringType()}


@dataclass
class Field:
    name: str
    kind: int
    pooled: bool
    array: bool
    ticks: str = ""


@dataclass
class Class:
    id: int
    name: str
    above: str = ""
    fields: list = field(default_factory=list)
    annotations: list = field(default_factory=list)
    settings: list = field(default_factory=list)


class Reader:
    """Values from bytes; compact integers are little-endian base 128 with nine bytes at most, others big-endian."""

    def __init__(self, data: bytes, at: int, compact: bool):
        self.data, self.at, self.compact = data, at, compact

    def take(self, form: str):
        s = struct.Struct(form)
        out = s.unpack_from(self.data, self.at)[0]
        self.at += s.size
        return out

    def varint(self) -> int:
        value = shift = 0
        for i in range(9):
            b = self.data[self.at]
            self.at += 1
            if i == 8:
                return value | b << 56
            value |= (b & 127) << shift
            if b < 128:
                break
            shift += 7
        return value

    def integer(self, bits: int) -> int:
        if not self.compact:
            return self.take({16: ">h", 32: ">i", 64: ">q"}[bits])
        v = self.varint() & ((1 << bits) - 1)
        return v - (1 << bits) if v >> (bits - 1) else v

    def string(self):
        """A string, None, or an int that names an entry of the string pool."""
        tag = self.take(">B")
        if tag == 0:
            return None
        if tag == 1:
            return ""
        if tag == 2:
            return self.integer(64)
        size = self.integer(32)
        if tag == 4:
            return "".join(chr(self.varint() if self.compact else self.take(">H")) for _ in range(size))
        out = self.data[self.at : self.at + size]
        self.at += size
        return out.decode("utf-8" if tag == 3 else "latin-1", "replace")


class Chunk:
    """One chunk: its header, its classes, its constant pools and its events."""

    def __init__(self, data: bytes, at: int):
        magic, self.major, self.minor, self.size, pools, metadata, self.start, self.duration, self.ticks, self.frequency, flags = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            kind = next((n for m, n in COMPRESSED.items() if data[at:].startswith(m)), None)
            raise ValueError(f"the recording is {kind}-compressed; decompress it first" if kind else f"no chunk at byte {at}")
        self.data, self.at, self.compact = data, at, bool(flags & 1)
        self.classes: dict = {}
        self.pools: dict = {}
        self.read_metadata(at + metadata)
        while pools:
            pools = self.read_pools(at + pools, pools)

    def reader(self, at: int) -> Reader:
        return Reader(self.data, at, self.compact)

    def read_metadata(self, at: int):
        r = self.reader(at)
        r.integer(32)
        for bits in (64, 64, 64, 64):  # type, start, duration, id
            r.integer(bits)
        strings = [r.string() for _ in range(r.integer(32))]

        def element() -> tuple:
            name = strings[r.integer(32)]
            attributes = {}
            for _ in range(r.integer(32)):
                k = strings[r.integer(32)]
                attributes[k] = strings[r.integer(32)]
            return name, attributes, [element() for _ in range(r.integer(32))]

        raw = [c for name, _, kids in [element()] for m in kids if m[0] == "metadata" for c in m[2] if c[0] == "class"]
        names = {int(a["id"]): a["name"] for _, a, _ in raw}
        for _, a, kids in raw:
            c = Class(int(a["id"]), a["name"], a.get("superType", ""))
            for kind, b, below in kids:
                if kind == "field":
                    f = Field(b["name"], int(b["class"]), b.get("constantPool") == "true", b.get("dimension", "0") != "0")
                    for note, x, _ in below:
                        of = names.get(int(x.get("class", -1)), "")
                        if note == "annotation" and "TICKS" in x.values() and of in ("jdk.jfr.Timestamp", "jdk.jfr.Timespan"):
                            f.ticks = of.rsplit(".", 1)[1]
                    c.fields.append(f)
                elif kind == "annotation":
                    c.annotations.append(names.get(int(b.get("class", -1)), ""))
                elif kind == "setting":
                    c.settings.append(b.get("name", ""))
            self.classes[c.id] = c

    def read_pools(self, at: int, place: int) -> int:
        """Reads one checkpoint; returns the place of the one before, 0 if there is none."""
        r = self.reader(at)
        r.integer(32)
        for _ in range(3):
            r.integer(64)
        delta = r.integer(64)
        r.take(">B")
        for _ in range(r.integer(32)):
            kind = r.integer(64)
            pool = self.pools.setdefault(kind, {})
            for _ in range(r.integer(32)):
                key = r.integer(64)
                pool.setdefault(key, self.value(r, kind, raw=True))
        return place + delta if delta else 0

    def value(self, r: Reader, kind: int, raw: bool = False):
        """A value as it stands; references to pools stay (class, key) pairs."""
        name = self.classes[kind].name if kind in self.classes else ""
        if name in KINDS:
            if name == "boolean":
                return bool(r.take(">B"))
            if name == "byte":
                return r.take(">b")
            if name in ("float", "double"):
                return r.take(">f" if name == "float" else ">d")
            if name == "char":
                return chr(r.varint() if r.compact else r.take(">H"))
            if name == "java.lang.String":
                s = r.string()
                return ("pool", kind, s) if isinstance(s, int) else s
            return r.integer({"short": 16, "int": 32, "long": 64}[name])
        return {f.name: self.field(r, f) for f in self.classes[kind].fields}

    def field(self, r: Reader, f: Field):
        one = (lambda: ("pool", f.kind, r.integer(64))) if f.pooled else (lambda: self.value(r, f.kind))
        if f.array:
            return [one() for _ in range(r.integer(32))]
        v = one()
        if f.ticks and isinstance(v, int) and self.frequency:
            span = v if f.ticks == "Timespan" else v - self.ticks
            v = span * 1_000_000_000 // self.frequency + (0 if f.ticks == "Timespan" else self.start)
        return v

    def resolved(self, v, depth: int = 0):
        """The value with pool entries in place, DEPTH deep."""
        if isinstance(v, tuple):
            if depth >= DEPTH:
                return None
            return self.resolved(self.pools.get(v[1], {}).get(v[2]), depth)
        if isinstance(v, dict):
            return {k: self.resolved(x, depth + 1) for k, x in v.items()} if depth < DEPTH else None
        return [self.resolved(x, depth) for x in v] if isinstance(v, list) else v

    def events(self):
        """(class name, values, place, references (pool class, key)) of each event."""
        at, end = self.at + HEADER.size, self.at + self.size
        while at < end:
            r = self.reader(at)
            size = r.integer(32)
            if size <= 0:
                break
            kind = r.integer(64)
            if kind > 1 and kind in self.classes:
                raw = {f.name: self.field(r, f) for f in self.classes[kind].fields}
                direct = [x[1:] for v in raw.values() for x in (v if isinstance(v, list) else [v]) if isinstance(x, tuple)]
                yield self.classes[kind].name, self.resolved(raw), at, direct
            at += size

    def schema(self, name: str, depth: int = 0) -> T.StructType:
        c = next(x for x in self.classes.values() if x.name == name)
        out = []
        for f in c.fields:
            other = self.classes[f.kind].name if f.kind in self.classes else ""
            t = KINDS.get(other) or (self.schema(other, depth + 1) if depth < DEPTH else None)
            if t is not None and not (isinstance(t, T.StructType) and not t.fields):
                out.append(T.StructField(f.name, T.ArrayType(t) if f.array else t))
        return T.StructType(out)


def chunks_of(data: bytes):
    at = 0
    while at < len(data):
        c = Chunk(data, at)
        yield c
        at += c.size


ROWS = "kind string, type string, ord long, payload string, file string"


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Rows of recordings: events, and the chunks, classes and pool entries that describe them, payloads as JSON."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = lambda out: pd.DataFrame(out, columns=["kind", "type", "ord", "payload"]).assign(file=path)  # noqa: B023, E731
                for n, c in enumerate(chunks_of(bytes(content))):
                    out = [("chunk", "", n, json.dumps({"index": n, "offset": c.at, "size": c.size, "startNanos": c.start, "duration": c.duration, "startTicks": c.ticks, "frequency": c.frequency, "compressed": c.compact}))]
                    for k in c.classes.values():
                        fields = {f.name: {"name": f.name, "type": c.classes[f.kind].name if f.kind in c.classes else "", "dimension": int(f.array), "hasConstantPool": f.pooled, "annotations": []} for f in k.fields}
                        out.append(("class", k.name, n, json.dumps({"id": k.id, "name": k.name, "superType": k.above, "classAnnotations": k.annotations, "settings": k.settings, "fields": sorted(fields), "fieldsByName": fields, "fieldCount": len(fields), "schema": c.schema(k.name).json() if k.above == "jdk.jfr.Event" else None})))
                    for kind, pool in c.pools.items():
                        out += [("constant", c.classes[kind].name if kind in c.classes else str(kind), n, json.dumps({"id": key, "value": json.dumps(c.resolved(v), default=str)})) for key, v in pool.items()]
                    references: Counter = Counter()
                    for name, values, at, direct in c.events():
                        references.update((name, k, key) for k, key in direct)
                        out.append(("event", name, (n << 40) | (at - c.at), json.dumps(values)))
                        if len(out) >= 20_000:
                            yield rows(out)
                            out = []
                    out += [("reference", name, n, json.dumps({"pool": c.classes[k].name if k in c.classes else str(k), "id": key, "n": times})) for (name, k, key), times in references.items()]
                    yield rows(out)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


CLASS = "id long, name string, superType string, classAnnotations array<string>, settings array<string>, fields array<string>, fieldsByName map<string, struct<name: string, type: string, dimension: int, hasConstantPool: boolean, annotations: array<string>>>, fieldCount int, schema string"
CHUNK = "index int, offset long, size long, startNanos long, duration long, startTicks long, frequency long, compressed boolean"


def merged(schemas: list) -> T.StructType:
    """One schema of several forms of a type: all fields, in order of appearance; structs are merged in turn, and fields of different kinds are strings."""

    def both(a, b):
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            return merged([a, b])
        if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            return T.ArrayType(both(a.elementType, b.elementType))
        return a if a == b else T.StringType()

    out: dict = {}
    for schema in schemas:
        for f in schema.fields:
            out[f.name] = both(out[f.name], f.dataType) if f.name in out else f.dataType
    return T.StructType([T.StructField(n, t) for n, t in out.items()])


def open_recording(spark: SparkSession, path: str, out: str) -> Session:
    """Decodes recordings once to `out`, partitioned by kind and type, and opens a session over them: a query reads its types alone."""
    decoded(spark, path).write.partitionBy("kind", "type").parquet(out)
    rows = spark.read.schema("ord long, payload string, file string, kind string, type string").parquet(out)
    of = lambda kind: rows.where(F.col("kind") == kind)
    session = Session(spark)
    every = of("class").select(F.from_json("payload", CLASS).alias("c")).select("c.*")
    schemas = every.where("schema IS NOT NULL").select("name", "schema").distinct().orderBy("name", "schema").collect()  # a row for each type and form of it
    meta = every.groupBy("name").agg(F.max_by(F.struct(*every.columns), F.struct("fieldCount", "schema")).alias("c")).select("c.*")
    for name, forms in groupby(schemas, key=lambda r: r.name):
        schema = merged([T.StructType.fromJson(json.loads(r.schema)) for r in forms])
        events = of("event").where(F.col("type") == name).select(F.col("file").alias(FILE), F.col("ord").alias(ORD), F.from_json("payload", schema).alias("e")).select(FILE, ORD, "e.*")
        session.add_events(name, events)
    session.tables["metadata"] = meta.drop("schema")
    session.tables["chunks"] = of("chunk").select(F.from_json("payload", CHUNK).alias("c")).select("c.*")
    session.tables["references"] = of("reference").select(F.col("type").alias("eventType"), F.col("ord").alias("chunk"), F.from_json("payload", "pool string, id long, n long").alias("r")).select("eventType", "chunk", "r.*")
    session.tables["cp"] = of("constant").select("type", F.col("ord").alias("chunk"), F.from_json("payload", "id long, value string").alias("c")).select("type", "chunk", "c.*")
    return session


def chunk_summary(session: Session) -> DataFrame:
    c = session.tables["chunks"]
    return c.agg(F.count("*").alias("totalChunks"), F.sum("size").alias("totalSize"), F.expr("sum(size) div count(*)").alias("avgSize"), F.min("size").alias("minSize"), F.max("size").alias("maxSize"), F.sum(F.col("compressed").cast("int")).alias("compressedCount"))


def crossref(session: Session, pool: str) -> dict:
    """How many entries of a constant pool events refer to, and by event type: events' references and distinct entries."""
    entries = session.tables["cp"].where(F.col("type") == pool).select("chunk", "id").distinct()
    refs = session.tables["references"].where(F.col("pool") == pool)
    used = entries.join(refs.select("chunk", "id").distinct(), ["chunk", "id"], "left_semi")
    total = entries.agg(F.count("*").alias("cpTotal")).crossJoin(used.agg(F.count("*").alias("referenced")))  # one row each
    share = lambda c: F.when(F.col("cpTotal") > 0, F.round(100.0 * c / F.col("cpTotal"), 1)).otherwise(0.0)
    unused = F.col("cpTotal") - F.col("referenced")
    return {"totals": total.select("cpTotal", "referenced", unused.alias("unused"), share(F.col("referenced")).alias("usedPercent"), share(unused).alias("unusedPercent")), "events": refs.groupBy("eventType").agg(F.countDistinct("chunk", "id").alias("unique"), F.sum("n").alias("directRefs")).orderBy(F.desc("directRefs"), "eventType")}
