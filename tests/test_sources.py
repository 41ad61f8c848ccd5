"""Readers against files that the tests encode; sinks; streams."""

import struct

import pytest

from tracemill.operators import analyses
from tracemill.sources import hprof, profiles, recordings, sinks
from tracemill.sources import protobuf as P
from tracemill.session import Session
from tracemill.streaming import folders

FOLDED = [([("compute", "a.go", 10), ("helper", "a.go", 20)], [1_000_000], {"thread": "main"}), ([("run", "b.go", 5), ("helper", "a.go", 20)], [2_000_000], {"thread": "main"}), ([("compute", "a.go", 10), ("run", "b.go", 5)], [500_000], {"thread": "Worker-1"})]


def test_pprof_round_trip(spark, tmp_path):
    path = str(tmp_path / "p.pb.gz")
    profiles.write_pprof(FOLDED, [("cpu", "nanoseconds")], path)
    df, types = profiles.samples(spark, path)
    s = Session(spark).add_samples(df, types)
    assert types == ["cpu"]
    assert [tuple(r) for r in s.query("samples | groupBy(thread, sum(cpu))").collect()] == [("main", 3e6), ("Worker-1", 5e5)]
    assert s.query("samples | stackprofile(cpu) | head(1)").first().stack == "helper;run"
    assert s.query("samples | select(stackTrace/0/line)").first()[0] == 10
    assert analyses.sample_hot_methods(s).first().method == "run"
    assert {r.state for r in analyses.sample_states(s).collect()} == {"RUNNING"} and "cpu" in analyses.sample_use(s)


def test_otlp(spark, tmp_path):
    names = ["", "cpu", "ns", "compute", "helper", "thread"]
    functions = P.put_varint(3 << 3 | 2) + b"\0" + P.put(3, P.put(1, 3)) + P.put(3, P.put(1, 4))
    places = P.put_varint(2 << 3 | 2) + b"\0" + P.put(2, P.put(3, P.put(1, 1) + P.put(2, 7))) + P.put(2, P.put(3, P.put(1, 2)))
    strings = b"".join(P.put(5, x) if x else P.put_varint(5 << 3 | 2) + b"\0" for x in names)
    attributes = P.put_varint(6 << 3 | 2) + b"\0" + P.put(6, P.put(1, 5) + P.put(2, P.put(1, "main")))
    stacks = P.put_varint(7 << 3 | 2) + b"\0" + P.put(7, P.put(1, [1, 2]))
    sample = P.put(1, 1) + P.put(2, [1]) + P.put(4, [42])
    profile = P.put(1, P.put(1, 1) + P.put(2, 2)) + P.put(2, sample)
    path = tmp_path / "o.pb"
    path.write_bytes(P.put(1, P.put(2, P.put(2, profile))) + P.put(2, places + functions + strings + attributes + stacks))
    df, types = profiles.samples(spark, str(path), "otlp")
    r = df.first()
    assert types == ["cpu"] and r.cpu == 42 and r.thread == "main" and [f.name for f in r.stackTrace] == ["compute", "helper"]


def hprof_bytes():
    rec = lambda tag, body: struct.pack(">BII", tag, 0, len(body)) + body
    q = lambda *v: struct.pack(f">{len(v)}q", *v)
    strings = {1: "java/lang/Object", 2: "a/Node", 3: "next", 4: "value", 5: "java/lang/String"}
    out = b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", 8, 0)
    for i, s in strings.items():
        out += rec(1, q(i) + s.encode())
    for serial, (cls, name) in enumerate(((100, 1), (101, 2), (102, 5))):
        out += rec(2, struct.pack(">I", serial) + q(cls) + struct.pack(">I", 0) + q(name))

    def class_dump(cls, above, size, fields):
        return b"\x20" + q(cls) + struct.pack(">I", 0) + q(above, 0, 0, 0, 0, 0) + struct.pack(">IHHH", size, 0, 0, len(fields)) + b"".join(q(n) + bytes([t]) for n, t in fields)

    body = class_dump(100, 0, 0, []) + class_dump(101, 100, 8, [(3, 2)]) + class_dump(102, 100, 8, [(4, 2)])
    body += b"\x21" + q(1) + struct.pack(">I", 0) + q(101) + struct.pack(">I", 8) + q(2)
    body += b"\x21" + q(2) + struct.pack(">I", 0) + q(101) + struct.pack(">I", 8) + q(3)
    body += b"\x22" + q(3) + struct.pack(">II", 0, 2) + q(100) + q(4, 0)
    body += b"\x21" + q(4) + struct.pack(">I", 0) + q(102) + struct.pack(">I", 8) + q(5)
    body += b"\x23" + q(5) + struct.pack(">II", 0, 2) + b"\x08" + b"hi"
    body += b"\x05" + q(1)
    return out + rec(0x1C, body)


def test_hprof(spark, tmp_path):
    (tmp_path / "d.hprof").write_bytes(hprof_bytes())
    s = Session(spark).add_heap(hprof.convert(spark, str(tmp_path / "d.hprof"), str(tmp_path / "out")))
    assert [tuple(r) for r in s.query("objects | groupBy(class) | sortBy(class, asc=true)").collect()] == [("a/Node", 2), ("byte[]", 1), ("java/lang/Object", 1), ("java/lang/String", 1)]
    assert s.query('objects[stringValue = "hi"] | count()').first()[0] == 1
    assert s.query("objects/instanceof/java.lang.Object | count()").first()[0] == 4
    assert [r.id for r in s.query("objects[id = 5] | pathToRoot").collect()] == [1, 2, 3, 4, 5]
    assert s.query("gcroots/STICKY_CLASS | count()").first()[0] == 1
    assert "totals" in analyses.heap_summary(s) and "listener-leak" in analyses.heap_report(s)
    with pytest.raises(ValueError):
        hprof.Dump(b"\x1f\x8bxxx\0")


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def recording_bytes():
    """A chunk with one event type: a time in ticks, a pooled thread and a text."""
    words = ["root", "metadata", "class", "field", "annotation", "id", "name", "superType", "constantPool", "true", "dimension", "value", "TICKS", "jdk.jfr.Event", "jdk.jfr.Timestamp", "long", "java.lang.String", "java.lang.Thread", "my.Event", "startTime", "eventThread", "path", "osName", "10", "11", "12", "13", "14", "sizes"]
    at = {w: number(i) for i, w in enumerate(words)}

    def element(name, attributes=(), kids=()):
        return at[name] + number(len(attributes)) + b"".join(at[k] + at[v] for k, v in attributes) + number(len(kids)) + b"".join(kids)

    ticks = element("annotation", [("class", "14"), ("value", "TICKS")])
    classes = [
        element("class", [("id", "10"), ("name", "long")]), element("class", [("id", "11"), ("name", "java.lang.String")]), element("class", [("id", "14"), ("name", "jdk.jfr.Timestamp")]),
        element("class", [("id", "12"), ("name", "java.lang.Thread")], [element("field", [("name", "osName"), ("class", "11")])]),
        element("class", [("id", "13"), ("name", "my.Event"), ("superType", "jdk.jfr.Event")], [element("field", [("name", "startTime"), ("class", "10")], [ticks]), element("field", [("name", "eventThread"), ("class", "12"), ("constantPool", "true")]), element("field", [("name", "path"), ("class", "11")]), element("field", [("name", "sizes"), ("class", "10"), ("dimension", "value")])]),
    ]
    text = lambda s: b"\x03" + number(len(s.encode())) + s.encode()
    sized = lambda body: number(len(body) + 1) + body if len(body) < 126 else number(len(body) + 2) + body
    meta = sized(number(0) + number(0) * 3 + number(len(words)) + b"".join(map(text, words)) + element("root", (), [element("metadata", (), classes)]))
    pools = sized(number(1) + number(0) * 2 + number(0) + b"\0" + number(1) + number(12) + number(1) + number(7) + text("main"))
    events = b"".join(sized(number(13) + number(1000 + 10 * i) + number(7) + text(f"/tmp/{i}") + number(2) + number(i) + number(5)) for i in range(3))
    body = events + pools + meta
    head = recordings.HEADER
    place = head.size + len(events)
    return head.pack(b"FLR\0", 2, 1, head.size + len(body), place, place + len(pools), 5_000, 99, 1000, 1_000_000_000, 1) + body


def test_recording(spark, tmp_path):
    (tmp_path / "r.jfr").write_bytes(recording_bytes() * 2)
    s = recordings.open_recording(spark, str(tmp_path / "r.jfr"), str(tmp_path / "out"))
    assert s.types() == ["my.Event"] and s.type_counts().first()["count"] == 6
    assert [tuple(r) for r in s.query("events/my.Event | head(3) | select(startTime, eventThread/osName as t, path)").collect()] == [(5000, "main", "/tmp/0"), (5010, "main", "/tmp/1"), (5020, "main", "/tmp/2")]
    assert s.query("events/my.Event/sizes | sum()").first()["sum"] == 36.0
    assert s.query("chunks | count()").first()[0] == 2 and recordings.chunk_summary(s).first().totalChunks == 2
    assert s.query("metadata/my.Event | select(fieldCount)").first()[0] == 4
    assert s.query("cp/java.lang.Thread | count()").first()[0] == 2
    assert {r.type: r.entries for r in s.query("cp").collect()}["java.lang.Thread"] == 2
    assert [r.name for r in s.query("metadata/my.Event/fields | select(name)").collect()] == sorted(r.name for r in s.query("metadata/my.Event/fields").collect())
    assert s.query("metadata/my.Event/fields/path/type").first()[0] == "java.lang.String"
    row = s.query("cp/java.lang.Thread | crossref()").first()
    assert row.cpTotal == 2 and [e.eventType for e in row.events] == ["my.Event"]
    assert "my.Event" in {r.name for r in s.all_types("event").collect()} and "long" in {r.name for r in s.all_types("primitive").collect()}
    got = []
    assert s.consume("events/my.Event | select(path)", got.append) == len(got) > 0
    x = recordings.crossref(s, "java.lang.Thread")
    assert x["totals"].first().asDict() == {"cpTotal": 2, "referenced": 2, "unused": 0, "usedPercent": 100.0, "unusedPercent": 0.0}
    assert tuple(x["events"].first()) == ("my.Event", 2, 6)
    with pytest.raises(ValueError, match="gzip"):
        recordings.Chunk(b"\x1f\x8b" + bytes(80), 0)
    (tmp_path / "two").mkdir()
    for name in "ab":
        (tmp_path / "two" / f"{name}.jfr").write_bytes((tmp_path / "r.jfr").read_bytes())
    both = recordings.open_recording(spark, str(tmp_path / "two"), str(tmp_path / "out2"))
    n = s.query("events/my.Event | count()").first()[0]
    one = [tuple(r) for r in s.query("events/my.Event | sortBy(path) | select(path)").collect()]
    assert both.query("events/my.Event | count()").first()[0] == 2 * n
    assert both.query("events/my.Event | decorateByTime(my.Event, threadPath=path, decoratorThreadPath=path) | count()").first()[0] == 2 * n
    assert [tuple(r) for r in both.query("events/my.Event | head(1) | select(path)").collect()] == [tuple(r) for r in s.query("events/my.Event | head(1) | select(path)").collect()] and len(one) == n


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("secret", "keep", [1, 2], {"a": 1}, ["x", "y"])], "f string, g string, n array<int>, m map<string,int>, t array<string>")
    assert sinks.flat_for_csv(df).first().asDict() == {"f": "secret", "g": "keep", "n": "1;2", "t": "x | y"}
    assert sinks.scrubbed(df, "f", "g", "ke+p").first().f == "xxxxxx" and sinks.scrubbed(df, "f", "g", "no").first().f == "secret"
    sinks.write(df, str(tmp_path / "csv"), "csv")
    assert "secret" in sinks.show(df)
    nodes = spark.createDataFrame([("a", "a", 1, 3, 1), ("a;b", "b", 2, 2, 2)], "path string, name string, depth int, count long, self long")
    assert ">b<" in sinks.flame_html(sinks.flame_tree(nodes))


def test_export_pprof(spark, tmp_path):
    s = Session(spark).add_events("e", spark.createDataFrame([(["leaf", "root"], 5, "t1"), (["leaf", "root"], 7, "t1"), (["other"], 1, None)], "stackTrace array<string>, bytes long, thread string"))
    path = str(tmp_path / "x.pb.gz")
    n = profiles.export_pprof(s, {"profiles": [{"type": "e", "values": [{"name": "samples", "unit": "count", "field": "@count"}, {"name": "space", "unit": "bytes", "field": "bytes"}], "labels": {"thread": "thread"}}]}, path)
    assert n == 2
    df, types = profiles.samples(spark, path)
    assert {(r.samples, r.space, r.thread) for r in df.collect()} == {(2, 12, "t1"), (1, 1, None)}


def test_analyses(spark):
    frame = "method struct<type: struct<name: string>, name: string>, lineNumber int"
    kind = f"startTime long, state string, eventThread struct<osName: string>, stackTrace struct<frames: array<struct<{frame}>>>"
    f = lambda *n: ([((c,), m), 1] for c, m in n)
    stack = lambda *n: ([(((c,), m), 1) for c, m in n],)
    del f
    s = Session(spark)
    s.add_events("jdk.ExecutionSample", spark.createDataFrame([(i, "STATE_RUNNABLE" if i % 4 else "BLOCKED", (f"t{i % 2}",), stack(("A", "leaf"), ("B", "root"))) for i in range(40)], kind))
    s.add_events("jdk.JavaExceptionThrow", spark.createDataFrame([(1, None, ("t",), stack(("java.lang.Throwable", "fillInStackTrace"), ("java.lang.Throwable", "<init>"), ("x.MyException", "<init>"), ("A", "go")))] * 3, kind))
    s.add_events("jdk.CPULoad", spark.createDataFrame([(0.5,), (0.95,)], "machineTotal double"))
    assert analyses.hot_methods(s).first().method == "A.leaf:1"
    assert analyses.flamegraph(s, "jdk.ExecutionSample").first().stack == "B.root:1;A.leaf:1"
    e = analyses.exceptions(s)
    assert (e["types"].first().type, e["types"].first().topThrowSite) == ("x.MyException", "A.go:1")
    t = analyses.tsa(s)
    assert {r.state: r.samples for r in t["states"].collect()} == {"RUNNABLE": 30, "BLOCKED": 10}
    assert {r.thread: r.behaviour for r in t["threads"].collect()} == {"t0": "LOCK_CONTENTION", "t1": "CPU_INTENSIVE"}
    assert analyses.use(s)["cpu"].first().assessment == "HIGH_UTILIZATION" and analyses.diagnose(s) == []
    p = s.query("events/jdk.ExecutionSample | stackprofile(buckets=2)").collect()
    assert [(r.name, r.total, r["self"]) for r in p] == [("B.root:1", 40, 0), ("A.leaf:1", 40, 40)] and sum(p[0].timeBuckets) == 40


def test_stream(spark, tmp_path):
    src = spark.createDataFrame([("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:01:10", "b", 4.0)], "t string, k string, v double").selectExpr("timestamp(t) t", "k", "v")
    src.write.parquet(str(tmp_path / "in"))
    live = folders.stream(spark, str(tmp_path / "in"), src.schema)
    q = folders.windowed(folders.query(live, "events/any[v < 3]"), "t", "1 minute", ["k"], "v").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.k, r["count"], r.sum) for r in spark.sql("select * from w").collect()] == [("a", 2, 3.0)]
    with pytest.raises(Exception, match="streams"):
        folders.query(live, "events/any | top(3)")


def test_schemas_of_a_type_merge():
    from pyspark.sql import types as T

    a = T.StructType().add("x", "long").add("s", T.StructType().add("p", "string"))
    b = T.StructType().add("s", T.StructType().add("q", "long")).add("x", "string").add("y", T.ArrayType(T.LongType()))
    out = recordings.merged([a, b])
    assert [f.name for f in out.fields] == ["x", "s", "y"] and out["x"].dataType == T.StringType()
    assert [f.name for f in out["s"].dataType.fields] == ["p", "q"]
