"""Literal cases of the three dialects."""

import pytest
from pyspark.sql import Row

from tracemill.operators import heap as heaps
from tracemill.plans.parser import QueryError, epoch_nanos, parse
from tracemill.session import Session


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture()
def session(spark):
    s = Session(spark)
    s.add_events("jdk.FileRead", spark.createDataFrame([Row(path="/tmp/a.txt", bytes=100), Row(path="/tmp/b.txt", bytes=1500)]))
    s.add_events("jdk.FileWrite", spark.createDataFrame([Row(path="/tmp/c.txt", bytes=200)]))
    s.add_events("jdk.SocketRead", spark.createDataFrame([Row(host="example.com", bytes=2000)]))
    thread = lambda i: Row(javaThreadId=i)
    s.add_events("lock", spark.createDataFrame([Row(eventThread=thread(1), startTime=1000, duration=1000, monitorClass="MyLock")]))
    s.add_events("sample", spark.createDataFrame([Row(eventThread=thread(1), startTime=1500, stackTrace="a"), Row(eventThread=thread(1), startTime=3000, stackTrace="b"), Row(eventThread=thread(2), startTime=1500, stackTrace="c")]))
    return s


def test_union_and_filter(session):
    assert session.query("events/(jdk.FileRead|jdk.FileWrite) | count()").first()[0] == 3
    assert rows(session.query("events/(jdk.FileRead|jdk.SocketRead)[bytes > 1000] | select(bytes)")) == [(1500,), (2000,)]


def test_unknown_type_suggests(session):
    with pytest.raises(QueryError, match="jdk.FileRead"):
        session.query("events/jdk.FileRed | count()")


def test_decorate_by_time(session):
    got = session.query("events/sample | decorateByTime(lock, fields=monitorClass) | select(stackTrace, $decorator.monitorClass as m)")
    assert sorted(rows(got)) == [("a", "MyLock"), ("b", None), ("c", None)]


def test_points_do_not_match_points(spark):
    s = Session(spark)
    at = lambda t, d: Row(eventThread=Row(javaThreadId=1), startTime=t, duration=d, k=t)
    s.add_events("p", spark.createDataFrame([at(10, 0), at(20, 0)])).add_events("d", spark.createDataFrame([at(10, 0), at(15, 10)]))
    assert rows(s.query("events/p | decorateByTime(d) | select(startTime, $decorator.k as k)").orderBy("startTime")) == [(10, None), (20, 15)]


def test_aggregates_of_few_numbers(spark):
    s = Session(spark).add_events("x", spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double"))
    assert rows(s.query("events/x | quantiles(0.5, 0.9, 0.99, 0.999, path=v)")) == [(10, 5.5, 9.0, 10.0, 10.0)]
    assert s.query("events/x | quantiles(0.999, path=v)").columns == ["count", "p99.9"]
    s.add_events("none", spark.createDataFrame([], "v double"))
    assert rows(s.query("events/none | stats(v)")) == [(0, None, None, None, None)]
    assert rows(s.query("events/none | sum(v)")) == [(0.0, 0)]
    s.add_events("neg", spark.createDataFrame([("a", -5), ("a", -2)], "k string, v int"))
    assert rows(s.query("events/neg | groupBy(k, agg=max, value=v)")) == [("a", -2.0)]
    assert s.query("events/neg[v != -5] | count()").first()[0] == 1


def test_expressions(spark):
    s = Session(spark).add_events("e", spark.createDataFrame([(None, "x", 0, -2.5)], "a string, b string, z int, h double"))
    got = s.query('events/e | select("<${a}>" as t, b + 1 as c, h / z as q, if(z, 1, 2) as i)').first()
    assert got.t == "<>" and got.c.startswith("x1") and got.q != got.q and got.i == 2
    assert s.query("events/e | round(h)").first()[0] == -2


def test_nested_paths_and_quantifiers(spark):
    kind = "id int, s struct<items: array<struct<n: int, name: string>>>"
    data = [(1, ([(1, "a"), (5, "b")],)), (2, ([],)), (3, None)]
    s = Session(spark).add_events("e", spark.createDataFrame(data, kind))
    assert rows(s.query("events/e/s/items/n")) == [(1,), (5,)]
    assert rows(s.query("events/e/s/items[n > 2]/name")) == [("b",)]
    assert rows(s.query("events/e[any:s/items/n > 4] | select(id)")) == [(1,)]
    assert rows(s.query("events/e[all:s/items/n > 0] | select(id)")) == [(1,)]
    assert rows(s.query("events/e[none:s/items/n > 4] | select(id)")) == [(2,), (3,)]
    assert rows(s.query("events/e[s/items[1]/name = \"b\"] | select(id)")) == [(1,)]


def test_to_map_last_wins(spark):
    s = Session(spark).add_events("e", spark.createDataFrame([("a", 1), (None, 2), ("a", 3), ("b", 4)], "k string, v int").coalesce(1))
    assert s.query("events/e | toMap(k, v)").first()[0] == {"a": 3, "b": 4}


def test_parser_errors_and_words():
    for bad in ("events/x |", "events/x[a >", "nothing/x", 'events/x[a = "b]'):
        with pytest.raises(QueryError):
            parse(bad)
    assert parse("events/x[notify = 1 and order > 2K]").filters[0].args[1].right.value == 2048
    assert epoch_nanos("1970-01-01T00:00:01.5Z") == 1_500_000_000 and epoch_nanos("x") is None


@pytest.fixture()
def samples(spark):
    f = lambda *n: [Row(name=x) for x in n]
    data = [Row(cpu=1_000_000, thread="main", stackTrace=f("compute", "helper")), Row(cpu=2_000_000, thread="main", stackTrace=f("run", "helper")), Row(cpu=500_000, thread="Worker-1", stackTrace=f("compute", "run"))]
    return Session(spark).add_samples(spark.createDataFrame(data), ["cpu"])


def test_samples(samples):
    assert rows(samples.query("samples | groupBy(thread, sum(cpu))")) == [("main", 3e6), ("Worker-1", 5e5)]
    assert rows(samples.query("samples | stackprofile(cpu)")) == [("helper;run", 2_000_000), ("helper;compute", 1_000_000), ("run;compute", 500_000)]
    assert rows(samples.query("samples | stats(cpu)"))[0][1:] == (3, 3_500_000, 500_000, 2_000_000, 1_166_667)
    assert samples.query('samples[thread = "x" or cpu > 600000 and thread ~ "mai"] | count()').first()[0] == 2


def heap_of(spark, edges, roots, sizes):
    objects = spark.createDataFrame([(i, 1, s, None, None) for i, s in sizes.items()], "id long, class_id long, shallow long, array_length int, string_value string")
    e = spark.createDataFrame([(a, b, "f", sum(x[0] == a for x in edges[:k]), strong) for k, (a, b, strong) in enumerate(edges)], "src long, dst long, field string, ord int, strong boolean")
    classes = spark.createDataFrame([(1, "a/B", None, 8, False)], "class_id long, name string, super_id long, instance_size int, is_array boolean")
    return heaps.Heap(objects, e, classes, spark.createDataFrame([("JAVA_FRAME", r) for r in roots], "type string, object_id long"))


def brute_dominators(n, edges, roots):
    """Of each reachable node the dominators, by removing one node at a time."""

    def reach(without):
        seen, todo = set(), [r for r in roots if r != without]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b, s in edges if a == x and s and b != without]
        return seen

    whole = reach(None)
    return {d: {x for x in whole if x != d and x not in reach(d)} | {d} for d in whole}


GRAPHS = {
    "diamond": ([(1, 2, True), (1, 3, True), (2, 4, True), (3, 4, True), (4, 5, True)], [1], 5),
    "cycle": ([(1, 2, True), (2, 3, True), (3, 2, True), (3, 3, True)], [1], 4),
    "two roots": ([(1, 3, True), (2, 3, True), (3, 4, True), (4, 3, True), (5, 1, True)], [1, 2], 5),
    "weak": ([(1, 2, False), (1, 3, True), (3, 2, True), (2, 4, True), (1, 4, True)], [1], 4),
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_retained_sizes(spark, name, monkeypatch):
    edges, roots, n = GRAPHS[name]
    sizes = {i: 10**i for i in range(1, n + 1)}
    doms = brute_dominators(n, edges, roots)
    want = {d: sum(sizes[x] for x in xs) for d, xs in doms.items()}
    for most in (heaps.ONE_TASK, 0):  # one task, and joins
        monkeypatch.setattr(heaps, "ONE_TASK", most)
        heap = heap_of(spark, edges, roots, sizes)
        assert dict(rows(heaps.retained_sizes(heap))) == {i: want.get(i, sizes[i]) for i in sizes}
        chains = {r.id: r.chain for r in heaps.dominators(heap).collect()}
        assert {i: set(c) - {0} for i, c in chains.items()} == {i: {d for d in doms if i in doms[d]} for i in doms}


def test_dominators_of_random_and_deep_graphs():
    import numpy as np

    from tracemill.operators import dominators

    rng = np.random.default_rng(1)
    for n, m in ((8, 12), (12, 30), (20, 24)):
        for _ in range(20):
            src, dst = rng.integers(1, n + 1, (2, m))
            edges = [(int(a), int(b), True) for a, b in zip(src, dst, strict=True)]
            ids, idom, retained, _ = dominators.tree(np.arange(1, n + 1), np.full(n, 1), src, dst, np.array([1, 2]))
            want = brute_dominators(n, edges, [1, 2])
            assert {int(i): int(r) for i, r in zip(ids[1:], retained[1:], strict=True)} == {d: len(xs) for d, xs in want.items()}
            assert all(d == 0 or x in want[d] for x, d in zip(ids[1:].tolist(), idom[1:].tolist(), strict=True))
    n = 10_000
    chain = np.arange(1, n)
    ids, _, retained, _ = dominators.tree(np.arange(1, n + 1), np.ones(n, int), np.append(chain, n), np.append(chain + 1, n // 2), np.array([1]))
    assert retained[1:].tolist() == list(range(n, 0, -1)) and ids[1:].tolist() == list(range(1, n + 1))


def test_deep_chain_of_objects(spark):
    """Ten thousand objects in a row, and a diamond at its end."""
    from pyspark.sql import functions as F

    n = 10_000
    objects = spark.range(1, n + 4).select("id", F.lit(1).cast("long").alias("class_id"), F.lit(8).cast("long").alias("shallow"), F.lit(None).cast("int").alias("array_length"), F.lit(None).cast("string").alias("string_value"))
    chain = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).union(spark.createDataFrame([(n, n + 1), (n, n + 2), (n + 1, n + 3), (n + 2, n + 3)], "src long, dst long"))
    edges = chain.select("src", "dst", F.lit("next").alias("field"), F.lit(0).alias("ord"), F.lit(True).alias("strong"))
    classes = spark.createDataFrame([(1, "a/Node", None, 8, False)], "class_id long, name string, super_id long, instance_size int, is_array boolean")
    heap = heaps.Heap(objects, edges, classes, spark.createDataFrame([("JAVA_FRAME", 1)], "type string, object_id long"))
    got = dict(rows(heaps.retained_sizes(heap)))
    assert got[1] == 8 * (n + 3) and got[n] == 32 and got[n + 1] == got[n + 2] == got[n + 3] == 8


def test_thread_owner_is_named(spark):
    objects = spark.createDataFrame([(1, 1, 8, None, None), (2, 2, 8, None, "worker"), (3, 1, 8, None, None), (4, 1, 8, None, None), (5, 1, 8, None, None)], "id long, class_id long, shallow long, array_length int, string_value string")
    edges = spark.createDataFrame([(1, 2, "name", 0, True), (1, 3, "x", 1, True), (1, 4, "y", 2, True), (5, 4, "y", 0, True)], "src long, dst long, field string, ord int, strong boolean")
    classes = spark.createDataFrame([(1, "a/B", None, 8, False), (2, "java/lang/String", None, 8, False)], "class_id long, name string, super_id long, instance_size int, is_array boolean")
    s = Session(spark).add_heap(heaps.Heap(objects, edges, classes, spark.createDataFrame([("THREAD_OBJ", 1), ("STICKY_CLASS", 5)], "type string, object_id long")))
    assert {r.id: (r.ownerThread, r.ownership) for r in s.query("objects | threadOwner").collect()} == {1: ("worker", "exclusive"), 2: ("worker", "exclusive"), 3: ("worker", "exclusive"), 4: ("shared", "shared"), 5: ("shared", "shared")}
    assert s.query("gcroots | dominatedSize | filter(objectId = 1)").first().threadName == "worker"


def test_decorate_time_of_unions_and_long_spans(spark):
    at = lambda k, t, d: Row(eventThread=Row(javaThreadId=1), startTime=t, duration=d, k=k)
    s = Session(spark)
    s.add_events("a", spark.createDataFrame([at("a", 10, 5)])).add_events("b", spark.createDataFrame([at("b", 1000, 5)]))
    s.add_events("d", spark.createDataFrame([at("d1", 12, 1), at("d2", 1002, 1), at("long", 900, 10**14)]))
    assert sorted(rows(s.query("events/(a|b) | decorateByTime(d) | select(k, $decorator.k as d)"))) == [("a", "d1"), ("b", "long")]
    s.add_events("d", spark.createDataFrame([at("d1", 12, 1), at("d2", 1002, 1)]))
    assert sorted(rows(s.query("events/(a|b) | decorateByTime(d) | select(k, $decorator.k as d)"))) == [("a", "d1"), ("b", "d2")]
    rng = __import__("random").Random(2)
    spans = lambda n: [(rng.randrange(10**6), rng.choice([0, 1, 50, 3000, 10**5, 10**9])) for _ in range(n)]
    p, d = spans(60), spans(60)
    s.add_events("p", spark.createDataFrame([at(i, *x) for i, x in enumerate(p)]).coalesce(1)).add_events("q", spark.createDataFrame([at(i, *x) for i, x in enumerate(d)]).coalesce(1))
    got = dict(rows(s.query("events/p | decorateByTime(q) | select(k, $decorator.k as d)")))
    want = {i: min(((b, j) for j, (b, m) in enumerate(d) if a < b + m and a + n > b), default=(0, None))[1] for i, (a, n) in enumerate(p)}
    assert got == want


def test_order_of_tail_and_unions(spark):
    s = Session(spark).add_events("e", spark.range(20).withColumnRenamed("id", "odd `name").coalesce(1))
    assert [r[0] for r in s.query("events/e | tail(3)").collect()] == [17, 18, 19]
    s.add_events("f", spark.range(20).selectExpr("id as v", "id % 7 as w").coalesce(1))
    assert [r.v for r in s.query("events/f | sortBy(w) | tail(3) | select(v)").collect()] == [0, 7, 14]
    s.add_events("g", spark.range(3).selectExpr("id + 100 as v", "id as w").coalesce(1))
    assert [r.v for r in s.query("events/(f|g) | head(4) | select(v)").collect()] == [0, 100, 1, 101]
    assert [r.v for r in s.query("events/(g|f) | distinct(w) | select(v)").collect()].count(100) == 1


def test_quantiles_of_odd_numbers(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(0, 1e-300, 50), rng.normal(0, 1e300, 50), np.full(200, 7.0), [-1.7e308, 1.7e308, 0.0, 1.5e18, 1.5e18 + 256]])
    s = Session(spark).add_events("x", spark.createDataFrame([(float(v),) for v in data], "v double"))
    got = s.query("events/x | quantiles(0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0, path=v)").first()
    own = np.sort(data)
    assert list(got)[1:] == [own[max(0, int(np.ceil(round(q * len(own), 9))) - 1)] if q != 0.5 else (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2 for q in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0)]


def test_approximate_retained_stops_at_shared(spark):
    edges, roots, n = GRAPHS["diamond"]
    heap = heap_of(spark, edges, roots, {i: 10**i for i in range(1, n + 1)})
    assert dict(rows(heaps.approximate_retained(heap))) == {1: 11110, 2: 10100, 3: 11000, 4: 10000, 5: 100000}


def test_heap_queries(spark):
    edges, roots, n = GRAPHS["diamond"]
    s = Session(spark).add_heap(heap_of(spark, edges, roots, {i: 8 for i in range(1, n + 1)}))
    assert s.query("objects/a.B | count()").first()[0] == 5
    assert rows(s.query("objects[id = 5] | pathToRoot | select(step, id)")) == [(0, 1), (1, 2), (2, 4), (3, 5)]
    assert s.query("objects[id = 4] | whatif").first().freedBytes == 16
    assert rows(s.query("objects | top(1, retained) | select(id, retained)")) == [(1, 40)]
    assert s.query('objects | checkLeaks("help")').count() == 6
    assert rows(s.query("objects[className != null] | groupBy(class, sum(shallow))")) == [("a/B", 40.0)]
    assert s.query("duplicates(depth=1) | count()").first()[0] == 1
    assert s.query("clusters | count()").first()[0] >= 1


def test_waste_and_caches(spark):
    objects = spark.createDataFrame([(1, 1, 64, None, None, {"size": 3, "accessOrder": 1}), (2, 2, 8, 1024, None, None), (3, 3, 16, None, None, None), (4, 4, 16, None, None, {"head": 6, "tail": 2}), (5, 2, 8, 8, None, None)], "id long, class_id long, shallow long, array_length int, string_value string, fields map<string,bigint>")
    edges = spark.createDataFrame([(1, 2, "table", 0, True), (3, 1, "map", 0, True), (4, 5, "elements", 0, True)], "src long, dst long, field string, ord int, strong boolean")
    classes = spark.createDataFrame([(1, "java/util/LinkedHashMap", None, 8, False), (2, "[Ljava/util/Node;", None, 8, True), (3, "java/util/HashSet", None, 8, False), (4, "java/util/ArrayDeque", None, 8, False)], "class_id long, name string, super_id long, instance_size int, is_array boolean")
    s = Session(spark).add_heap(heaps.Heap(objects, edges, classes, spark.createDataFrame([("STICKY_CLASS", 3), ("JAVA_FRAME", 4)], "type string, object_id long")))
    got = {r.id: (r.capacity, r.size, r.wastedBytes, r.wasteType) for r in s.query("objects | waste").collect()}
    assert got[1] == got[3] == (1024, 3, 8168, "overCapacity") and got[4] == (8, 4, 32, "overCapacity") and got[2] == (None, None, None, None)
    c = {r.id: r for r in s.query("objects | cacheStats").collect()}
    assert (c[1].entryCount, c[1].maxSize, c[1].costPerEntry, c[1].isLruMode) == (3, 1024, 24, True)
    ages = {r.id: (r.estimatedAge, r.ageBucket) for r in s.query("ages").collect()}
    assert ages[3] == (40, "medium") and ages[1] == (41, "medium") and ages[4] == (10, "ephemeral")
    assert [r.path for r in heaps.all_paths(s.heap, 2).collect()] == [[3, 1, 2]]
    assert {(r.id, r.idom) for r in heaps.hybrid_dominators(s.heap, 1, ("java.util.Linked*",)).select("id", "idom").collect()} >= {(3, 0), (1, 3)}


def test_leak_detectors(spark):
    objects = spark.createDataFrame([(1, 1, 8, None, None), (2, 2, 8, None, None), (3, 3, 2 << 20, None, None), (4, 4, 16, None, None), (5, 5, 11 << 20, 40, None), (6, 6, 11 << 20, None, None), (7, 7, 8, None, "web"), *((10 + i, 7, 24, None, "same") for i in range(3)), *((20 + i, 8, 8, None, None) for i in range(2))], "id long, class_id long, shallow long, array_length int, string_value string")
    edges = spark.createDataFrame([(1, 2, "locals", 0, True), (2, 3, "value", 0, True), (4, 5, "table", 0, True), (6, 7, "name", 0, True)], "src long, dst long, field string, ord int, strong boolean")
    names = ["java/lang/Thread", "java/lang/ThreadLocal$ThreadLocalMap$Entry", "[B", "java/util/HashMap", "[Ljava/util/Node;", "app/WebLoader", "java/lang/String", "app/ClickListener"]
    classes = spark.createDataFrame([(i + 1, n, None, 8, False, 6 if i > 6 else None) for i, n in enumerate(names)], "class_id long, name string, super_id long, instance_size int, is_array boolean, loader_id long")
    roots = spark.createDataFrame([("THREAD_OBJ", 1), ("STICKY_CLASS", 4), ("JNI_GLOBAL", 6)], "type string, object_id long")
    s = Session(spark).add_heap(heaps.Heap(objects, edges, classes, roots))
    leaks = lambda text: s.query(f"objects | checkLeaks({text})").collect()
    r = leaks('"threadlocal-leak"')
    assert [(x.id, x.attachedToThread, x.valueClass) for x in r] == [(2, True, "[B")]
    r = leaks('"growing-collections"')
    assert [(x.id, x.retained, x.elementCount) for x in r] == [(4, 16 + (11 << 20), 0)] and "HashMap" in r[0].suggestion
    r = leaks('"classloader-leak"')
    assert [(x.id, x.loaderName, x.loadedClasses) for x in r] == [(6, "web", 1)]
    r = leaks('"duplicate-strings", threshold=3')
    assert [(x["count"], x.value, x.retained, x.wastedBytes) for x in r] == [(3, "same", 72, 48)]
    assert [(x["class"], x["count"], x.retained) for x in leaks('"listener-leak", threshold=2')] == [("app.ClickListener", 2, 16)]
    with pytest.raises(QueryError):
        leaks('filter="mine"')
    big = {x.id: x.gcRootPath for x in s.query("objects | dominators()").collect()}
    assert big == {2: "java.lang.Thread → java.lang.ThreadLocal$ThreadLocalMap$Entry", 3: "java.lang.Thread → java.lang.ThreadLocal$ThreadLocalMap$Entry → [B", 5: "java.util.HashMap → [Ljava.util.Node;"}
    s.set("a", {"x": 1, "y": 2})
    s.set("b", {"y": 3})
    assert s.merge("a", "b") == {"x": 1, "y": 3}
