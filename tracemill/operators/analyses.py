"""Ready-made reports: each a composition of plans, returned as tables by name. A report scans an event type once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import heap as heaps
from . import stacks

#: Event types by what they report, in order of preference.
EXECUTION = ("jdk.ExecutionSample", "datadog.ExecutionSample", "jdk.NativeMethodSample")
EXCEPTIONS = ("jdk.JavaExceptionThrow", "datadog.ExceptionSample", "jdk.ExceptionStatistics")
IO = ("jdk.FileRead", "jdk.FileWrite", "jdk.SocketRead", "jdk.SocketWrite")
MONITORS = ("jdk.JavaMonitorEnter", "jdk.JavaMonitorWait")
QUEUES = ("datadog.QueueTime",)
SLOW_NANOS = 10_000_000
#: What a leaf's name says of its thread's state, in order.
STATE_WORDS = (("WAITING", ("park", "wait", "sleep", "await")), ("IO", ("read", "write", "poll", "select", "accept", "recv", "send", "epoll")), ("LOCK", ("lock", "monitor", "mutex", "synchronized")))


def first_present(session, names: tuple) -> str | None:
    """The first of the event types that has events."""
    return next((n for n in names if n in session.events and session.event_type(n).take(1)), None)


def column(df: DataFrame, *paths: str) -> Column:
    """The first of some paths that is not null, as text."""
    return F.coalesce(*(C.as_text(*C.at_path(df.schema, tuple(p.split("/")))[:2]) for p in paths), F.lit(None).cast("string"))


def number(df: DataFrame, path: str) -> Column:
    return C.as_double(*C.at_path(df.schema, tuple(path.split("/")))[:2])


def frames(df: DataFrame) -> Column:
    c, t, _ = C.at_path(df.schema, ("stackTrace",))
    if hasattr(t, "fieldNames") and "frames" in t.fieldNames():
        c, t = c.getField("frames"), t["frames"].dataType
    return stacks.frame_names(c, t)


def window(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col("startTime") >= start)
    return df.where(F.col("startTime") <= end) if end is not None else df


def share(of: str, total: Column) -> Column:
    return F.round(100.0 * F.col(of) / total, 1)


def whole(name: str) -> Column:
    return F.sum(name).over(Window.partitionBy())


def summary(session) -> dict:
    """Counts of all types, their 15 most frequent, GC totals."""
    counts = session.type_counts()
    out = {"types": counts, "top": counts.orderBy(F.desc("count"), "type").limit(15), "total": counts.agg(F.sum("count").alias("totalEvents"), F.count("*").alias("eventTypes"))}
    if "jdk.GarbageCollection" in session.events:
        gc = session.event_type("jdk.GarbageCollection")
        d = F.coalesce(number(gc, "sumOfPauses"), number(gc, "duration"))
        out["gc"] = gc.agg(F.count("*").alias("collections"), F.sum(d).alias("totalPause"), F.avg(d).alias("avgPause"), F.max(d).alias("maxPause"))
    return out


def hot_methods(session, event_type: str | None = None, limit: int = 20, native: bool = True) -> DataFrame:
    """(method, samples, pct, native): leaf frames by samples."""
    df = session.event_type(event_type or first_present(session, EXECUTION) or EXECUTION[0])
    leaf = df.select(F.get(frames(df), F.lit(0)).alias("method")).where("method IS NOT NULL").groupBy("method").agg(F.count("*").alias("samples"))
    mark = F.col("method").rlike(r"<|::|^_") | F.lower("method").contains("atomic")
    out = leaf.select("method", "samples", share("samples", whole("samples")).alias("pct"), mark.alias("native"))
    return (out if native else out.where("NOT native")).orderBy(F.desc("samples"), "method").limit(limit)


def flamegraph(session, event_type: str, direction: str = "top-down", min_samples: int = 1, max_depth: int | None = None) -> DataFrame:
    """(stack, count): folded stacks with samples of their own; max_depth keeps the frames nearest the leaf."""
    df = session.event_type(event_type)
    f = frames(df)
    f = F.slice(f, 1, max_depth) if max_depth else f
    own = df.select(f.alias("f")).where(F.size("f") > 0)
    stack = F.array_join(F.reverse("f") if direction == "top-down" else F.col("f"), stacks.SEPARATOR)
    return own.groupBy(stack.alias("stack")).agg(F.count("*").alias("count")).where(F.col("count") >= min_samples).orderBy(F.desc("count"), "stack")


def exceptions(session, event_type: str | None = None, min_count: int = 1, limit: int = 50) -> dict:
    """By type (with its most frequent throw site) and by throw site.

    The type is the class of the last constructor of an exception on the stack, else the thrown class;
    the throw site is the first frame after it that is no constructor.
    """
    df = session.event_type(event_type or first_present(session, EXCEPTIONS) or EXCEPTIONS[0])
    f = frames(df)
    ctor = lambda x: x.rlike(r"\.<init>(:\d+)?$")
    thrown = lambda x: ctor(x) & x.rlike(r"(Exception|Error|Throwable)\.<init>")
    d = df.select(f.alias("f"), column(df, "thrownClass/name", "thrownClass").alias("thrown"))
    d = d.withColumn("made", F.try_element_at(F.filter("f", thrown), F.lit(-1)))
    kind = F.coalesce(F.regexp_extract("made", r"^(.*)\.<init>", 1), F.col("thrown"))
    after = F.when(F.col("made").isNull(), F.col("f")).otherwise(F.slice("f", F.size("f") - F.array_position(F.reverse("f"), F.col("made")).cast("int") + 2, F.size("f")))
    site = F.try_element_at(F.filter(after, lambda x: ~ctor(x)), F.lit(1))
    d = d.select(F.translate(kind, "/", ".").alias("type"), site.alias("site")).where("type IS NOT NULL AND type <> ''")
    pairs = d.groupBy("type", "site").agg(F.count("*").alias("k"))
    types = pairs.groupBy("type").agg(F.sum("k").alias("count"), F.max_by("site", F.struct(F.when(F.col("site").isNotNull(), F.col("k")).otherwise(-1), "site")).alias("topThrowSite"))
    types = types.select("type", "count", share("count", whole("count")).alias("pct"), "topThrowSite").where(F.col("count") >= min_count)
    sites = pairs.where("site IS NOT NULL").groupBy("site").agg(F.sum("k").alias("count")).where(F.col("count") >= min_count)
    return {"types": types.orderBy(F.desc("count"), "type").limit(limit), "sites": sites.orderBy(F.desc("count"), "site").limit(20)}


def use(session, start: int | None = None, end: int | None = None) -> dict:
    """Utilisation, saturation and errors of CPU, memory, threads and I/O."""
    out = {}
    if "jdk.CPULoad" in session.events:
        df = window(session.event_type("jdk.CPULoad"), start, end)
        x = df.select((number(df, "machineTotal") * 100).alias("x"))
        ranks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)").alias(f"p{round(q * 100)}") for q in (0.95, 0.99)]
        cpu = x.agg(F.avg("x").alias("avg"), F.min("x").alias("min"), F.max("x").alias("max"), *ranks)
        out["cpu"] = cpu.withColumn("assessment", F.when(F.col("avg") < 30, "LOW").when(F.col("avg") < 70, "MODERATE_UTILIZATION").when(F.col("avg") < 90, "HIGH_UTILIZATION").otherwise("SATURATED"))
    if "jdk.GCHeapSummary" in session.events:
        df = window(session.event_type("jdk.GCHeapSummary"), start, end)
        heap = df.agg(F.avg(number(df, "heapUsed")).alias("avgUsed"), F.max(number(df, "heapUsed")).alias("maxUsed"), F.max(number(df, "heapSpace/committedSize")).alias("committed"))
        pct = 100.0 * F.col("maxUsed") / F.col("committed")
        out["memory"] = heap.withColumn("pct", pct).withColumn("assessment", F.when(F.col("pct") > 90, "HIGH_PRESSURE").when(F.col("pct") > 75, "MODERATE_PRESSURE").otherwise("HEALTHY"))
    kinds = [n for n in IO if n in session.events]
    if kinds:
        parts = [window(session.event_type(n), start, end) for n in kinds]
        rows = [p.select(F.lit(n).alias("type"), number(p, "duration").alias("d"), F.coalesce(number(p, "bytesRead"), number(p, "bytesWritten"), number(p, "bytes")).alias("b")) for n, p in zip(kinds, parts, strict=True)]
        df = rows[0]
        for r in rows[1:]:
            df = df.union(r)
        out["io"] = df.groupBy("type").agg(F.count("*").alias("operations"), F.sum("b").alias("bytes"), F.avg("d").alias("avgNanos"), F.max("d").alias("maxNanos"), F.sum((F.col("d") > SLOW_NANOS).cast("long")).alias("slow")).orderBy("type")
    name = first_present(session, EXECUTION)
    if name:
        df = window(session.event_type(name), start, end)
        state = df.groupBy(F.regexp_replace(F.coalesce(column(df, "state", "state/name"), F.lit("UNKNOWN")), "^STATE_", "").alias("state")).agg(F.count("*").alias("samples"))
        out["threads"] = state.select("state", "samples", share("samples", whole("samples")).alias("pct")).orderBy(F.desc("samples"), "state")
    return out


def state_of(df: DataFrame) -> Column:
    s = F.upper(F.regexp_replace(F.coalesce(column(df, "state/name", "state"), F.lit("UNKNOWN")), "^STATE_", ""))
    return F.when(s.rlike("RUNNABLE|RUNNING"), "RUNNABLE").when(s.rlike("BLOCKED|MONITOR"), "BLOCKED").when(s.rlike("TIMED|SLEEP"), "TIMED_WAITING").when(s.rlike("WAIT|PARK"), "WAITING").otherwise(s)


def tsa(session, start: int | None = None, end: int | None = None, top_threads: int = 10, min_samples: int = 5) -> dict:
    """Thread state analysis: samples by state, threads with their states and behaviour, the leaders of each state, monitors and queues."""
    name = first_present(session, EXECUTION)
    if not name:
        raise ValueError("no execution samples")
    df = window(session.event_type(name), start, end)
    thread = F.coalesce(*(column(df, "/".join(p)) for p in stacks.THREAD_PATHS), F.lit("<unknown>"))
    s = df.groupBy(thread.alias("thread"), state_of(df).alias("state")).agg(F.count("*").alias("n"))
    states = s.groupBy("state").agg(F.sum("n").alias("samples"))
    of = lambda *names: F.sum(F.when(F.col("state").isin(*names), F.col("n")).otherwise(0))
    t = s.groupBy("thread").agg(F.sum("n").alias("samples"), of("RUNNABLE").alias("runnable"), of("WAITING", "TIMED_WAITING").alias("waiting"), of("BLOCKED").alias("blocked")).where(F.col("samples") >= min_samples)
    part = lambda c: 100.0 * F.col(c) / F.col("samples")
    t = t.withColumn("behaviour", F.when(part("runnable") > 80, "CPU_INTENSIVE").when(part("waiting") > 70, "IO_WAITING").when(part("blocked") > 20, "LOCK_CONTENTION").otherwise("BALANCED"))
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("n"), "thread"))
    out = {"states": states.select("state", "samples", share("samples", whole("samples")).alias("pct")).orderBy(F.desc("samples"), "state"), "threads": t.orderBy(F.desc("samples"), "thread").limit(20), "top": s.withColumn("rank", rank).where(F.col("rank") <= top_threads).orderBy("state", "rank")}
    held = [n for n in MONITORS if n in session.events]
    if held:
        parts = [window(session.event_type(n), start, end) for n in held]
        rows = [p.select(column(p, "monitorClass/name", "monitorClass").alias("monitor"), number(p, "duration").alias("d")) for p in parts]
        df = rows[0]
        for r in rows[1:]:
            df = df.union(r)
        out["monitors"] = df.where("monitor IS NOT NULL").groupBy("monitor").agg(F.count("*").alias("events"), F.sum("d").alias("totalNanos"), F.avg("d").alias("avgNanos")).orderBy(F.desc("events"), "monitor")
    for n in QUEUES:
        if n in session.events:
            q = window(session.event_type(n), start, end)
            per = q.groupBy(column(q, "scheduler/name", "scheduler", "queueType/name", "queueType").alias("scheduler")).agg(F.count("*").alias("events"), (F.avg(number(q, "duration")) / 1e6).alias("avgMs"))
            out["queues"] = per.withColumn("saturation", F.when(F.col("avgMs") > 100, "HIGH_QUEUE_SATURATION").when(F.col("avgMs") > 20, "MODERATE_QUEUE_SATURATION").otherwise("LOW_QUEUE_SATURATION")).orderBy(F.desc("avgMs"), "scheduler")
    return out


def diagnose(session) -> list:
    """Findings (severity, area, text) by fixed thresholds on exceptions, collections and samples."""
    found = []
    name = first_present(session, EXCEPTIONS)
    if name:
        n = session.event_type(name).count()
        if n > 100:
            found.append(("HIGH" if n > 1000 else "MEDIUM", "exceptions", f"{n} exceptions"))
    if "jdk.GarbageCollection" in session.events:
        gc = summary(session)["gc"].first()
        average, total = (gc.avgPause or 0) / 1e6, (gc.totalPause or 0) / 1e9
        if average > 50:
            found.append(("HIGH" if average > 100 else "MEDIUM", "gc", f"pauses of {average:.0f} ms on average"))
        if total > 5:
            found.append(("HIGH" if total > 10 else "MEDIUM", "gc", f"{total:.1f} s of pauses"))
    name = first_present(session, EXECUTION)
    if name and (n := session.event_type(name).count()) > 5000:
        found.append(("MEDIUM", "cpu", f"{n} execution samples"))
    return found


# samples
def value_type(session, words: tuple) -> str:
    return next((v for v in session.value_types if any(w in v.lower() for w in words)), session.value_types[0])


def sample_hot_methods(session, value: str | None = None, limit: int = 20) -> DataFrame:
    v = value or session.value_types[0]
    leaf = session.samples.select(F.get("stackTrace", F.lit(0))["name"].alias("method"), F.col(v).alias("v")).where("method IS NOT NULL").groupBy("method").agg(F.sum("v").alias(v))
    return leaf.select("method", v, share(v, whole(v)).alias("pct")).orderBy(F.desc(v), "method").limit(limit)


def sample_states(session) -> DataFrame:
    """(state, value, pct): states as the leaf's name tells them."""
    v = value_type(session, ("cpu", "wall", "time"))
    leaf = F.lower(F.coalesce(F.get("stackTrace", F.lit(0))["name"], F.lit("")))
    state = F.lit("RUNNING")
    for name, words in reversed(STATE_WORDS):
        state = F.when(leaf.rlike("|".join(words)), name).otherwise(state)
    per = session.samples.groupBy(state.alias("state")).agg(F.sum(v).alias("value"))
    return per.select("state", "value", share("value", whole("value")).alias("pct")).orderBy(F.desc("value"), "state")


def sample_use(session) -> dict:
    """CPU and memory as the value types tell them: totals and leading methods."""
    out = {}
    for area, words in (("cpu", ("cpu", "wall", "time")), ("memory", ("alloc", "inuse", "heap", "mem"))):
        v = next((x for x in session.value_types if any(w in x.lower() for w in words)), None)
        if v:
            out[area] = session.samples.agg(F.lit(v).alias("type"), F.count("*").alias("samples"), F.sum(v).alias("total"))
            out[f"{area}_methods"] = sample_hot_methods(session, v, 10)
    return out


def sample_summary(session) -> dict:
    """Of each value type its total, of threads their samples, and the leading methods."""
    s = session.samples
    totals = None
    for v in session.value_types:
        one = s.agg(F.lit(v).alias("type"), F.count(v).alias("samples"), F.sum(v).cast("long").alias("total"))
        totals = one if totals is None else totals.union(one)
    out = {"totals": totals, "methods": sample_hot_methods(session, limit=10)}
    if "thread" in s.columns:
        out["threads"] = s.groupBy(F.coalesce(F.col("thread").cast("string"), F.lit("<unknown>")).alias("thread")).agg(F.count("*").alias("samples")).orderBy(F.desc("samples"), "thread").limit(20)
    return out


def sample_flamegraph(session, value: str | None = None, min_value: int = 1, max_depth: int | None = None) -> DataFrame:
    """(stack, value): folded stacks from root to leaf; max_depth keeps the frames nearest the leaf."""
    v = value or session.value_types[0]
    f = F.transform("stackTrace", lambda x: x["name"])
    own = session.samples.select((F.slice(f, 1, max_depth) if max_depth else f).alias("frames"), F.col(v).alias("v"))
    return stacks.folded(own, v).where(F.col(v) >= min_value).orderBy(F.desc(v), "stack")


# heaps
def heap_summary(session) -> dict:
    h = session.heap
    return {"totals": h.objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum("shallow"), F.lit(0)).alias("bytes"), F.countDistinct("class_id").alias("classes")), "classes": session.query("classes | top(20, instanceCount)"), "roots": session.query("gcroots | groupBy(type)")}


def heap_report(session, limit: int = 20) -> dict:
    """Histogram, roots, leak findings with a severity by what they retain, duplicates and waste."""
    size = F.when(F.col("retained") >= 100 << 20, "CRITICAL").when(F.col("retained") >= 10 << 20, "WARNING").when(F.col("retained") >= 1 << 20, "INFO")
    out = {"histogram": session.query(f"objects | groupBy(class, sum(shallow)) | sortBy(shallow, asc=false) | head({limit})"), "roots": session.query("gcroots | groupBy(type)"), "duplicates": session.query(f"duplicates(depth=1) | top({limit}, wastedBytes)"), "waste": session.query(f"objects | waste | filter(wastedBytes > 0) | top({limit}, wastedBytes)")}
    for d in heaps.LEAKS:
        rows = session.query(f'objects | checkLeaks("{d}")')
        out[d] = rows.withColumn("severity", size) if "retained" in rows.columns else rows
    return out
