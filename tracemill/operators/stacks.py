"""Stack samples: trees as rows of their nodes, folded stacks, call edges and timed profiles. Frames are leaf first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

#: Where a sample's thread is named, in order.
THREAD_PATHS = (("eventThread", "osName"), ("eventThread", "javaName"), ("sampledThread", "osName"), ("sampledThread", "javaName"))
SEPARATOR = ";"


def frame_names(c: Column, t: T.DataType) -> Column:
    """Frames as `class.method`, with the line if there is one; strings are themselves and nulls are left out."""
    if isinstance(t, T.StringType):
        return F.when(c.isNotNull(), F.array(c))
    if not isinstance(t, T.ArrayType):
        return F.lit(None).cast("array<string>")
    kind = t.elementType
    if isinstance(kind, T.StringType):
        return F.filter(c, lambda x: x.isNotNull())

    def name(x):
        def at(*parts):
            y, yt, _ = C.walk(x, kind, parts)
            return C.as_text(y, yt)

        names = kind.fieldNames()
        if "method" in names:
            own = F.coalesce(at("method", "type", "name", "string"), at("method", "type", "name"), F.lit(None).cast("string"))
            method = F.coalesce(at("method", "name", "string"), at("method", "name"))
            line = at("lineNumber") if "lineNumber" in names else F.lit(None).cast("string")
            return F.concat(F.concat_ws(".", own, method), F.when(line.isNotNull() & (line != "-1"), F.concat(F.lit(":"), line)).otherwise(""))
        return at("name")

    return F.filter(F.transform(c, name), lambda x: x.isNotNull() & (x != ""))


def prefixes(frames: Column) -> Column:
    """All prefixes of an array that has elements."""
    return F.when(F.size(frames) > 0, F.transform(F.sequence(F.lit(1), F.size(frames)), lambda i: F.slice(frames, 1, i)))


def flame_nodes(df: DataFrame, top_down: bool) -> DataFrame:
    """(path, name, depth, count, self) of each node of the prefix tree of `frames`; top_down: from the roots, else from the leaves."""
    f = df.where(F.size("frames") > 0).select((F.reverse("frames") if top_down else F.col("frames")).alias("f")).groupBy("f").agg(F.count("*").alias("n"))
    nodes = f.select(F.explode(prefixes(F.col("f"))).alias("path"), F.size("f").alias("size"), "n")
    out = nodes.groupBy("path").agg(F.sum("n").alias("count"), F.sum(F.when(F.size("path") == F.col("size"), F.col("n")).otherwise(0)).alias("self"))
    return out.select(F.array_join("path", SEPARATOR).alias("path"), F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), "count", "self")


def folded(df: DataFrame, value: str = "count") -> DataFrame:
    """(stack, value): stacks from root to leaf, their values `v` summed."""
    return df.where(F.size("frames") > 0).groupBy(F.array_join(F.reverse("frames"), SEPARATOR).alias("stack")).agg(F.sum("v").alias(value))


def call_edges(df: DataFrame) -> DataFrame:
    """(caller, callee, count, callers): callers is the number of distinct callers of the callee."""
    r = df.where(F.size("frames") > 1).select(F.reverse("frames").alias("r"))
    pairs = r.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.struct(F.get(F.col("r"), i - 1).alias("caller"), F.get(F.col("r"), i).alias("callee")))).alias("e"))
    edges = pairs.groupBy("e.caller", "e.callee").agg(F.count("*").alias("count"))
    return edges.join(edges.groupBy("callee").agg(F.count("*").alias("callers")), "callee").select("caller", "callee", "count", "callers")


def profile(df: DataFrame, top_down: bool, buckets: int, least_percent: float) -> DataFrame:
    """Nodes of the tree with total, self, counts by time bucket and by thread, and a pattern, in depth-first order by falling total.

    Nodes below least_percent of all samples are left out after the counts, not on the way.
    """
    df = df.where(F.size("frames") > 0)
    bounds = df.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("all"))
    d = df.select((F.reverse("frames") if top_down else F.col("frames")).alias("f"), "t", "thread").crossJoin(F.broadcast(bounds))  # one row
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("t") - F.col("lo")).cast("decimal(38,0)") * (buckets - 1) / (F.col("hi") - F.col("lo")))).otherwise(0).cast("int")
    d = d.groupBy("f", part.alias("b"), "thread", "all").agg(F.count("*").alias("n"))
    nodes = d.select(F.explode(prefixes(F.col("f"))).alias("path"), F.size("f").alias("size"), "b", "thread", "all", "n")
    own = F.sum(F.when(F.size("path") == F.col("size"), F.col("n")).otherwise(0))
    counts = nodes.groupBy("path", "all").agg(F.sum("n").alias("total"), own.alias("self"), F.array(*(F.sum(F.when(F.coalesce("b", F.lit(0)) == i, F.col("n")).otherwise(0)) for i in range(buckets))).alias("timeBuckets"))
    threads = nodes.groupBy("path", "thread").agg(F.sum("n").alias("k")).groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("thread", "k")))).alias("threadCounts"))
    kept = counts.where(F.col("total") * 100 >= F.col("all") * least_percent).join(threads, "path")
    ranked = kept.select(F.col("path").alias("_p"), F.struct((-F.col("total")).alias("t"), F.element_at("path", -1).alias("n")).alias("_key"))
    steps = kept.select("path", F.explode(prefixes(F.col("path"))).alias("_p")).join(ranked, "_p").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.size("_p").alias("d"), "_key"))), lambda x: x["_key"]).alias("order"))
    mean = F.aggregate("timeBuckets", F.lit(0.0), lambda a, x: a + x) / buckets
    spread = F.sqrt(F.aggregate("timeBuckets", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / buckets)
    out = kept.join(steps, "path")
    return out.select("order", F.array_join("path", SEPARATOR).alias("path"), F.element_at("path", -1).alias("name"), F.size("path").alias("depth"), "total", "self", (F.col("total") * 100.0 / F.col("all")).alias("pct"), "timeBuckets", "threadCounts", F.when(spread / mean < 0.5, "steady").otherwise("bursty").alias("pattern"))
