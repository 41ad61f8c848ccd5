"""Left outer joins that add the first matching event of another type as a struct `$decorator`."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECORATOR = "$decorator"
HIDDEN = ("_file", "_ord", "_type")
#: Widths of time buckets in nanoseconds are powers of BASE. A span's level is the least whose width holds it, so it touches two buckets there at most.
BASE, LEAST_LEVEL = 16, 3


def exposed(other: DataFrame, fields: list) -> Column:
    names = fields or [c for c in other.columns if c not in HIDDEN]
    have = set(other.columns)
    return F.struct(*((F.col(f"`{n}`") if n in have else F.lit(None).cast("string")).alias(n) for n in names))


def by_key(df: DataFrame, other: DataFrame, key: Column, other_key: Column, fields: list) -> DataFrame:
    """The decorator of an equal key that comes first in `other`; null keys match nothing.

    One row a key is left of `other` before the join, by an aggregation with map-side combine, so a hot key
    joins one row to each of its events.
    """
    first = other.select(other_key.alias("_k"), exposed(other, fields).alias("_d"), arrival(other).alias("_o")).where("_k IS NOT NULL").groupBy("_k").agg(F.min_by("_d", "_o").alias(DECORATOR))
    return df.withColumn("_key", key).join(first, F.col("_key") == F.col("_k"), "left").drop("_key", "_k")


def arrival(df: DataFrame) -> Column:
    """The place of a row in the order of arrival, which names it."""
    own = [c for c in HIDDEN if c in df.columns]
    return F.struct(*own) if own else F.monotonically_increasing_id()


def level(start: Column, end: Column) -> Column:
    span = F.greatest(end - start, F.lit(1).cast("long"))
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log(span.cast("double")) / math.log(BASE) + 1e-9)).cast("int")


def dealt(df: DataFrame, start: str, end: str, levels: list) -> DataFrame:
    """`df` by its level `_l` and by each bucket `_b` at the levels `_at` from its own up that `levels` has."""
    at = F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("_l"))
    df = df.withColumn("_l", level(F.col(start), F.col(end))).withColumn("_at", F.explode(at))
    width = F.pow(F.lit(float(BASE)), F.col("_at")).cast("long")
    first, last = (F.floor(F.col(c) / width) for c in (start, end))
    return df.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))


def by_time(df: DataFrame, other: DataFrame, key: Column, other_key: Column, span: tuple, other_span: tuple, fields: list) -> DataFrame:
    """The decorator of an equal thread whose time overlaps, the first by start: start < other end and end > other start.

    Spans are dealt to time buckets, so a thread with many events is joined bucket by bucket. A pair meets
    at the level of the longer of its spans, in the buckets that both touch, so long spans among short ones
    are in few buckets; the least start of a match decides, whichever bucket found it.
    """
    d = other.select(other_key.alias("_k"), other_span[0].alias("_ds"), (other_span[0] + other_span[1]).alias("_de"), exposed(other, fields).alias("_d"), arrival(other).alias("_o")).where("_k IS NOT NULL AND _ds IS NOT NULL")
    p = df.withColumn("_id", arrival(df)).withColumns({"_pk": key, "_ps": span[0], "_pe": span[0] + span[1]})
    probes = p.where("_pk IS NOT NULL AND _ps IS NOT NULL").select("_id", "_pk", "_ps", "_pe")
    found = [x.select(level(F.col(a), F.col(b)).alias("l")).distinct() for x, a, b in ((probes, "_ps", "_pe"), (d, "_ds", "_de"))]
    levels = sorted(r.l for r in found[0].union(found[1]).distinct().collect())  # 16 at most
    probes = dealt(probes, "_ps", "_pe", levels).withColumnsRenamed({"_l": "_pl", "_b": "_pb", "_at": "_pat"})
    build = dealt(d, "_ds", "_de", levels)
    met = (F.col("_pk") == F.col("_k")) & (F.col("_pat") == F.col("_at")) & (F.col("_pb") == F.col("_b")) & (F.col("_at") == F.greatest("_pl", "_l"))
    hit = probes.join(build, met & (F.col("_ps") < F.col("_de")) & (F.col("_pe") > F.col("_ds")))
    first = hit.groupBy("_id").agg(F.min_by("_d", F.struct("_ds", "_o")).alias(DECORATOR)).withColumnRenamed("_id", "_hit")
    return p.join(first, F.col("_id") == F.col("_hit"), "left").drop("_id", "_pk", "_ps", "_pe", "_hit")
