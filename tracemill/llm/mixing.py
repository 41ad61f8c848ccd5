"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source is a circular stream of its documents in a shuffled order, cut into blocks of equal size (its
last block may be short). A slot of the mix is a van der Corput point mapped through the cumulative target
shares to a source; the slot's rank within its source names the block that it takes. Everything is
DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

BLOCK = 1024
#: Consecutive slots, or documents of like hash, that one window partition ranks.
SLOT_RUN = 1 << 14
DOC_RUN = 1 << 12
POINT_BITS = 52


def van_der_corput(i: Column) -> Column:
    """The i-th point of the base-2 sequence in [0, 1): i's bits behind the point, in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), POINT_BITS, "0")), 2, 10).cast("double") / float(1 << POINT_BITS)


def word_count(text: Column) -> Column:
    """Words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple = (5, 2, 1), limit: int = 3) -> DataFrame:
    """(n, source, source_size, target) from (source, size): shares of the total by weight, none above limit times its source's size.

    Sources in code-point order, null last, weigh as `cycle` repeats. Excess over a limit is reshared by
    weight among the others. With sources by rising limit / weight, the k-th is at its limit exactly if
    what the earlier ones leave, spread over the remaining weight, is as much a unit of weight. One row a
    source: the table's size is the number of sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("n", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (F.pmod("n", F.lit(len(cycle))) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    whole = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", F.greatest(F.lit(0.0), F.col("left") / F.col("weights")))
    per = per.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return per.select("n", "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def quotas(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """source_targets() with the slots that each source fills: a slot for each block of its whole passes and of its last part."""
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("want", F.round("target").cast("long"))
    t = t.withColumn("passes", F.floor(F.col("want") / F.col("source_size"))).withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
    t = t.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).where("slots > 0")
    t = t.withColumn("upto", F.sum("slots").over(Window.orderBy("n"))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    return t.withColumn("high", F.col("upto") / F.col("all_slots")).withColumn("low", (F.col("upto") - F.col("slots")) / F.col("all_slots")).drop("upto")


def schedule(quota: DataFrame, n_slots: int, block: int = BLOCK) -> DataFrame:
    """(slot, n, rank, block, length): the order of the mix; slot k takes `length` words of a block of source n.

    Point k of the sequence falls into the interval of one source's share; the interval is found by an
    equi-join on grid cells. Ranks are window ranks within runs of slots on top of the summed counts of
    the earlier runs, so no source's slots meet in one task. Ranks beyond a source's quota are dropped;
    ranks that the points did not reach follow at the end of the mix.
    """
    grid = 1024
    cells = quota.select("n", "slots", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))).alias("cell"))
    points = quota.sparkSession.range(n_slots).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("x")).withColumn("cell", F.floor(F.col("x") * grid))
    hit = points.join(cells, "cell").where("x >= low AND x < high").select("slot", "n", "slots", F.floor(F.col("slot") / SLOT_RUN).alias("run"))
    runs = hit.groupBy("n", "run").agg(F.count("*").alias("k")).withColumn("base", F.sum("k").over(Window.partitionBy("n").orderBy("run")) - F.col("k"))
    ranked = hit.withColumn("at", F.row_number().over(Window.partitionBy("n", "run").orderBy("slot")) - 1).join(runs, ["n", "run"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("at")).where("rank < slots").select("slot", "n", "rank")
    got = runs.groupBy("n").agg(F.sum("k").alias("got"))
    late = quota.join(got, "n", "left").where("coalesce(got, 0) < slots").select("n", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("slots") - 1)).alias("rank"))
    late = late.select((F.lit(n_slots) + F.col("rank")).alias("slot"), "n", "rank")
    all_ = ranked.unionByName(late).join(quota.select("n", "blocks", "slots", "rest", "source_size"), "n")
    at = F.pmod(F.col("rank"), F.col("blocks"))
    short = F.least(F.lit(block).cast("long"), F.col("source_size") - at * block)
    trim = F.col("rest") - F.floor((F.col("rest") - 1) / block) * block
    return all_.select("slot", "n", "rank", at.alias("block"), F.when((F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0), trim).otherwise(short).alias("length"))


def mix(docs: DataFrame, cycle: tuple = (5, 2, 1), limit: int = 3, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken, slots): one row per input row; taken counts repeats.

    Quotas fix how much of each source is taken, the points in which order: slots has the slots of the mix
    that take the document, from its first word that any takes, in order; `limit` + 1 at most, and none
    for a document that is not taken. Null texts and texts without words have size 0 and are never taken; a null source is a source, the
    last in order. Repeated rows are rows like any other. An empty table gives an empty result. The order
    of a source's documents is that of a hash of their ids, so reruns agree.
    """
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    targets = cut(source_targets(sizes, cycle, limit))
    quota = cut(quotas(targets, block))
    n_docs = sizes.count()
    first = quota.select("all_slots").first()
    slots = schedule(quota, first[0] if first else 0, block)
    takes = slots.join(quota.select("n", "source_size"), "n").withColumn("full", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block))
    short = F.col("length") < F.col("full")
    takes = takes.groupBy("n", "block").agg(F.sum((~short).cast("long")).alias("times"), F.sum(F.when(short, F.col("length")).otherwise(0)).alias("part"), F.collect_list(F.when(~short, F.col("slot"))).alias("whole"), F.collect_list(F.when(short, F.col("slot"))).alias("last"))

    d = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select("doc_id", sizes.source, "size", "n", "source_size", "target")
    d = d.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).withColumn("run", F.pmod(F.xxhash64("h"), F.lit(n_docs // DOC_RUN + 1)))
    worded = d.where("size > 0")
    runs = worded.groupBy("n", "run").agg(F.sum("size").alias("k")).withColumn("base", F.sum("k").over(Window.partitionBy("n").orderBy("run")) - F.col("k"))
    within = Window.partitionBy("n", "run").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = worded.withColumn("upto", F.sum("size").over(within)).join(runs.select("n", "run", "base"), ["n", "run"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
    keys = ["doc_id", "source", "size", "source_size", "target", "n", "start"]
    pieces = placed.select(*keys, F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long"))
    words = F.coalesce("times", F.lit(0)) * (high - low) + F.greatest(F.lit(0), F.least(high, F.coalesce("part", F.lit(0))) - low)
    no_slots = F.array().cast("array<bigint>")
    by = F.sort_array(F.concat(F.coalesce("whole", no_slots), F.when(low < F.coalesce("part", F.lit(0)), F.col("last")).otherwise(no_slots)))
    taken = pieces.join(takes, ["n", "block"], "left").select(*keys, "block", words.alias("words"), by.alias("by"))
    taken = taken.groupBy(*keys).agg(F.sum("words").cast("long").alias("taken"), F.min(F.when(F.size("by") > 0, F.struct("block", "by"))).alias("first")).withColumn("slots", F.coalesce("first.by", no_slots))
    out = ["doc_id", "source", "size", "source_size", "target", "taken", "slots"]
    none = d.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("slots", no_slots)
    return taken.select(*out).union(none.select(*out)).withColumnsRenamed({"doc_id": id_col, "source": source_col})


def mixed_documents(docs: DataFrame, cycle: tuple = (5, 2, 1), limit: int = 3) -> DataFrame:
    """`docs` as the mix has them, in the order of its slots: each row as often as the mix takes its words, rounded to whole documents.

    Rows that share a doc_id are taken alike, as often as that of them which is taken most.
    """
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    taken = mix(docs, cycle, limit).groupBy("doc_id").agg(F.max(F.struct(times.alias("copies"), "slots")).alias("t")).where("t.copies > 0").select(F.col("doc_id").alias("taken_id"), "t.copies", "t.slots")
    places = F.transform(F.sequence(F.lit(1).cast("long"), F.col("copies")), lambda k: F.get("slots", (F.least(k, F.size("slots")) - 1).cast("int")))
    kept = docs.join(taken, docs.doc_id.eqNullSafe(taken.taken_id)).select(*(docs[c] for c in docs.columns), F.explode(places).alias("mix_slot"))
    return kept.orderBy("mix_slot", docs.doc_id).drop("mix_slot")
