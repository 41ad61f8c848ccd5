"""Heap graphs: four tables, their row forms, and the operators on object graphs.

Loops run on the driver over DataFrames, with their lineage cut by reliable checkpoints in the shared
folder. Dominators of large graphs run as iterated distributed joins; a graph that fits is one task's work.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..plans.parser import QueryError
from . import dominators as dominators_of

PATTERN_CHARS = "*?"
#: Strong references and objects of a graph up to which one task finds dominators: some 300 bytes of its memory each.
ONE_TASK = 4_000_000


@dataclass
class Heap:
    """objects(id, class_id, shallow, array_length, string_value[, fields map<string, long> of primitive fields]), edges(src, dst, field, ord, strong), classes(class_id, name, super_id, instance_size, is_array), gcroots(type, object_id)."""

    objects: DataFrame
    edges: DataFrame
    classes: DataFrame
    gcroots: DataFrame
    derived: dict = field(default_factory=dict)

    @property
    def spark(self):
        return self.objects.sparkSession

    def kept(self, name: str, make) -> DataFrame:
        if name not in self.derived:
            self.derived[name] = cut(make())
        return self.derived[name]

    @property
    def strong(self) -> DataFrame:
        return self.edges.where("strong").select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")


def cut(df: DataFrame) -> DataFrame:
    """The same rows by a reliable checkpoint in spark.checkpoint.dir."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tracemill-"))
    return df.checkpoint(eager=True)


def subclasses(heap: Heap, name: str) -> DataFrame:
    """Ids of a class and of all below it, a level at a time."""
    level = heap.classes.where(F.translate("name", "/", ".") == name.replace("/", ".")).select("class_id")
    found = cut(level)
    level = found
    while level.take(1):
        level = cut(heap.classes.join(level.select(F.col("class_id").alias("super_id")), "super_id").select("class_id").join(found, "class_id", "left_anti"))
        found = found.union(level)
    return found.distinct()


def root_rows(heap: Heap, query) -> DataFrame:
    """Rows of a query's root."""
    from ..plans.compiler import mentions

    name = query.types[0] if query.types else None
    wants = mentions(query, {"retained", "retainedSize"}) or any(op.name in ("dominators", "retainedBreakdown", "retentionPaths", "whatif", "checkLeaks") for op in query.ops)
    if query.root == "classes":
        counts = heap.objects.groupBy("class_id").agg(F.count("*").alias("instanceCount"))
        c = heap.classes.join(counts, "class_id", "left")
        out = c.select(F.col("class_id").alias("_ord"), F.col("class_id").alias("id"), "name", F.element_at(F.split(F.translate("name", "/", "."), r"\."), -1).alias("simpleName"), F.coalesce("instanceCount", F.lit(0).cast("long")).alias("instanceCount"), F.col("instance_size").alias("instanceSize"), F.col("is_array").alias("isArray"))
        return out.where(class_match(F.col("name"), name)) if name else out
    objects = object_rows(heap, wants)
    if query.root == "gcroots":
        r = heap.gcroots.where(F.col("type") == name) if name else heap.gcroots
        cols = ["shallowSize", *(["retainedSize"] if wants else [])]
        o = objects.select(F.col("id").alias("objectId"), F.col("className").alias("object"), *cols)
        return r.withColumnRenamed("object_id", "objectId").join(o, "objectId", "left").select(F.col("objectId").alias("_ord"), "type", "objectId", "object", *cols)
    if query.root == "objects":
        if name and query.options.get("instanceof"):
            ids = objects_of(heap, subclasses(heap, name))
            return objects.join(ids, "id", "left_semi")
        return objects.where(class_match(F.col("className"), name)) if name else objects
    if query.root == "ages":
        out = ages(heap, objects)
        return out.where(class_match(F.col("className"), name)) if name else out
    if query.root == "clusters":
        return clusters(heap)
    depth = query.options.get("depth")
    return duplicates(heap, int(depth.value) if depth is not None else 3)


def objects_of(heap: Heap, classes: DataFrame) -> DataFrame:
    return heap.objects.join(classes, "class_id", "left_semi").select("id")


def class_match(name, pattern: str):
    own, want = F.translate(name, "/", "."), pattern.replace("/", ".")
    return C.full_match(own, C.glob_pattern(want)) if any(x in want for x in PATTERN_CHARS) else own == want


def object_rows(heap: Heap, retained: bool = False) -> DataFrame:
    names = heap.classes.select("class_id", F.col("name").alias("className"))
    o = heap.objects.join(names, "class_id", "left").select(F.col("id").alias("_ord"), "id", "className", F.col("shallow").alias("shallowSize"), F.col("array_length").alias("arrayLength"), F.col("string_value").alias("stringValue"))
    return o.join(retained_sizes(heap), "id", "left") if retained else o


# traversals
def depths(heap: Heap) -> DataFrame:
    """(id, depth, parent, root) of each object that a root reaches: breadth first from all roots; of equal depths the least parent counts."""

    def make():
        ids = heap.objects.select("id")
        roots = heap.gcroots.select(F.col("object_id").alias("id")).where("id IS NOT NULL").distinct().join(ids, "id", "left_semi")
        front = cut(roots.select("id", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent"), F.col("id").alias("root")))
        seen, d = front, 0
        while front.take(1):
            d += 1
            step = front.select(F.col("id").alias("src"), "root").join(heap.strong, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("src", "root")).alias("p"))
            front = cut(step.join(seen, "id", "left_anti").join(ids, "id", "left_semi").select("id", F.lit(d).alias("depth"), F.col("p.src").alias("parent"), F.col("p.root").alias("root")))
            seen = cut(seen.union(front)) if d % 8 == 0 else seen.union(front)
        return seen

    return heap.kept("depths", make)


def dominators(heap: Heap) -> DataFrame:
    """(id, idom, chain) of reached objects; 0 is the virtual root above all roots.

    Graphs of up to ONE_TASK rows are one task's work. In larger ones every object carries its chain of dominators; a chain is the common prefix of its predecessors' chains
    and itself, renewed in rounds until nothing changes. Chains only shorten after they are first set, so
    the rounds end; each is a join on edges and an aggregation with map-side combine.
    """

    def make():
        if one_task(heap):
            return tree_rows(heap, True)
        reached = depths(heap)
        into = heap.strong.join(reached.select(F.col("id").alias("src")), "src", "left_semi").join(reached.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst").select("src", "dst")
        roots = reached.where("depth = 0").select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
        e = cut(into.union(roots).distinct())
        top = heap.spark.createDataFrame([(0, [0])], "id long, chain array<long>")
        chains = cut(path_chains(reached).union(top))
        while True:
            offered = e.join(chains.select(F.col("id").alias("src"), "chain"), "src").select(F.col("dst").alias("id"), "chain")
            common = offered.groupBy("id").agg(F.min("chain").alias("a"), F.max("chain").alias("b"))  # the common prefix of all is that of the least and the greatest
            same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.when(F.slice("a", 1, i) == F.slice("b", 1, i), i)), lambda i: i.isNotNull()))
            new = cut(common.select("id", F.concat(F.slice("a", 1, same), F.array("id")).alias("chain")).union(top))
            changed = new.join(chains.withColumnRenamed("chain", "was"), "id").where("chain <> was").take(1)
            chains = new
            if not changed:
                return chains.where("id <> 0").select("id", F.get("chain", F.size("chain") - 2).alias("idom"), "chain")

    return heap.kept("dominators", make)


def one_task(heap: Heap) -> bool:
    if "one_task" not in heap.derived:
        heap.derived["one_task"] = heap.strong.count() + heap.objects.count() <= ONE_TASK
    return heap.derived["one_task"]


def tree_rows(heap: Heap, chains: bool) -> DataFrame:
    """(id, idom, retainedSize) of reached objects, and with `chains` their chains of dominators, by one task over the whole graph."""
    blank = F.lit(None).cast("long")
    rows = heap.strong.select("src", "dst", blank.alias("size"))
    rows = rows.union(heap.gcroots.where("object_id IS NOT NULL").select(blank, "object_id", blank)).union(heap.objects.select("id", blank, F.coalesce(F.col("shallow").cast("long"), F.lit(0).cast("long"))))
    schema = "id long, idom long, retainedSize long" + (", chain array<long>" if chains else "")

    def run(batches):
        held = pa.Table.from_batches([*batches]).combine_chunks() if (batches := [b for b in batches if b.num_rows]) else None
        if held is None:
            return
        src, dst, size = held.columns
        edge, root = pc.and_(src.is_valid(), dst.is_valid()), src.is_null()
        of = lambda column, mask: column.filter(mask).to_numpy()
        ids, idoms, sizes, up = dominators_of.tree(of(src, size.is_valid()), of(size, size.is_valid()), of(src, edge), of(dst, edge), of(dst, root))
        known: dict = {0: [0]}
        for at in range(1, len(ids), 10_000):
            part = slice(at, at + 10_000)
            columns = [pa.array(x[part]) for x in (ids, idoms, sizes)]
            if chains:
                for i in range(at, min(at + 10_000, len(ids))):
                    known[i] = [*known[int(up[i])], int(ids[i])]
                columns.append(pa.array([known[i] for i in range(at, min(at + 10_000, len(ids)))], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return rows.coalesce(1).mapInArrow(run, schema)


def path_chains(reached: DataFrame) -> DataFrame:
    """(id, chain): the shortest path from the virtual root to each object."""
    out = cut(reached.where("depth = 0").select("id", F.array(F.lit(0).cast("long"), F.col("id")).alias("chain")))
    level, d = out, 0
    while level.take(1):
        d += 1
        level = cut(reached.where(F.col("depth") == d).join(level.select(F.col("id").alias("parent"), "chain"), "parent").select("id", F.concat("chain", F.array("id")).alias("chain")))
        out = out.union(level)
    return out


def retained_sizes(heap: Heap) -> DataFrame:
    """(id, retainedSize): an object's own size and those of all that it dominates; unreached objects retain themselves."""

    def make():
        if one_task(heap):
            summed = tree_rows(heap, False).select("id", F.col("retainedSize").alias("r"))
            return heap.objects.select("id", "shallow").join(summed, "id", "left").select("id", F.coalesce("r", "shallow").cast("long").alias("retainedSize"))
        chain = dominators(heap).select("id", "chain").join(heap.objects.select("id", "shallow"), "id")
        summed = chain.select(F.explode("chain").alias("id"), "shallow").groupBy("id").agg(F.sum("shallow").alias("r"))
        return heap.objects.select("id", "shallow").join(summed, "id", "left").select("id", F.coalesce("r", "shallow").cast("long").alias("retainedSize"))

    return heap.kept("retained", make)


def approximate_retained(heap: Heap) -> DataFrame:
    """(id, retainedSize) as a walk that does not go beyond objects with more than one reference into them: those count once a start."""

    def make():
        e = heap.strong.join(heap.objects.select(F.col("id").alias("dst")), "dst", "left_semi")
        inbound = e.groupBy("dst").agg(F.count("*").alias("n"))
        open_ = heap.objects.select("id").join(inbound.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.coalesce("n", F.lit(0)) <= 1).alias("open"))
        reach = cut(heap.objects.select(F.col("id").alias("start"), "id"))
        front = reach
        while front.take(1):
            step = front.join(open_.where("open").select("id"), "id").select("start", F.col("id").alias("src")).join(e, "src").select("start", F.col("dst").alias("id")).distinct()
            front = cut(step.join(reach, ["start", "id"], "left_anti"))
            reach = cut(reach.union(front))
        return reach.join(heap.objects.select("id", "shallow"), "id").groupBy(F.col("start").alias("id")).agg(F.sum("shallow").cast("long").alias("retainedSize"))

    return heap.kept("approximate", make)


# derived roots
def ages(heap: Heap, objects: DataFrame) -> DataFrame:
    """Objects with an estimated age: by the kind of their root, how many refer to them and how near a root they are."""
    #: Points by the type of the root; others and none have 10.
    points = {"STICKY_CLASS": 30, "JNI_GLOBAL": 25, "THREAD_OBJ": 5, "JAVA_FRAME": 0, "JNI_LOCAL": 0}
    kinds = heap.gcroots.groupBy(F.col("object_id").alias("root")).agg(F.min("type").alias("kind"))
    inbound = heap.edges.where("dst IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"))
    d = depths(heap).join(kinds, "root", "left").select("id", "depth", "kind")
    o = objects.join(inbound, "id", "left").join(d, "id", "left")
    kind, refs, depth = F.coalesce("kind", F.lit("UNKNOWN")), F.coalesce("inbound", F.lit(0)), F.coalesce("depth", F.lit(0))
    point = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in points.items() for x in kv)), kind), F.lit(10))
    by_refs, by_depth = F.least(F.lit(25), 2 * refs), F.greatest(F.lit(0), 10 - depth)
    age = F.least(F.lit(100), point + by_refs + by_depth).cast("long")
    bucket = F.when(age <= 25, "ephemeral").when(age <= 50, "medium").when(age <= 75, "tenured").otherwise("permanent")
    signals = F.format_string("root:%s:+%d,refs:%d:+%d,depth:%d:+%d", kind, point, refs, by_refs, depth, by_depth)
    return o.withColumns({"estimatedAge": age, "ageBucket": bucket, "ageSignals": signals}).drop("inbound", "depth", "kind")


def clusters(heap: Heap, rounds: int = 20) -> DataFrame:
    """Groups of objects by synchronous label propagation over references both ways; ties go to the lesser label, single objects are left out."""

    def make():
        both = cut(heap.strong.union(heap.strong.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
        labels = cut(heap.objects.select("id", F.col("id").alias("label")))
        n = labels.count()
        for _ in range(rounds):
            votes = both.join(labels.withColumnsRenamed({"id": "dst"}), "dst").select(F.col("src").alias("id"), "label").union(labels).groupBy("id", "label").agg(F.count("*").alias("k"))
            new = cut(votes.groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("k"), "label")).alias("b")).select("id", F.col("b.label").alias("label")))
            moved = new.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").count()
            labels = new
            if moved < max(1, n // 1000):
                break
        return labels

    labels = heap.kept("labels", make)
    rows = labels.join(object_rows(heap), "id")
    names = rows.groupBy("label", "className").agg(F.sum("shallowSize").alias("s")).groupBy("label").agg(F.max_by("className", F.struct("s", "className")).alias("dominantClass"))
    anchors = labels.join(heap.gcroots.groupBy(F.col("object_id").alias("id")).agg(F.min("type").alias("type")), "id").groupBy("label").agg(F.count("*").alias("rootPathCount"), F.min(F.struct("id", "type")).alias("a"))
    per = rows.groupBy("label").agg(F.count("*").alias("objectCount"), F.sum("shallowSize").alias("retainedSize")).where("objectCount > 1")
    out = per.join(names, "label").join(anchors, "label", "left")
    paths = F.coalesce("rootPathCount", F.lit(0).cast("long"))
    return out.select(F.col("label").alias("_ord"), F.col("label").alias("id"), "objectCount", "retainedSize", paths.alias("rootPathCount"), (F.col("retainedSize") / F.greatest(paths, F.lit(1))).alias("score"), "dominantClass", F.col("a.type").alias("anchorType"), F.col("a.id").alias("anchorObject"))


def fingerprints(heap: Heap, depth: int) -> DataFrame:
    """(id, fingerprint, nodeCount): a structural hash of each object's references down to a depth; a child counts by its class at the last level."""

    def make():
        base = heap.objects.select("id", F.xxhash64("class_id", "shallow").alias("own"))
        level = cut(base.select("id", F.col("own").alias("h"), F.lit(1).cast("long").alias("n")))
        e = heap.edges.where("strong").select("src", "dst", F.coalesce("field", F.lit("")).alias("field"), F.coalesce("ord", F.lit(0)).alias("o"))
        for _ in range(depth):
            child = e.join(level.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.xxhash64("field", "o", "h").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("k"))
            level = cut(base.join(child, "id", "left").select("id", F.when(F.col("s").isNull(), F.col("own")).otherwise(F.xxhash64("own", "s")).alias("h"), (1 + F.coalesce("k", F.lit(0))).cast("long").alias("n")))
        return level.select("id", F.col("h").alias("fingerprint"), F.col("n").alias("nodeCount"))

    return heap.kept(f"fingerprints{depth}", make)


def duplicates(heap: Heap, depth: int = 3) -> DataFrame:
    rows = fingerprints(heap, depth).join(object_rows(heap), "id")
    per = rows.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("className").alias("rootClass"), F.min("shallowSize").alias("uniqueSize"), F.min("nodeCount").alias("nodeCount"), F.min("id").alias("id")).where("copies > 1")
    return per.select(F.col("id").alias("_ord"), "id", "rootClass", F.lower(F.hex("fingerprint")).alias("fingerprint"), "copies", "uniqueSize", ((F.col("copies") - 1) * F.col("uniqueSize")).alias("wastedBytes"), F.lit(depth).alias("depth"), "nodeCount")


# operators
def operators(session) -> dict:
    """The heap dialect's own operators, by name."""
    heap: Heap = session.heap

    def plain(op, name, default, at=None):
        from ..plans.compiler import option

        return option(op, name, default, at)

    def path_to_root(rows, op):
        """Steps from a root to each input object: (id of the object, step, id, class, shallow)."""
        chains = heap.kept("chains", lambda: path_chains(depths(heap)))
        names = object_rows(heap).select("id", F.col("className").alias("class"), F.col("shallowSize").alias("shallow"))
        steps = rows.df.select(F.col("id").alias("object")).distinct().join(chains, F.col("object") == F.col("id")).select("object", F.posexplode(F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(1)))).alias("step", "id"))
        return rows.to(steps.join(names, "id").select("object", "step", "id", "class", "shallow"), (C.Key(F.col("object")), C.Key(F.col("step"))), sorted=True)

    def retention_paths(rows, op):
        """Paths of class names from roots to the input objects, counted."""
        chains = heap.kept("chains", lambda: path_chains(depths(heap)))
        names = object_rows(heap).select("id", F.translate("className", "/", ".").alias("class"))
        own = rows.df.select("id", "retainedSize")
        steps = own.join(chains, "id").select(F.col("id").alias("object"), "retainedSize", F.posexplode(F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(1)))).alias("step", "id"))
        path = steps.join(names, "id").groupBy("object", "retainedSize").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "class"))), lambda x: x["class"]).alias("p"))
        out = path.groupBy("p").agg(F.count("*").alias("count"), F.sum("retainedSize").alias("retainedSize"))
        return rows.to(out.select(F.element_at("p", 1).alias("gcRoot"), F.element_at("p", -1).alias("leaf"), "count", F.size("p").alias("depth"), "retainedSize", F.array_join("p", " → ").alias("path")), (C.Key(F.col("count"), True), C.Key(F.col("path"))), sorted=True)

    def dominator_rows(rows, op):
        kind, by = plain(op, "view", None, 0), plain(op, "groupBy", None)
        least = int(plain(op, "minRetained", 1 << 20))
        all_ = object_rows(heap, True)
        if by in ("class", "className", "package"):
            name = F.translate("className", "/", ".")
            key = name if by != "package" else F.regexp_replace(name, r"\.?[^.]*$", "")
            out = all_.groupBy(key.alias(by if by != "className" else "class")).agg(F.count("*").alias("count"), F.sum("shallowSize").alias("shallowSize"), F.sum("retainedSize").alias("retainedSize")).where(F.col("retainedSize") >= least)
            return rows.to(out, (C.Key(F.col("retainedSize"), True),), sorted=True)
        if kind == "objects":
            d = dominators(heap).select("id", F.col("idom").alias("dominator"))
            own = rows.df.select(F.col("id").alias("dominator"), F.col("className").alias("dominatorClass"))
            return rows.to(all_.join(d, "id").join(own, "dominator"), (C.Key(F.col("retainedSize"), True), C.Key(F.col("id"))), sorted=True)
        if kind == "tree":
            d = dominators(heap).select("id", F.col("idom").alias("dominator"))
            level, out = rows.df.select("id"), None
            for _ in range(3):
                kids = d.join(level.withColumnRenamed("id", "dominator"), "dominator", "left_semi")
                out = kids if out is None else out.union(kids)
                level = kids.select("id")
            sizes = out.distinct().join(all_.select("id", "retainedSize"), "id").groupBy("dominator").agg(F.count("*").alias("dominatedCount"), F.sum("retainedSize").alias("retainedSize"))
            return rows.to(sizes.join(all_.select(F.col("id").alias("dominator"), F.col("className").alias("dominatorClass")), "dominator"), (C.Key(F.col("retainedSize"), True), C.Key(F.col("dominator"))), sorted=True)
        big = rows.df.where(F.col("retainedSize") >= least)
        big = big if big.take(1) else rows.df
        big = big.orderBy(F.col("retainedSize").desc(), "id").limit(10)
        chains = heap.kept("chains", lambda: path_chains(depths(heap)))
        names = object_rows(heap).select("id", F.translate("className", "/", ".").alias("class"))
        steps = big.select(F.col("id").alias("object")).join(chains, F.col("object") == F.col("id")).select("object", F.posexplode(F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(1)))).alias("step", "id"))
        paths = steps.join(names, "id").groupBy(F.col("object").alias("_o")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "class"))), lambda x: x["class"]).alias("_p"))
        big = big.join(paths, F.col("id") == F.col("_o")).where(F.size("_p") >= 2).withColumn("gcRootPath", F.array_join("_p", " → ")).drop("_o", "_p")
        return rows.to(big, (C.Key(F.col("retainedSize"), True), C.Key(F.col("id"))), sorted=True)

    def breakdown(rows, op):
        """What the input objects dominate down to a depth, by depth and class."""
        deep = int(plain(op, "depth", 4, 0))
        if "instanceCount" in rows.df.columns:
            own = heap.objects.join(rows.df.select(F.col("id").alias("class_id")), "class_id", "left_semi").select("id")
        else:
            own = rows.df.select("id")
        below = dominators(heap).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("chain")), lambda i: F.struct(F.get("chain", i - 1).alias("above"), (F.size("chain") - i).alias("depth")))).alias("a")).select("id", "a.above", "a.depth").where(F.col("depth") <= deep)
        hit = below.join(own.withColumnRenamed("id", "above"), "above", "left_semi").join(object_rows(heap, True), "id")
        return rows.to(hit.groupBy("depth", F.col("className").alias("class")).agg(F.count("*").alias("count"), F.sum("shallowSize").alias("shallowSize"), F.sum("retainedSize").alias("retainedSize")), (C.Key(F.col("depth")), C.Key(F.col("retainedSize"), True), C.Key(F.col("class"))), sorted=True)

    def thread_owner(rows, op):
        """The name of the thread whose object dominates an object, "shared" where none does."""
        threads = thread_names(heap)
        owned = dominators(heap).select("id", F.explode("chain").alias("t")).join(threads, "t").groupBy("id").agg(F.min_by("name", "t").alias("ownerThread"))
        return rows.keep(rows.df.join(owned, "id", "left").withColumn("ownership", F.when(F.col("ownerThread").isNotNull(), "exclusive").otherwise("shared")).withColumn("ownerThread", F.coalesce("ownerThread", F.lit("shared"))))

    def dominated(rows, op):
        """What each root's object dominates."""
        own = dominators(heap).select(F.col("id").alias("x"), F.explode("chain").alias("objectId")).join(heap.objects.select(F.col("id").alias("x"), "shallow"), "x").groupBy("objectId").agg(F.sum("shallow").alias("dominated"), F.count("*").alias("dominatedCount"))
        named = thread_names(heap).select(F.col("t").alias("objectId"), F.col("name").alias("threadName"))
        return rows.keep(rows.df.join(own, "objectId", "left").join(named, "objectId", "left"))

    def what_if(rows, op):
        """What removing the input objects would free. Nested targets count twice in bytes, once in objects."""
        own = rows.df.select("id", "retainedSize")
        freed = own.agg(F.count("*").alias("targetCount"), F.coalesce(F.sum("retainedSize"), F.lit(0)).cast("long").alias("freedBytes"))
        below = dominators(heap).select(F.col("id").alias("x"), F.explode("chain").alias("id")).join(own, "id", "left_semi").agg(F.countDistinct("x").alias("freedObjects"))
        total = heap.objects.agg(F.coalesce(F.sum("shallow"), F.lit(0)).cast("long").alias("total"))
        out = freed.crossJoin(below).crossJoin(total)  # one row each
        return rows.to(out.select(F.lit("remove").alias("action"), "targetCount", "freedBytes", "freedObjects", F.round(100.0 * F.col("freedBytes") / F.greatest(F.col("total"), F.lit(1)), 1).alias("freedPct"), F.greatest(F.col("total") - F.col("freedBytes"), F.lit(0)).alias("remainingRetained")))

    def members(rows, op):
        """The objects of clusters or of duplicates."""
        if rows.context["root"] == "clusters":
            ids = heap.derived["labels"].join(rows.df.select(F.col("id").alias("label")), "label", "left_semi").select("id")
        else:
            depth = rows.df.select("depth").first()
            f = fingerprints(heap, int(depth[0]) if depth else 3)
            ids = f.withColumn("fingerprint", F.lower(F.hex("fingerprint"))).join(rows.df.select("fingerprint"), "fingerprint", "left_semi").select("id")
        return rows.to(object_rows(heap).join(ids, "id", "left_semi"), (C.Key(F.col("id")),))

    def diff(rows, op):
        """Left join with the same kind of rows of another session by a key; of equal keys there the first counts."""
        from ..plans.compiler import compile_query
        from ..plans.parser import parse

        other = session.variables[plain(op, "session", None)]
        root = rows.context["root"]
        key = plain(op, "by", {"classes": "name", "objects": "className", "gcroots": "type"}.get(root, "id"))
        if "root" in op.options:
            return allocations(rows, op, other, key)
        del compile_query
        base = root_rows(other.heap, parse(root))
        numeric = [f.name for f in base.schema.fields if C.is_number(f.dataType) and f.name not in ("_ord", key) and f.name in rows.df.columns]
        first = base.groupBy(F.col(key).alias("_k")).agg(*(F.min_by(n, "_ord").alias(f"baseline.{n}") for n in numeric), F.lit(True).alias("baseline.exists"))
        out = rows.df.join(first, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("baseline.exists", F.coalesce(F.col("`baseline.exists`"), F.lit(False)))
        return rows.keep(out.withColumns({f"{n}Delta": F.col(n) - F.coalesce(F.col(f"`baseline.{n}`"), F.lit(0)) for n in numeric}))

    def allocations(rows, op, other, key):
        """Heap rows with how often and where their class was allocated in a recording."""
        events = other.event_type(plain(op, "root", None))
        name = C.at_path(events.schema, ("objectClass", "name"))[0]
        a = events.select(normal_class(name).alias("_c"), F.col("weight").cast("double").alias("w"), C.as_text(*C.at_path(events.schema, ("stackTrace",))[:2]).alias("site"), F.col("startTime").alias("t") if "startTime" in events.columns else F.lit(None).cast("long").alias("t")).where("_c IS NOT NULL")
        span = a.agg(((F.max("t") - F.min("t")) / 1e9).alias("seconds"))
        per = a.groupBy("_c").agg(F.count("*").alias("allocCount"), F.sum("w").cast("long").alias("allocWeight"))
        sites = a.groupBy("_c", "site").agg(F.count("*").alias("k")).groupBy("_c").agg(F.max_by("site", F.struct("k", "site")).alias("topAllocSite"))
        out = rows.df.join(per.join(sites, "_c").crossJoin(span), normal_class(F.col(key)) == F.col("_c"), "left")
        out = out.withColumn("allocRate", F.when(F.col("seconds") > 0, F.col("allocCount") / F.col("seconds"))).drop("_c", "seconds")
        return rows.keep(out.withColumn("survivalRatio", F.col("instanceCount") / F.col("allocCount")) if "instanceCount" in rows.df.columns else out)

    def waste(rows, op):
        return rows.keep(collection_waste(heap, rows.df))

    def cache(rows, op):
        return rows.keep(cache_stats(heap, rows.df))

    def leaks(rows, op):
        if "filter" in op.options:
            raise QueryError("checkLeaks takes a detector's name; named queries as filters are not supported")
        return rows.to(check_leaks(heap, plain(op, "detector", "help", 0), op, plain), (), sorted=False)

    return {"pathToRoot": path_to_root, "retentionPaths": retention_paths, "dominators": dominator_rows, "retainedBreakdown": breakdown, "threadOwner": thread_owner, "dominatedSize": dominated, "whatif": what_if, "objects": members, "join": diff, "waste": waste, "cacheStats": cache, "checkLeaks": leaks, "estimateAge": lambda rows, op: rows.keep(ages(heap, rows.df))}


def thread_names(heap: Heap) -> DataFrame:
    """(t, name) of the objects of threads that are roots; without a text for its name a thread is named by its id."""
    threads = heap.gcroots.where("type = 'THREAD_OBJ'").select(F.col("object_id").alias("t")).distinct()
    texts = heap.edges.where("field = 'name'").select(F.col("src").alias("t"), F.col("dst").alias("id")).join(heap.objects.select("id", "string_value"), "id").groupBy("t").agg(F.min("string_value").alias("name"))
    return threads.join(texts, "t", "left").select("t", F.coalesce("name", F.concat(F.lit("Thread-0x"), F.lower(F.hex("t")))).alias("name"))


def normal_class(c):
    """Class names of either notation as dotted names; arrays as name[]."""
    s = F.translate(c, "/", ".")
    return F.when(s.rlike(r"^\[L.*;$"), F.concat(F.regexp_extract(s, r"^\[L(.*);$", 1), F.lit("[]"))).otherwise(s)


def field_of(heap: Heap, name: str):
    """A primitive field of objects, null where it is not known."""
    return F.try_element_at("fields", F.lit(name)) if "fields" in heap.objects.columns else F.lit(None).cast("long")


def tables_of(heap: Heap) -> DataFrame:
    """(id, capacity, used): the length of an object's backing array, and how many references leave the array."""
    backing = heap.edges.where(F.col("field").isin("table", "elementData", "elements")).select(F.col("src").alias("id"), F.col("dst").alias("_t"))
    lengths = heap.objects.where("array_length IS NOT NULL").select(F.col("id").alias("_t"), F.col("array_length").cast("long").alias("capacity"))
    used = heap.edges.where("dst IS NOT NULL").groupBy(F.col("src").alias("_t")).agg(F.count("*").alias("used"))
    return backing.join(lengths, "_t").join(used, "_t", "left").groupBy("id").agg(F.max("capacity").alias("capacity"), F.max(F.coalesce("used", F.lit(0).cast("long"))).alias("used"))


#: Collections with a backing array, and sets that hold a map.
BACKED = ("java.util.HashMap", "java.util.LinkedHashMap", "java.util.ArrayList", "java.util.concurrent.ConcurrentHashMap", "java.util.ArrayDeque")
SETS = ("java.util.HashSet", "java.util.LinkedHashSet")


def sized(heap: Heap) -> DataFrame:
    """(id, capacity, size) of objects with a backing array. Sizes are the objects' own fields where known, else counted references."""
    cells = heap.edges.where("field = 'counterCells'").select(F.col("src").alias("id"), F.col("dst").alias("src")).join(heap.edges.select("src", F.col("dst").alias("cell")), "src")
    more = cells.join(heap.objects.select(F.col("id").alias("cell"), field_of(heap, "value").alias("v")), "cell").groupBy("id").agg(F.sum("v").alias("cells"))
    o = heap.objects.select("id", field_of(heap, "size").alias("own"), field_of(heap, "baseCount").alias("base"), field_of(heap, "head").alias("head"), field_of(heap, "tail").alias("tail"))
    t = o.join(tables_of(heap), "id", "left").join(more, "id", "left").where("capacity IS NOT NULL OR own IS NOT NULL OR base IS NOT NULL")
    ring = F.when((F.col("capacity") > 0) & F.col("head").isNotNull(), F.pmod(F.col("tail") - F.col("head"), F.col("capacity")))
    size = F.coalesce("own", F.when(F.col("base").isNotNull(), F.greatest(F.col("base") + F.coalesce("cells", F.lit(0)), F.lit(0))), ring, "used", F.lit(0).cast("long"))
    return t.select("id", F.coalesce("capacity", F.lit(0).cast("long")).alias("capacity"), size.alias("size"))


def collection_waste(heap: Heap, df: DataFrame, ref_size: int = 8) -> DataFrame:
    """capacity, size, loadFactor, wastedBytes and wasteType of array-backed collections; null for other objects."""
    own = sized(heap)
    inner = heap.edges.where("field = 'map'").select(F.col("src").alias("id"), F.col("dst").alias("m")).join(own.withColumnRenamed("id", "m"), "m").select("id", F.col("capacity").alias("i_capacity"), F.col("size").alias("i_size"))
    name = F.translate("className", "/", ".")
    d = df.join(own, "id", "left").join(inner, "id", "left")
    pick = lambda a, b: F.when(name.isin(*BACKED), F.col(a)).when(name.isin(*SETS), F.col(b))
    d = d.withColumns({"capacity": pick("capacity", "i_capacity"), "size": pick("size", "i_size")}).drop("i_capacity", "i_size")
    wasted = (F.col("capacity") - F.col("size")) * ref_size
    kind = F.when(F.col("size") == 0, "emptyDefault").when(wasted > 0, "overCapacity").when(F.col("capacity").isNotNull(), "normal")
    return d.withColumns({"loadFactor": F.when(F.col("capacity") > 0, F.col("size") / F.col("capacity")).when(F.col("capacity").isNotNull(), 0.0), "wastedBytes": wasted, "wasteType": kind})


def cache_stats(heap: Heap, df: DataFrame) -> DataFrame:
    """entryCount, maxSize (-1 without a table), fillRatio, costPerEntry and isLruMode of objects with a size or a table."""
    tables = tables_of(heap).select("id", "capacity", "used")
    o = heap.objects.select("id", field_of(heap, "size").alias("_s"), field_of(heap, "accessOrder").alias("_lru")).join(tables, "id", "left").where("_s IS NOT NULL OR capacity IS NOT NULL")
    n = F.coalesce("_s", "used", F.lit(0).cast("long"))
    o = o.select("id", n.alias("entryCount"), F.coalesce("capacity", F.lit(-1).cast("long")).alias("maxSize"), "_lru")
    sizes = retained_sizes(heap).withColumnRenamed("retainedSize", "_r")
    d = df.join(o, "id", "left").join(sizes, "id", "left")
    out = {"fillRatio": F.when(F.col("maxSize") > 0, F.col("entryCount") / F.col("maxSize")).when(F.col("maxSize").isNotNull(), 0.0), "costPerEntry": F.when(F.col("entryCount") > 0, F.expr("_r div entryCount")).when(F.col("entryCount").isNotNull(), 0)}
    lru = (F.translate("className", "/", ".") == "java.util.LinkedHashMap") & (F.coalesce("_lru", F.lit(0)) != 0)
    return d.withColumns(out | {"isLruMode": F.when(F.col("maxSize").isNotNull(), lru)}).drop("_lru", "_r")


#: Classes that leak often.
LEAK_PRONE = ("java.lang.ThreadLocal", "java.lang.ThreadLocal$ThreadLocalMap", "java.lang.ThreadLocal$ThreadLocalMap$Entry", "java.lang.ClassLoader", "java.net.URLClassLoader", "java.util.concurrent.ConcurrentHashMap", "java.util.HashMap", "java.util.WeakHashMap", "java.lang.ref.WeakReference", "java.lang.ref.SoftReference")


def hybrid_dominators(heap: Heap, top_n: int = 100, patterns: tuple = (), least: int = 1 << 20) -> DataFrame:
    """dominators() of the part of the graph that leads to interesting objects: the top_n by approximate retained size, large ones of leak-prone classes, and those whose class matches a glob."""
    o = object_rows(heap).join(approximate_retained(heap), "id").withColumn("class", F.translate("className", "/", "."))
    wanted = o.orderBy(F.desc("retainedSize"), "id").limit(top_n).select("id").union(o.where(F.col("class").isin(*LEAK_PRONE) & (F.col("retainedSize") > least)).select("id"))
    for p in patterns:
        wanted = wanted.union(o.where(C.full_match(F.col("class"), C.glob_pattern(p.replace("/", ".")))).select("id"))
    part = front = cut(wanted.distinct())
    while front.take(1):
        front = cut(heap.strong.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id")).distinct().join(part, "id", "left_anti"))
        part = cut(part.union(front))
    ends = part.withColumnRenamed("id", "dst")
    edges = heap.edges.join(part.withColumnRenamed("id", "src"), "src", "left_semi").join(ends, "dst", "left_semi")
    return dominators(Heap(heap.objects.join(part, "id", "left_semi"), edges, heap.classes, heap.gcroots))


def all_paths(heap: Heap, target: int, max_depth: int = 10) -> DataFrame:
    """(path) of each simple path of at most max_depth steps from a root to an object, as an array of ids."""
    level = heap.gcroots.select(F.array("object_id").alias("path")).where("path[0] IS NOT NULL").distinct()
    found = level.where(F.element_at("path", -1) == target)
    for _ in range(max_depth):
        level = cut(level.where(F.element_at("path", -1) != target).withColumn("src", F.element_at("path", -1)).join(heap.strong.distinct(), "src").where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        found = found.union(level.where(F.element_at("path", -1) == target))
        if not level.take(1):
            break
    return found


LEAKS = ("duplicate-strings", "growing-collections", "threadlocal-leak", "classloader-leak", "listener-leak", "finalizer-queue")
#: Classes that grow.
COLLECTIONS = ("java.util.HashMap", "java.util.ArrayList", "java.util.LinkedList", "java.util.HashSet", "java.util.TreeMap", "java.util.LinkedHashMap", "java.util.concurrent.ConcurrentHashMap", "java.util.ArrayDeque", "java.util.Vector", "java.util.Hashtable")


def check_leaks(heap: Heap, detector: str, op, plain) -> DataFrame:
    """Rows of one detector; `help` lists them."""
    o = object_rows(heap, detector not in ("duplicate-strings", "listener-leak", "finalizer-queue", "help")).withColumn("class", F.translate("className", "/", "."))
    big = lambda least: F.col("retainedSize") >= int(plain(op, "minSize", least))
    own = [F.col("shallowSize").alias("shallow"), F.col("retainedSize").alias("retained")]
    if detector == "duplicate-strings":
        sizes = retained_sizes(heap).withColumnRenamed("retainedSize", "r")
        per = o.join(sizes, "id", "left").where("stringValue IS NOT NULL").groupBy("stringValue").agg(F.count("*").alias("count"), F.sum("shallowSize").alias("shallow"), F.sum("r").alias("retained"), F.min("shallowSize").alias("one")).where(F.col("count") >= int(plain(op, "threshold", 100)))
        hint = F.format_string("Intern the string or keep one: %d equal copies", "count")
        return per.select("count", F.substring("stringValue", 1, 100).alias("value"), "shallow", "retained", (F.col("shallow") - F.col("one")).alias("wastedBytes"), hint.alias("suggestion")).orderBy(F.col("wastedBytes").desc(), "value")
    if detector == "growing-collections":
        held = o.where(F.col("class").isin(*COLLECTIONS) & big(10 << 20)).join(sized(heap).select("id", F.col("size").alias("elementCount")), "id", "left")
        hint = F.concat(F.lit("Bound or clear the "), F.element_at(F.split("class", r"\."), -1))
        return held.select("class", "id", *own, "arrayLength", "elementCount", hint.alias("suggestion")).orderBy(F.col("retained").desc(), "id")
    if detector == "threadlocal-leak":
        held = o.where(F.col("class").rlike(r"^java\.lang\.ThreadLocal(\$ThreadLocalMap\$Entry)?$") & big(1 << 20))
        chains = heap.kept("chains", lambda: path_chains(depths(heap)))
        threads = o.where(F.col("class").rlike(r"(^|\.)\w*Thread$")).select(F.col("id").alias("step"))
        attached = held.select("id").join(chains, "id").select("id", F.explode("chain").alias("step")).join(threads, "step", "left_semi").select("id").distinct().withColumn("attachedToThread", F.lit(True))
        value = heap.edges.where("field = 'value'").select(F.col("src").alias("id"), F.col("dst").alias("v")).join(o.select(F.col("id").alias("v"), F.col("class").alias("c")), "v").groupBy("id").agg(F.min("c").alias("valueClass"))
        held = held.join(attached, "id", "left").join(value, "id", "left")
        return held.select("class", "id", *own, F.coalesce("attachedToThread", F.lit(False)).alias("attachedToThread"), "valueClass").orderBy(F.col("retained").desc(), "id")
    if detector == "classloader-leak":
        system = F.col("class").rlike(r"^(jdk\.internal|sun\.|java\.)")
        held = o.where(F.col("class").contains("Loader") & ~system & big(10 << 20))
        of = F.col("loader_id") if "loader_id" in heap.classes.columns else F.lit(None).cast("long")
        loaded = heap.classes.select(of.alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"))
        name = heap.edges.where("field = 'name'").select(F.col("src").alias("id"), F.col("dst").alias("v")).join(heap.objects.select(F.col("id").alias("v"), "string_value"), "v").groupBy("id").agg(F.min("string_value").alias("loaderName"))
        return held.join(loaded, "id", "left").join(name, "id", "left").select("class", "id", *own, "loaderName", F.coalesce("n", F.lit(0).cast("long")).alias("loadedClasses")).orderBy(F.col("retained").desc(), "id")
    if detector == "listener-leak":
        sizes = retained_sizes(heap).withColumnRenamed("retainedSize", "r")
        per = o.join(sizes, "id", "left").where(F.col("class").rlike(r"(Listener|Handler|Observer|Callback)$|\$(Listener|Handler|Observer|Callback)")).groupBy("class").agg(F.count("*").alias("count"), F.sum("shallowSize").alias("shallow"), F.sum("r").alias("retained"))
        return per.where(F.col("count") >= int(plain(op, "threshold", 50))).orderBy(F.col("count").desc(), "class")
    if detector == "finalizer-queue":
        f = o.where("class = 'java.lang.ref.Finalizer'").select(F.col("id").alias("src"))
        ref = heap.edges.where("field = 'referent'").join(f, "src", "left_semi").join(o.select(F.col("id").alias("dst"), "class"), "dst").groupBy("class").agg(F.count("*").alias("queueSize"))
        total = f.agg(F.count("*").alias("queueSize")).select(F.lit("TOTAL").alias("class"), "queueSize").where(F.col("queueSize") >= int(plain(op, "threshold", 100)))
        return total.union(ref.join(total.select(F.lit(1).alias("x")), F.lit(True), "left_semi"))
    return heap.spark.createDataFrame([(x,) for x in LEAKS], "detector string")
