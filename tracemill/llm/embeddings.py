"""Embedding near-dedup by an epsilon grid order join.

Equal vectors are merged first. Vectors are sorted by label and by their cells on a grid over the leading
principal dimensions, whose side is the greatest distance of a link; a projection never lengthens a
distance, so vectors more than a cell apart on any dimension cannot link. The sorted sequence is cut into
blocks; pairs of blocks that are not provably distant are joined by halving both again and again. A pair
emits sums of links and a spanning forest, never its pairs of vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, local_roots, spilled

#: Vectors of a block, vectors of a leaf of the recursion, and dimensions of the grid.
BLOCK, LEAF, GRID = 2048, 256, 4


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def rows_of(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def principal(classes: DataFrame, dims: int) -> dict:
    """For each number of dimensions d of a vector the leading principal directions (d x at most dims) of all unit vectors."""

    def parts(batches):
        sums: dict = {}
        for batch in batches:
            for d, x in by_length(batch, "embedding"):
                u = unit_rows(rows_of(x.column("embedding")))
                s = np.concatenate([[len(u)], u.sum(axis=0), (u.T @ u).ravel()])
                sums[d] = sums.get(d, 0) + s
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["d", "s"])

    def totals(batches):
        sums: dict = {}
        for batch in batches:
            for d, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[d] = sums.get(d, 0) + np.array(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["d", "s"])

    schema = "d int, s array<double>"
    out: dict = {}
    for row in classes.select("embedding").mapInArrow(parts, schema).repartition(8, "d").mapInArrow(totals, schema).collect():  # a row for each length
        n, d, s = row.s[0], row.d, np.array(row.s)
        mean = s[1 : d + 1] / n
        values, vectors = np.linalg.eigh(s[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
        out[d] = vectors[:, ::-1][:, :dims].copy()
    return out


def by_length(batch, name: str):
    """The batch by the lengths of a column of lists."""
    size = np.array([len(x) for x in batch.column(name)])
    for d in np.unique(size).tolist():
        yield d, batch.filter(pa.array(size == d))


def is_double(classes: DataFrame) -> bool:
    """Whether vectors come in double precision."""
    return isinstance(classes.schema["embedding"].dataType.elementType, T.DoubleType)


def grid_blocks(classes: DataFrame, axes: dict, side: float, block: int) -> DataFrame:
    """Blocks of the grid order: (block, label, d, ids, times, vectors binary, low, high): low and high bound the cells."""

    def cells(batches):
        for batch in batches:
            for d, x in by_length(batch, "embedding"):
                y = unit_rows(rows_of(x.column("embedding"))) @ axes[d]
                cell = np.zeros((len(y), GRID), np.int64)
                cell[:, : y.shape[1]] = np.floor(y / side)
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ("id", "label", "times", "embedding")), pa.array(np.full(len(y), d, np.int32)), *(pa.array(cell[:, k]) for k in range(GRID))], names=["id", "label", "times", "embedding", "d", *(f"c{k}" for k in range(GRID))])

    names = [f"c{k}" for k in range(GRID)]
    kind, exact = ("double", np.float64) if is_double(classes) else ("float", np.float32)
    placed = classes.select("id", "label", "times", "embedding").mapInArrow(cells, f"id long, label long, times long, embedding array<{kind}>, d int, " + ", ".join(f"{c} long" for c in names))
    kinds = {"block": pa.int64(), "label": pa.int64(), "d": pa.int32(), "ids": pa.list_(pa.int64()), "times": pa.list_(pa.int64()), "vectors": pa.binary(), "low": pa.list_(pa.int64()), "high": pa.list_(pa.int64())}

    def pack(batches):
        part, n, held = TaskContext.get().partitionId() << 32, 0, []

        def close():
            x = pa.Table.from_batches(held).combine_chunks()
            cell = np.stack([x.column(c).to_numpy() for c in names], axis=1)
            vectors = rows_of(x.column("embedding").combine_chunks()).astype(exact)
            row = [part + n, x.column("label")[0].as_py(), x.column("d")[0].as_py(), x.column("id").to_pylist(), x.column("times").to_pylist(), vectors.tobytes(), cell.min(axis=0).tolist(), cell.max(axis=0).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

        size = 0
        for batch in batches:
            at, group = 0, np.stack([batch.column("label").to_numpy(), batch.column("d").to_numpy()], axis=1)
            while at < batch.num_rows:
                if held and (group[at] != (held[-1].column("label")[0].as_py(), held[-1].column("d")[0].as_py())).any():
                    yield close()
                    held, size, n = [], 0, n + 1
                same = np.flatnonzero((group[at:] != group[at]).any(axis=1))
                end = min(at + block - size, at + int(same[0]) if len(same) else batch.num_rows, batch.num_rows)
                held.append(batch.slice(at, end - at))
                size += end - at
                at = end
                if size >= block:
                    yield close()
                    held, size, n = [], 0, n + 1
        if held:
            yield close()

    schema = "block long, label long, d int, ids array<long>, times array<long>, vectors binary, low array<long>, high array<long>"
    return placed.orderBy("label", "d", *names, "id").mapInArrow(pack, schema)


def apart(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all cells of a are more than a cell from all of b on some dimension."""
    return bool(((a.min(axis=0) > b.max(axis=0) + 1) | (b.min(axis=0) > a.max(axis=0) + 1)).any())


def joined(a, b, cells_a, cells_b, least: float, same: bool, found, at_a: int = 0, at_b: int = 0):
    """Calls found(i, j) with arrays of the linked places of two sequences of unit vectors: halves both until they are leaves or provably apart."""
    if not len(a) or not len(b) or apart(cells_a, cells_b):
        return
    if max(len(a), len(b)) <= LEAF:
        i, j = np.nonzero(a @ b.T >= least)
        if same and at_a == at_b:
            i, j = i[i < j], j[i < j]
        found(i + at_a, j + at_b)
        return
    ha, hb = (len(a) + 1) // 2, (len(b) + 1) // 2
    for x in (slice(0, ha), slice(ha, None)):
        for y in (slice(0, hb), slice(hb, None)):
            if not same or at_a != at_b or x.start <= y.start:
                joined(a[x], b[y], cells_a[x], cells_b[y], least, same, found, at_a + x.start, at_b + y.start)


def block_links(blocks: DataFrame, axes: dict, side: float, least: float, exact=np.float32) -> DataFrame:
    """(id, links, root): for each linked class of vectors, parts of its number of links to other vectors, and links that span the components."""
    k = GRID
    s = blocks.select("block", "label", "d", *(F.element_at("low", i + 1).alias(f"l{i}") for i in range(k)), *(F.element_at("high", i + 1).alias(f"h{i}") for i in range(k)))
    one = s.withColumn("c", F.explode(F.sequence("l0", "h0")))
    two = s.select(*(F.col(c).alias(f"o_{c}") for c in s.columns)).withColumn("c", F.explode(F.sequence(F.col("o_l0") - 1, F.col("o_h0") + 1)))
    near = (F.col("label") == F.col("o_label")) & (F.col("d") == F.col("o_d")) & (one.c == two.c) & (F.col("block") <= F.col("o_block")) & (one.c == F.greatest(F.col("l0"), F.col("o_l0") - 1))
    for i in range(1, k):
        near &= (F.col(f"l{i}") <= F.col(f"o_h{i}") + 1) & (F.col(f"o_l{i}") <= F.col(f"h{i}") + 1)
    pairs = one.join(two, near).select(F.col("block").alias("a"), F.col("o_block").alias("b"))
    x = blocks.select(F.col("block").alias("a"), "d", F.col("ids").alias("a_ids"), F.col("times").alias("a_times"), F.col("vectors").alias("a_vectors"))
    y = blocks.select(F.col("block").alias("b"), F.col("ids").alias("b_ids"), F.col("times").alias("b_times"), F.col("vectors").alias("b_vectors"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pair(batch.slice(i, 1).to_pylist()[0])

    def pair(row):
        def side_of(name):
            u = unit_rows(np.frombuffer(row[f"{name}_vectors"], exact).reshape(-1, row["d"]))
            return u, np.floor(u @ axes[row["d"]] / side), np.array(row[f"{name}_ids"], np.int64), np.array(row[f"{name}_times"], np.int64)

        same = row["a"] == row["b"]
        u, cu, ids, times = side_of("a")
        v, cv = (u, cu) if same else (None, None)
        if not same:
            v, cv, more, more_times = side_of("b")
            ids, times = np.concatenate([ids, more]), np.concatenate([times, more_times])
        shift = 0 if same else len(u)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def found(i, j):
            nonlocal root
            j = j + shift
            np.add.at(links, i, times[j])
            np.add.at(links, j, times[i])
            root = local_roots(len(ids), i, j, root)

        joined(u, v, cu, cv, least, same, found)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], names=["id", "links", "root"])

    return pairs.join(x, "a").join(y, "b").select("a", "b", *x.columns[1:], *y.columns[1:]).repartition("a", "b").mapInArrow(run, "id long, links long, root long")


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept): one row per input row.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at least
    `least`. Null, empty and zero vectors, those with null or non-finite components and those of unequal
    lengths link with nothing. component_id is the least id that a row reaches, null where only null ids
    are; kept is null for a null id. Repeated vectors link as others do. An empty table gives none.
    """
    given = vectors.schema
    kind = "array<float>" if isinstance(given[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"), F.col(label_col).alias("label"))
    if isinstance(given[label_col].dataType, T.IntegralType):
        own = own.withColumn("label", F.col("label").cast("long"))
    else:  # numbers for labels of other kinds
        numbers = spilled(own.select("label").where("label IS NOT NULL").distinct().select(F.col("label").alias("x_name"), F.monotonically_increasing_id().alias("x_number")))
        own = own.join(numbers, F.col("label") == F.col("x_name"), "left").select("vec_id", "embedding", F.col("x_number").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    marked = own.withColumn("good", good)
    classes = spilled(marked.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()))
    side = math.sqrt(2 - 2 * least) * (1 + 1e-9) + 1e-12
    axes = principal(classes, GRID)
    blocks = spilled(grid_blocks(classes, axes, side, block))
    found = spilled(block_links(blocks, axes, side, least, np.float64 if is_double(classes) else np.float32))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(links, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    named = named.select("label", "embedding", "first", F.coalesce("component", "id").alias("component"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    leasts = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(leasts, "component").select(F.col("label").alias("x_label"), F.col("embedding").alias("x_embedding"), "n_links", "component_id")
    linked = marked.where("good").join(named, (F.col("label") == F.col("x_label")) & (F.col("embedding") == F.col("x_embedding"))).select("vec_id", "n_links", "component_id")
    rest = marked.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
