"""SimHash near-dedup with pivot distance tables.

Fingerprints that differ in at most `radius` bits agree in at least 6 - radius of six bit blocks, so
equal fingerprints are merged first and each distinct one is sent to one bucket per choice of agreeing
blocks. In a bucket, the table of Hamming distances to fixed reference fingerprints (pivots) discards
pairs: by the triangle inequality, a link's distances to any pivot differ by at most `radius`. Survivors
are verified, and a bucket emits only a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, components, cut, local_roots, spilled, texts_of

N_PIVOTS = 16
#: Distinct fingerprints that one task compares at once; larger buckets are split into pairs of chunks.
BUCKET = 4096
#: The byte value b as eight one-byte lanes, the highest bit in the highest lane.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes that begins at starts: the bits that over half of the run have set."""
    ends = np.append(starts[1:], len(hashes))
    out = np.zeros(len(starts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        counts = np.zeros(64, np.int64)
        for at in range(s, e, 255 * 256):  # a lane holds up to 255
            part = hashes[at : min(e, at + 255 * 256)]
            lanes = LANES[part.view(np.uint8)].reshape(-1, 8)
            whole = len(lanes) // 255 * 255
            if whole:
                counts += lanes[:whole].reshape(-1, 255, 8).sum(axis=1).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            if whole < len(lanes):
                counts += lanes[whole:].sum(axis=0).view(np.uint8).astype(np.int64)
        out[i] = weights[2 * counts > e - s].sum(dtype=np.uint64)
    return out


def text_fingerprints(texts: list, width: int) -> np.ndarray:
    """SimHash of each text's word shingles, repeats included; a text without words has zero."""
    out, hashes, starts, at, total = np.zeros(len(texts), np.uint64), [], [], [], 0
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if not words:
            continue
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        starts.append(total)
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64))
        total += len(hashes[-1])
        at.append(i)
    if at:
        out[at] = fingerprint_bits(np.concatenate(hashes), np.array(starts))
    return out


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text") -> DataFrame:
    """`docs` without its text, and a column `fingerprint` (64 bits as a long). Null texts count as empty."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest).withColumn("fingerprint", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            held = [batch.column(i) for i in range(len(rest))]
            prints = text_fingerprints(texts_of(batch.column(len(rest))), width)
            yield pa.RecordBatch.from_arrays([*held, pa.array(prints.view(np.int64))], names=schema.names)

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def bucket_links(prints: np.ndarray, radius: int, chunk: int = 512) -> np.ndarray:
    """The least index that each fingerprint reaches over links of at most radius differing bits."""
    pivots = np.random.default_rng(64).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)
    order = np.argsort(np.bitwise_count(prints ^ pivots[0]), kind="stable")
    x = prints[order]
    table = np.stack([np.bitwise_count(x ^ p).astype(np.int16) for p in pivots])
    root = np.arange(len(x))
    for at in range(0, len(x), chunk):
        end = min(at + chunk, len(x))
        stop = np.searchsorted(table[0], table[0, end - 1] + radius, side="right")
        far = np.abs(table[1, at:end, None] - table[1, None, at:stop]) > radius
        for p in (2, 3):
            far |= np.abs(table[p, at:end, None] - table[p, None, at:stop]) > radius
        i, j = np.nonzero(~far)
        i, j = i[j > i] + at, j[j > i] + at
        for p in (0, *range(4, N_PIVOTS)):
            near = np.abs(table[p, i] - table[p, j]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= radius
        root = local_roots(len(x), i[near], j[near], root)
    back = np.empty(len(x), np.int64)
    back[order] = order[root]
    return back


def block_keys(prints: np.ndarray, radius: int) -> np.ndarray:
    """A row for each choice of 6 - radius of six bit blocks: the choice's number and those blocks' bits, in 64 bits."""
    edges = [0, 11, 22, 33, 44, 54, 64]
    masks = [np.uint64(((1 << b) - (1 << a))) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for n, chosen in enumerate(combinations(range(6), 6 - radius)):
        key = np.full(len(prints), n, np.uint64)
        for c in chosen:
            key = (key << np.uint64(edges[c + 1] - edges[c])) | ((prints & masks[c]) >> np.uint64(edges[c]))
        out.append(key)
    return np.stack(out)


def fingerprint_links(prints: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct values of `fingerprint` that differ in at most radius bits (0 to 3)."""

    def spread(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            keys = block_keys(x, radius)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(x, len(keys)).view(np.int64))], names=["key", "fingerprint"])

    keyed = prints.select("fingerprint").where("fingerprint IS NOT NULL").distinct().mapInArrow(spread, "key long, fingerprint long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("chunks", F.ceil(F.col("n") / bucket).cast("int"))
    own = F.pmod(F.xxhash64("fingerprint"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    tasks = keyed.join(sizes, "key").withColumn("own", own).select("key", F.explode(pairs).alias("p"), "fingerprint").select("key", "p.i", "p.j", "fingerprint")
    tasks = tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(batches):
        a, b = [], []

        def close(prints):
            x = np.concatenate(prints)
            root = bucket_links(x, radius)
            linked = np.flatnonzero(root != np.arange(len(x)))
            a.append(x[linked])
            b.append(x[root[linked]])

        held, last = [], None
        for batch in batches:
            task = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            x = batch.column(3).to_numpy().view(np.uint64)
            if not len(x):
                continue
            cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(axis=1)) + 1).tolist(), len(x)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if held and tuple(task[s]) != last:
                    close(held)
                    held = []
                held.append(x[s:e])
                last = tuple(task[s])
        if held:
            close(held)
        if not a:
            return
        x, y = np.concatenate(a), np.concatenate(b)
        nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)  # a forest of the whole task
        root = local_roots(len(nodes), at[: len(x)], at[len(x) :])
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked].view(np.int64)), pa.array(nodes[root[linked]].view(np.int64))], names=["a", "b"])

    return tasks.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as a long, component_id): one row per input row.

    component_id is the least id in the row's component, null where the component has only null ids.
    Texts that are null or without words have fingerprint zero and link like any other. Repeated rows and
    ties share a fingerprint and so a component. An empty table gives an empty result. Only the id and
    text columns are read, so others may have any name.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    comp = components(fingerprint_links(prints, radius))
    joined = distinct.join(comp, distinct.fingerprint == comp.node, "left").select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    joined = cut(joined)
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint", "left").select(F.col("doc_id").alias(id_col), "fingerprint", "component_id")


#: Similarity search: tables of KEY_BITS sampled bits of a fingerprint of 128 bits, and the greatest Hamming distance that is looked at.
TABLES, KEY_BITS, FAR = 96, 16, 32
#: Members of a bucket that are compared by shifts; larger buckets by their table of distances to as many REFERENCES of their own.
SMALL, REFERENCES = 32, 8
#: Nearest members that each one of a large bucket is first linked to.
NEAREST = 4
#: Pairs of a task that wait before its forest takes them in.
PAIRS = 1 << 20
#: Tasks whose forests are joined at once.
TOGETHER = 8
#: Shingles of a group whose sets one task compares at once; larger groups are split into pairs of chunks.
GROUP = 1 << 19
#: Shingles that are looked up at once.
LOOKED_UP = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct word shingles; fewer words than a shingle are one."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    c = np.array([0x9E3779B97F4A7C15 + 2 * k * 0x7F4A7C15 for k in range(width)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    m = sum(h[k : k + n] * c[k] for k in range(width)) if n > 0 else np.array([(h * c[: len(h)]).sum() + np.uint64(len(h))], np.uint64)
    m = np.sort(mixed(m))
    return m[np.concatenate([[True], m[1:] != m[:-1]])]


def set_prints(texts: list, width: int) -> tuple:
    """(64 bits that name each text's set of shingles, two halves of its SimHash of 128 bits); no words give zeros."""
    name, prints = np.zeros(len(texts), np.uint64), np.zeros((2, len(texts)), np.uint64)
    for i, text in enumerate(texts):
        m = shingle_set(text, width)
        if len(m):
            name[i] = mixed(m + np.uint64(7)).sum()
            for k, h in enumerate((m, mixed(m ^ np.uint64(0x94D049BB133111EB)))):
                prints[k, i] = fingerprint_bits(h, np.zeros(1, np.int64))[0]
    return name, prints


def table_masks(tables: int = TABLES, bits: int = KEY_BITS) -> np.ndarray:
    """The sampled bits of each table, as masks of both halves."""
    rng = np.random.default_rng(17)
    chosen = [rng.choice(128, bits, replace=False).tolist() for _ in range(tables)]
    return np.array([[sum(1 << (b - 64 * k) for b in own if b // 64 == k) for k in (0, 1)] for own in chosen], np.uint64)


def table_keys(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A row for each table: its number in the highest bits, and a hash of the sampled bits of each fingerprint."""
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    return np.stack([(mixed((x & m[0]) * one ^ (y & m[1]) * two) >> np.uint64(7)) | np.uint64(t << 57) for t, m in enumerate(table_masks())])


def differing(x, y, i, j) -> np.ndarray:
    return np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(y[i] ^ y[j])


def bucket_pairs(keys: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Near pairs of places in sorted keys that are of one bucket, and their distances: shift by shift."""
    live, shift = np.arange(len(keys)), 1
    while True:
        live = live[live + shift < len(keys)]
        live = live[keys[live] == keys[live + shift]]
        if not len(live):
            return
        d = differing(x, y, live, live + shift)
        near = d <= FAR
        yield live[near], live[near] + shift, d[near]
        shift += 1


def wide_links(x: np.ndarray, y: np.ndarray, chunk: int = 256) -> tuple:
    """Near pairs of one large bucket that join what all its near pairs join, and their distances.

    Pairs whose distances to a reference fingerprint differ by more than FAR are discarded unseen. Each reference is the member that is farthest from those before it, so the members of a group of near copies are all near one and far from others.
    """
    first, table = 0, []
    for _ in range(REFERENCES):
        table.append(np.bitwise_count(x ^ x[first]).astype(np.int16) + np.bitwise_count(y ^ y[first]))
        first = int(np.argmax(np.min(table, axis=0)))
    table = np.stack(table)
    order = np.argsort(table[0], kind="stable")
    x, y, table = x[order], y[order], table[:, order]

    def blocks():
        """Rows at.. and columns from.. of the matrix of distances; discarded and own pairs are beyond FAR."""
        for at in range(0, len(x), chunk):
            end = min(at + chunk, len(x))
            begin, stop = np.searchsorted(table[0], [table[0, at] - FAR, table[0, end - 1] + FAR + 1])
            far = np.zeros((end - at, stop - begin), bool)
            for p in range(REFERENCES):
                far |= np.abs(table[p, at:end, None] - table[p, None, begin:stop]) > FAR
            i, j = np.nonzero(~far)
            out = np.full(far.shape, FAR + 1, np.int16)
            out[i, j] = differing(x, y, i + at, j + begin)
            out[np.arange(at, end) - at, np.arange(at, end) - begin] = FAR + 1
            yield at, begin, out

    found = []
    for at, begin, d in blocks():
        k = min(NEAREST, d.shape[1])
        j = np.argpartition(d, k - 1, axis=1)[:, :k]
        i, near = np.repeat(np.arange(len(d)), k), np.take_along_axis(d, j, axis=1).ravel()
        some = near <= FAR
        found.append((i[some] + at, j.ravel()[some] + begin, near[some].astype(np.int64)))
    i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
    root = local_roots(len(x), i, j)
    while True:  # then the lightest links between what these leave apart
        best = np.full(len(x), np.iinfo(np.int64).max)
        for at, begin, block in blocks():
            block[root[at : at + len(block), None] == root[None, begin : begin + block.shape[1]]] = FAR + 1
            column = block.argmin(axis=1)
            least = block[np.arange(len(block)), column].astype(np.int64)
            some = np.flatnonzero(least <= FAR)
            np.minimum.at(best, root[at + some], (least[some] << 48) | ((at + some) << 24) | (column[some] + begin))
        pick = np.unique(best[best < np.iinfo(np.int64).max])
        if not len(pick):
            return order[i], order[j], d
        more = (pick >> 24) & 0xFFFFFF, pick & 0xFFFFFF
        i, j, d = np.append(i, more[0]), np.append(j, more[1]), np.append(d, pick >> 48)
        root = local_roots(len(x), *more, root)


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Of links between nodes with their distances, the places of a minimum spanning forest (Boruvka's rounds)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    key = (d.astype(np.int64) << 40) | np.arange(len(a))
    root, chosen, open_ = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        open_ = open_[root[i[open_]] != root[j[open_]]]
        if not len(open_):
            break
        best = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(best, root[i[open_]], key[open_])
        np.minimum.at(best, root[j[open_]], key[open_])
        pick = np.unique(best[best < np.iinfo(np.int64).max]) & ((1 << 40) - 1)
        chosen.append(pick)
        root = local_roots(len(nodes), i[pick], j[pick], root)
    return np.concatenate([np.zeros(0, np.int64), *chosen])


def similar_candidates(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b, d): links of rows (node, x, y) whose fingerprints (halves x and y) differ in d bits, FAR at most.

    Rows meet in a table if its sampled bits agree. Each task emits a minimum spanning forest of its
    links, never its pairs, so the components are those of all pairs; buckets of more than `bucket` rows
    are split into pairs of chunks.
    """

    def spread(batches):
        for batch in batches:
            keys = table_keys(*(batch.column(i).to_numpy().view(np.uint64) for i in (1, 2)))
            at = pa.array(np.tile(np.arange(batch.num_rows), len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(batch.column(i).take(at) for i in range(3))], names=["key", "node", "x", "y"])

    def only_keys(batches):
        for batch in batches:
            keys, n = np.unique(table_keys(*(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    hot = rows.select("x", "y").mapInArrow(only_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > bucket)
    hot = cut(hot.select("key", F.ceil(F.col("n") / bucket).cast("int").alias("chunks")))
    each = rows.select("node", "x", "y").mapInArrow(spread, "key long, node long, x long, y long")
    each = each.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "key", "left")  # 1.2 MB at most
    chunks = F.coalesce("chunks", F.lit(1))
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    tasks = each.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).select(F.explode(pairs).alias("p"), "key", "node", "x", "y")
    tasks = tasks.select(F.when(F.col("p.j") > 0, F.xxhash64("key", "p.i", "p.j")).otherwise(F.col("key")).alias("key"), "node", "x", "y")
    tasks = tasks.repartition("key").sortWithinPartitions("key")

    def link(batches):
        held: list = []
        forest = (np.zeros(0, np.int64),) * 3
        found: list = []
        size = waiting = 0

        def fold():
            nonlocal forest, found, waiting
            links = [np.concatenate([forest[k], *(f[k] for f in found)]) for k in range(3)]
            forest = tuple(c[spanning(*links)] for c in links)
            found, waiting = [], 0

        def add(a, b, d):
            nonlocal waiting
            found.append((a, b, d))
            waiting += len(a)
            if waiting > PAIRS:
                fold()

        def close(keep_last: bool):
            nonlocal held, size
            key, node, x, y = (np.concatenate([h[i] for h in held]) for i in range(4))
            end = np.searchsorted(key, key[-1]) if keep_last else len(key)  # the last bucket may go on
            ends = np.append(np.flatnonzero(key[1:end] != key[: end - 1]) + 1, end) if end else np.zeros(0, int)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            large = ends - starts > SMALL
            inside = np.zeros(end + 1, np.int64)
            np.add.at(inside, starts[large], 1)
            np.add.at(inside, ends[large], -1)
            small = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
            for i, j, d in bucket_pairs(key[small], x[small], y[small]):
                add(node[small[i]], node[small[j]], d)
            for p, q in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
                i, j, d = wide_links(x[p:q], y[p:q])
                add(node[p + i], node[p + j], d)
            held, size = ([(key[end:], node[end:], x[end:], y[end:])] if keep_last else []), len(key) - end

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy().view(np.uint64 if i > 1 else np.int64) for i in range(4)))
            size += batch.num_rows
            if size >= 100_000:
                close(True)
        if held and size:
            close(False)
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest], names=["a", "b", "d"])

    return tasks.mapInArrow(link, "a long, b long, d long")


def stars(links: DataFrame) -> DataFrame:
    """(a, b): of the links (a, b, d) of TOGETHER tasks, each node with the least node that they join it to.

    Tasks that join the same nodes mostly agree in these links, where their forests differ.
    """

    def run(batches):
        held = [(np.zeros(0, np.int64),) * 2, *(tuple(batch.column(k).to_numpy() for k in (0, 1)) for batch in batches)]
        a, b = (np.concatenate(c) for c in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], names=["a", "b"])

    tasks = links.select("a", "b", F.floor(F.spark_partition_id() / TOGETHER).alias("tasks"))
    return tasks.repartition("tasks").mapInArrow(run, "a long, b long")


def joined(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of the places `at`, which then are their parents."""
    up = parent[at]
    while not np.array_equal(up, over := parent[up]):
        up = over
    parent[at] = up
    return up


def similar_sets(sets: list, least: float) -> tuple:
    """Pairs (i, j) of sets with a Jaccard similarity of `least` or more that join what all such pairs join.

    Two such sets share one of their first n - least * n + 1 members, in any order of all members; here
    the rarest come first. Every pair that does and is not yet joined is verified on the whole sets.
    """
    if len(sets) == 2:
        both = len(sets[0]) + len(sets[1]) - len(np.union1d(*sets))
        near = [0] if both >= least * (len(sets[0]) + len(sets[1]) - both) else []
        return np.array(near, np.int64), np.array([1] * len(near), np.int64)
    by_size = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[k] for k in by_size.tolist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    _, names, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(n), np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    owner = np.repeat(np.arange(len(sets)), sizes)
    member = np.sort(owner * max(len(n), 1) + rank[names]) - owner * max(len(n), 1)  # of each set, the rarest first
    firsts = np.minimum(sizes, sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1)
    of = np.repeat(np.arange(len(sets)), firsts)
    entry = np.arange(len(of)) - np.repeat(np.cumsum(firsts) - firsts, firsts) + starts[of]
    order = np.argsort(member[entry], kind="stable")
    holders, key = of[order], member[entry][order]  # who holds a member among the first, the smaller sets first
    begin = np.empty(len(of), np.int64)
    begin[order] = np.searchsorted(key, key)
    place = np.empty(len(of), np.int64)
    place[order] = np.arange(len(of))
    open_, upto = begin < place, np.cumsum(firsts)
    parent, weight, a, b = np.arange(len(sets)), np.ones(len(sets), np.int64), [], []
    held = np.zeros(max(len(n), 1), bool)
    for i in range(len(sets)):
        own = slice(upto[i] - firsts[i], upto[i])
        slots = np.flatnonzero(open_[own]) + upto[i] - firsts[i]
        if not len(slots):
            continue
        others, shared = np.unique(np.concatenate([holders[begin[e] : place[e]] for e in slots.tolist()]), return_counts=True)
        big = sizes[others] >= least * sizes[i] - 1e-9
        others = others[big][np.argsort(-shared[big], kind="stable")]
        held[member[starts[i] : starts[i] + sizes[i]]] = True
        batch = 4
        while len(others := others[joined(parent, others) != joined(parent, np.array([i]))]):
            batch = max(1, min(batch, int(np.searchsorted(np.cumsum(sizes[others]), LOOKED_UP))))
            some, others = others[:batch], others[batch:]
            length = sizes[some]
            ends = np.cumsum(length)
            both = np.add.reduceat(held[member[np.arange(ends[-1]) + np.repeat(starts[some] - ends + length, length)]], ends - length, dtype=np.int64)
            for j in some[both >= least * (length + sizes[i] - both)].tolist():
                p, q = joined(parent, np.array([i, j])).tolist()
                if p != q:
                    p, q = (p, q) if weight[p] >= weight[q] else (q, p)
                    parent[q] = p
                    weight[p] += weight[q]
                    a.append(i)
                    b.append(j)
            batch *= 4
        held[member[starts[i] : starts[i] + sizes[i]]] = False
    return by_size[np.array(a, np.int64)], by_size[np.array(b, np.int64)]


def group_links(sets: DataFrame, least: float, most: int = GROUP) -> DataFrame:
    """(a, b): links between nodes of a group whose sets (group, node, n, shingles) have a Jaccard similarity of `least` or more.

    Their components are those of all such links. Groups of more than `most` shingles are split into pairs of chunks.
    """
    hot = sets.groupBy("group").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    hot = cut(hot.select("group", F.ceil(F.col("n") / most).cast("int").alias("chunks")))
    each = sets.select("group", "node", "shingles").join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "group", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    tasks = each.withColumn("own", F.pmod(F.xxhash64("node"), chunks).cast("int")).select("group", F.explode(pairs).alias("p"), "node", "shingles").select("group", "p.i", "p.j", "node", "shingles")
    tasks = tasks.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")

    def run(batches):
        last, nodes, held = None, [], []
        a, b = [], []

        def close():
            if len(nodes) > 1:
                i, j = similar_sets(held, least)
                a.append(np.array(nodes)[i])
                b.append(np.array(nodes)[j])

        for batch in batches:
            for *task, node, shingles in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                if task != last:
                    close()
                    last, nodes, held = task, [], []
                nodes.append(node)
                held.append(np.frombuffer(shingles.as_py(), np.uint64))
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def similar_documents(docs: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, text_hash, times, doc_component, kept): groups of docs by the Jaccard similarity of their sets of word shingles.

    A row for each distinct (doc_id, text), of which `times` are in docs; kept: whether it is the first of
    its group by doc_id and text_hash. Texts of equal sets are one node, texts without words are alike.
    The links of similar_candidates() join nodes to coarse groups, and within a group all pairs are decided
    on the whole sets of shingles. Rows with a null doc_id are left out.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                name, prints = set_prints(texts_of(rows.column(2)), width)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(v.view(np.int64)) for v in (name, *prints))], names=["doc_id", "text_hash", "node", "x", "y"])

    def sets_of(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                held = [shingle_set(t, width) for t in texts_of(rows.column(2))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(x) for x in held], pa.int64()), pa.array([x.tobytes() for x in held], pa.binary())], names=["group", "node", "n", "shingles"])

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    each = cut(own.mapInArrow(run, "doc_id long, text_hash long, node long, x long, y long"))
    rows = each.groupBy("doc_id", "text_hash").agg(F.first("node").alias("node"), F.count("*").alias("times"))
    nodes = cut(each.groupBy("node").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min(F.struct("doc_id", "text_hash")).alias("first")))
    coarse = components(stars(similar_candidates(nodes))).withColumnRenamed("component", "group")
    named = nodes.join(coarse, "node").select("group", "node", F.col("first.doc_id").alias("n_id"), F.col("first.text_hash").alias("n_hash"))
    texts = own.join(named, (own.doc_id == named.n_id) & (own.text_hash == named.n_hash)).dropDuplicates(["node"]).select("group", "node", "text")
    sets = texts.mapInArrow(sets_of, "group long, node long, n long, shingles binary")
    comp = components(group_links(spilled(sets), least)).withColumnRenamed("node", "linked")
    grouped = nodes.join(comp, nodes.node == F.col("linked"), "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least_of = grouped.groupBy("component").agg(F.min("first").alias("kept"))
    placed = grouped.join(least_of, "component").select("node", "kept")
    return rows.join(placed, "node").select("doc_id", "text_hash", "times", F.col("kept.doc_id").alias("component_id"), ((F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.text_hash") == F.col("text_hash"))).alias("kept"))


def kept_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of similar_documents(): the first by doc_id and text, of equal rows one.

    Rows with a null doc_id stay: no decision can name them.
    """
    keep = cut(similar_documents(docs, least).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "times"))
    same = (docs.doc_id == keep.k_id) & (F.xxhash64(docs.text) == keep.k_hash)
    once = docs.join(keep.where("times = 1"), same, "left_semi")
    several = docs.join(F.broadcast(keep.where("times > 1")) if keep.where("times > 1").count() <= 100_000 else keep.where("times > 1"), same, "left_semi")
    return once.unionByName(several.dropDuplicates(["doc_id", "text"])).unionByName(docs.where("doc_id IS NULL"))
