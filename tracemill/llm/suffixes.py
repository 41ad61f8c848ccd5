"""Removal of repeated byte strings by per-shard suffix arrays.

A string of `length` bytes has an anchor, the least-hashed of its GRAM-byte grams, which depends on its
bytes alone, so equal strings meet by their anchor's hash. Anchors that occur once rule out all strings
that they stand for. Anchors whose whole surroundings recur settle theirs by two 64-bit hashes. The
surroundings of the others go to shards by anchor: a suffix array (Larsson and Sadakane's refinement of
unsorted groups), common prefixes (Kasai et al.) and, where a shard of a task ends within an anchor's
group, a binary search of its sorted strings for those of the next. Anchors with more than HOT
surroundings are not gathered: their strings are counted one by one, by hash, with map-side combine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spilled, texts_of

LENGTH, GRAM = 200, 40
#: Surroundings of one anchor that a shard takes; symbols of one suffix array.
HOT, SHARD = 4096, 1 << 21
#: Keys of documents that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes that are hashed at once, unless one text is longer.
CHUNK = 1 << 22
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def powers(base: int, n: int, held: dict = {}) -> np.ndarray:  # noqa: B006  kept between calls
    if base not in held or len(held[base]) < n:
        x = np.full(max(n, CHUNK + (1 << 16)), base, np.uint64)
        x[0] = 1
        held[base] = np.cumprod(x)
    return held[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor, first start, last start, anchor hash, surroundings hash) of the runs of starts that share an anchor. data: the texts' bytes; ends: where each text ends."""
    n = len(data)
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    back = pow(BASE, -1, 1 << 64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(BASE, n), out=sums[1:])
    h = mixed((sums[gram:] - sums[: n - gram + 1]) * powers(back, n - gram + 1))
    v = (h & U((1 << 64) - (1 << 28))) | np.arange(len(h), dtype=np.uint64) if len(h) < 1 << 28 else None
    width = length - gram + 1
    m, size = v, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(v) - width + 1], m[width - size : len(v) - size + 1])
    owner = (m & U((1 << 28) - 1)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - begins >= length)
    valid = np.zeros(len(owner) + 1, np.int8)
    valid[begins[long]] += 1
    np.subtract.at(valid, ends[long] - length + 1, 1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(starts):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    own = owner[starts]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    lo, hi, p = starts[new], starts[np.append(new[1:], len(starts)) - 1], own[new]
    text = np.searchsorted(ends, lo, side="right")
    around = (sums[hi + length] - sums[lo]) * powers(back, n)[lo]
    around = mixed(around ^ mixed(((hi - lo) << 16 | (p - lo)).astype(np.uint64) * U(0x94D049BB133111EB)))
    at = begins[text]
    return [text, p - at, lo - at, hi - at, h[p], around]


def chunks(texts: list):
    """Runs of texts of about CHUNK bytes: their first number and their bytes."""
    at, size, n = 0, 0, len(texts)
    for i in range(n):
        size += len(texts[i])
        if size >= CHUNK or i == n - 1:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def suffix_array(symbols: np.ndarray) -> tuple:
    """Order and ranks of the suffixes of symbols, of which the last occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = 1
    while True:
        alone = np.concatenate([first[1:], [True]]) & first
        places = np.flatnonzero(~alone)  # of groups that are not yet sorted
        if not len(places):
            return order, rank
        i = order[places]
        key = (rank[i] << 32) | rank[np.minimum(i + h, n - 1)]
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        order[places] = i
        changed = np.concatenate([[True], key[1:] != key[:-1]])
        first[places] = changed
        rank[i] = places[np.maximum.accumulate(np.where(changed, np.arange(len(i)), 0))]
        h *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefix, up to `most`, of each suffix and the one before it in order, for all pieces at once: along a piece it falls by one at most."""
    n, out = len(symbols), np.zeros(len(symbols), np.int64)
    h = np.zeros(len(begins), np.int64)
    for t in range(int((ends - begins).max()) if len(begins) else 0):
        lanes = np.flatnonzero(begins + t < ends)
        i = begins[lanes] + t
        r = rank[i]
        some = r > 0
        lanes, i, r = lanes[some], i[some], r[some]
        j = order[r - 1]
        k = np.maximum(h[lanes] - 1, 0)
        open_ = np.arange(len(lanes))
        while len(open_):
            a, b = i[open_] + k[open_], j[open_] + k[open_]
            more = (k[open_] < most) & (a < n) & (b < n)
            open_, a, b = open_[more], a[more], b[more]
            open_ = open_[symbols[a] == symbols[b]]
            k[open_] += 1
        h[lanes] = k
        out[i] = k
    return out


def repeated_starts(pieces: list, lasts: np.ndarray, length: int) -> tuple:
    """For pieces (bytes): arrays of which of their starts 0..last begin a string that another start of any piece begins too, and the sorted strings of given pieces."""
    sizes = np.array([len(x) for x in pieces])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = np.empty(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    symbols[begins + sizes] = 256 + np.arange(len(pieces))
    order, rank = suffix_array(symbols)
    prefix = common_prefixes(symbols, order, rank, begins, begins + sizes, length)
    by_rank = prefix[order]
    hit = by_rank >= length
    hit[:-1] |= by_rank[1:] >= length
    found = hit[rank]
    return [found[b : b + last + 1] for b, last in zip(begins.tolist(), lasts.tolist(), strict=True)]


def strings_at(piece: bytes, last: int, length: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(piece, np.uint8), length)[: last + 1].copy().view(f"S{length}").ravel()


def runs(flags: np.ndarray) -> np.ndarray:
    """Rows (first, last) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2) - [0, 1]


def found_anchors(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, span, anchor, around): span packs the anchor's place, and how far before it its first and last start are."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(2))
            for at, some in chunks(texts):
                text, p, lo, hi, kh, ch = anchors(np.frombuffer(b"".join(some), np.uint8), np.cumsum([len(x) for x in some]), length)
                if len(text):
                    rows = pa.array(text + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array((p << 16) | ((p - lo) << 8) | (p - hi)), pa.array(kh.view(np.int64)), pa.array(ch.view(np.int64))], names=["doc_id", "text_hash", "span", "anchor", "around"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, span long, anchor long, around long")


PIECE = "anchor long, single boolean, wide boolean, doc_id long, text_hash long, lo long, last int, piece binary"


def cut_pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The surroundings (of PIECE's columns) that wanted (doc_id, text_hash, cuts) asks of each document."""

    def run(batches):
        for batch in batches:
            texts, rows = texts_of(batch.column(2)), batch.select(["doc_id", "text_hash", "cuts"]).to_pylist()
            for text, row in zip(texts, rows, strict=True):
                out = {k.split()[0]: [] for k in PIECE.split(", ")}
                for c in row["cuts"]:
                    p, before, after = c["span"] >> 16, (c["span"] >> 8) & 255, c["span"] & 255
                    lo, hi = p - before, p - after
                    for k, v in (("anchor", c["anchor"]), ("single", c["single"]), ("wide", c["wide"]), ("doc_id", row["doc_id"]), ("text_hash", row["text_hash"]), ("lo", lo), ("last", hi - lo), ("piece", text[lo : hi + length])):
                        out[k].append(v)
                kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return on_documents(docs, wanted, "inner").mapInArrow(run, PIECE)


def on_documents(docs: DataFrame, keyed: DataFrame, how: str) -> DataFrame:
    """docs (doc_id, text_hash, text) joined with a table of the same two keys, of one row a document; null ids are equal.

    If the keys are few enough to broadcast, only the documents that they name are shuffled.
    """
    k = keyed.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), *[c for c in keyed.columns if c not in ("doc_id", "text_hash")])
    same = docs.text_hash.eqNullSafe(k.k_hash) & docs.doc_id.eqNullSafe(k.k_id)
    return docs.join(k, same, how).drop("k_id", "k_hash")


def found_in(strings: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of own are among the sorted strings, by binary search."""
    at = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
    return strings[at] == own


def sharded(pieces: DataFrame, length: int, shard: int = SHARD) -> DataFrame:
    """(doc_id, text_hash, first, last): runs of the repeated starts of single pieces. A task's pieces, in order of their anchors, are cut into shards."""

    def run(batches):
        held, size, tail = [], 0, []

        def close(following):
            nonlocal tail
            got = repeated_starts([r["piece"] for r in held], np.array([r["last"] for r in held]), length)
            out = list(zip(held, got, strict=True))
            if tail and tail[0]["anchor"] == held[0]["anchor"]:  # the group began in the shard before
                own = [strings_at(r["piece"], r["last"], length) for r in held if r["anchor"] == tail[0]["anchor"]]
                old = [strings_at(r["piece"], r["last"], length) for r in tail]
                a, b = np.sort(np.concatenate(old)), np.sort(np.concatenate(own))
                for flags, x in zip(got, own, strict=False):
                    flags |= found_in(a, x)
                out += [(r, found_in(b, x)) for r, x in zip(tail, old, strict=True)]
            tail = [r for r in [*tail, *held] if r["anchor"] == following] if held[-1]["anchor"] == following else []
            rows = [(r["doc_id"], r["text_hash"], r["lo"] + a, r["lo"] + b) for r, flags in out if r["single"] for a, b in runs(flags).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)], names=["doc_id", "text_hash", "first", "last"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and size + len(row["piece"]) > shard:
                    yield close(row["anchor"])
                    held, size = [], 0
                held.append(row)
                size += len(row["piece"])
        if held:
            yield close(None)

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id long, text_hash long, first long, last long")


def counted(pieces: DataFrame, length: int) -> DataFrame:
    """As sharded(), a string at a time: for anchors with many surroundings."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                text, n = row["piece"], row["last"] + 1
                cuts = [text[k : k + length] for k in range(n)]
                both = [np.array([xxhash.xxh64_intdigest(c, seed) for c in cuts], np.uint64).view(np.int64) for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["text_hash"]] * n, pa.int64()), pa.array(np.arange(n) + row["lo"]), pa.array([row["single"]] * n, pa.bool_())], names=["h1", "h2", "doc_id", "text_hash", "first", "single"])

    each = pieces.mapInArrow(run, "h1 long, h2 long, doc_id long, text_hash long, first long, single boolean")
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    return each.where("single").join(twice, ["h1", "h2"]).select("doc_id", "text_hash", "first", F.col("first").alias("last"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, spans array<struct<first, last>>) of docs (doc_id, text_hash, text): a row for each document with starts of repeated strings."""
    places = spilled(found_anchors(docs, length))
    twice = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    m = spilled(places.join(twice, "anchor").select(*places.columns))
    around = m.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "doc_id", "span")).alias("one"))
    around = spilled(around)
    kinds = around.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1")
    full = m.join(around.where("n > 1").select("anchor", "around"), ["anchor", "around"])
    p = F.shiftright("span", 16)
    full = full.select("doc_id", "text_hash", (p - F.shiftright("span", 8).bitwiseAND(255)).alias("first"), (p - F.col("span").bitwiseAND(255)).alias("last"))
    asked = around.join(kinds, "anchor").select("one.doc_id", "one.text_hash", F.struct("anchor", (F.col("n") == 1).alias("single"), (F.col("kinds") > hot).alias("wide"), "one.span").alias("c"))
    asked = asked.groupBy("doc_id", "text_hash").agg(F.collect_list("c").alias("cuts"))
    pieces = spilled(cut_pieces(docs, asked, length))
    found = full.union(sharded(pieces.where("NOT wide"), length)).union(counted(pieces.where("wide"), length))
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def covered(spans: list, length: int) -> np.ndarray:
    """Rows (begin, end) of the maximal runs of bytes that strings starting in the spans cover."""
    if not spans:
        return np.zeros((0, 2), np.int64)
    s = np.array(sorted((x["first"], x["last"] + length) for x in spans), np.int64)
    reach = np.maximum.accumulate(s[:, 1])
    new = np.flatnonzero(np.concatenate([[True], s[1:, 0] > reach[:-1]]))
    return np.stack([s[new, 0], reach[np.append(new[1:], len(s)) - 1]], axis=1)


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept, removed array<struct<begin, end>>, n_bytes): one row per input row; kept: the bytes outside the removed runs.

    A byte is removed if a string of `length` bytes that covers it also starts anywhere else in the input,
    in another row or at another place of the same; strings never cross rows. Null texts count as empty;
    texts shorter than `length` stay whole; of repeated rows all copies of such strings go. Rows with a
    null id are told apart by their texts. An empty table gives none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    spans = spilled(repeated_spans(own, length, hot))

    def run(batches):
        for batch in batches:
            kept, removed, sizes = [], [], []
            for text, row in zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                cuts = covered(row or [], length).tolist()
                at, out = 0, []
                for a, b in cuts:
                    out.append(text[at:a])
                    at = b
                kept.append(b"".join([*out, text[at:]]))
                removed.append([{"begin": a, "end": b} for a, b in cuts])
                sizes.append(len(text))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((kept, removed, sizes), kinds[1:], strict=True))], names=["doc_id", "kept", "removed", "n_bytes"])

    n = spans.count()
    keys = spans.select(F.col("doc_id").alias("x_id"), F.col("text_hash").alias("x_hash"))
    named = F.broadcast(keys) if n <= BROADCAST_ROWS else keys
    same = own.text_hash.eqNullSafe(named.x_hash) & own.doc_id.eqNullSafe(named.x_id)
    touched = on_documents(own.join(named, same, "left_semi"), spans, "left").select("doc_id", "text_hash", "text", "spans")
    clean = own.join(named, same, "left_anti")
    schema = "doc_id long, kept binary, removed array<struct<begin: long, end: long>>, n_bytes long"
    whole = clean.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"), F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)").alias("removed"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return touched.mapInArrow(run, schema).union(whole).withColumnRenamed("doc_id", id_col)
