"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words joined by spaces and closed by a line feed. Each byte is eight binary
decisions; every context (the bytes before, up to DEPTH of them) has a Krichevsky-Trofimov estimator for
each decision. A context's block probability is the even mixture of its own estimate and of the product
of its children's, so the prediction mixes all depths by their posterior weights. Every context that
occurs twice in the training texts has a node of its own, so the tree grows with the corpus; those that
occur once are counted together as the rest of the context above.

No process holds the tree. Texts are read in batches, whose distinct strings of DEPTH + 1 bytes are
counted and dealt to shards by the two bytes before the last. Shards are merged and weighted bottom up;
the contexts of two bytes, 65,536 at most, meet on the driver, which weights the top of the tree and
sends its share of each prediction back. Shards then predict every string, and the batches look theirs
up. Counts of whole tokens take the same way.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, shared_dir, spilled, texts_of

DEPTH = 6
#: Occurrences in the training texts from which a context has a node.
LEAST = 2
#: Bytes of texts of a batch, of texts that are looked at at once, and keys of a row.
BATCH, CHUNK, ROW = 64 << 20, 1 << 21, 1 << 19
#: Places whose strings are taken at once, and keys that wait until they are merged into a batch's.
PLACES, WAITING = 1 << 19, 1 << 20
#: Keys of whole shards that are weighted at once, unless one has more.
TOGETHER = 1 << 17
#: Batches that one task looks up.
LOOKED_UP = 512
#: Shards below TOKENS are contexts of two bytes; DOCS marks rows of texts; those between are of tokens, by hash.
TOKENS, DOCS = 1 << 16, 1 << 20
#: Counts whose log gamma is in a table.
TABLE = 1 << 16
END = b"\n"


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, from x + 6 down."""
    y = x + 6
    out = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(6):
        out -= np.log(x + k)
    return out


def log_kt(a: np.ndarray, b: np.ndarray, held: dict = {}) -> np.ndarray:  # noqa: B006  kept between calls
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones (whole numbers)."""
    if not held:
        n = np.arange(TABLE, dtype=np.float64)
        held["half"], held["whole"] = log_gamma(n + 0.5), log_gamma(n + 1)

    def of(name, x, shift):
        out = held[name][np.minimum(x, TABLE - 1)]
        big = x >= TABLE
        if big.any():
            out[big] = log_gamma(x[big] + shift)
        return out

    return of("half", a, 0.5) + of("half", b, 0.5) - of("whole", a + b, 1.0) - math.log(math.pi)


def log_odds(x: np.ndarray, y: np.ndarray) -> tuple:
    """log(exp x + exp y), and the share of x in it."""
    both = np.logaddexp(x, y)
    return both, np.exp(np.clip(x - both, -700, 0))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes of their differences."""
    planes = np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, 8 * n, codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(8, n).T.copy().view("<i8").ravel())


def summed(keys: np.ndarray, n: np.ndarray) -> tuple:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = firsts(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def firsts(x: np.ndarray) -> np.ndarray:
    """Places of sorted values that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


# Reading texts


def bodies_of(texts: list) -> list:
    return [b" ".join(t.translate(LOWER).split()) + END for t in texts]


def stream_of(bodies: list) -> tuple:
    """The bytes of bodies, each after DEPTH line feeds, and the places of their first bytes and ends."""
    stream = np.frombuffer(b"".join(END * DEPTH + b for b in bodies), np.uint8)
    ends = np.cumsum([len(b) + DEPTH for b in bodies])
    return stream, ends - np.array([len(b) for b in bodies]), ends


def inside(n: int, begins: np.ndarray, ends: np.ndarray, flags: np.ndarray | None = None) -> np.ndarray:
    """Which of n places are of a body (that has its flag)."""
    d = np.zeros(n + 1, np.int8)
    some = slice(None) if flags is None else flags
    d[begins[some]] += 1
    np.subtract.at(d, ends[some], 1)
    return np.cumsum(d[:-1], dtype=np.int8).astype(bool)


def string_keys(stream: np.ndarray) -> np.ndarray:
    """At each place its byte (lowest) and the DEPTH bytes before it, the last one highest."""
    out = stream.astype(np.int64)
    for k in range(1, DEPTH + 1):
        out[k:] |= stream[:-k].astype(np.int64) << (8 * (DEPTH + 1 - k))
    return out


def string_parts(stream: np.ndarray, own: np.ndarray):
    """string_keys() of the places that are own, some PLACES at a time, and which places those are."""
    for s in range(0, len(stream), PLACES):
        before = min(s, DEPTH)
        some = slice(s, s + PLACES)
        yield string_keys(stream[s - before : s + PLACES])[before:][own[some]], np.flatnonzero(own[some]) + s


def token_keys(bodies: list) -> tuple:
    """62 bits of hash of every token of bodies, and how many tokens each has; the line feed that closes a body is its end token."""
    words = [b[:-1].split(b" ") if len(b) > 1 else [] for b in bodies]
    sizes = np.array([len(w) + 1 for w in words])
    out = np.fromiter((h for w in words for h in map(xxhash.xxh64_intdigest, (*w, b""), repeat(7))), np.uint64, int(sizes.sum()))
    return (out >> np.uint64(2)).view(np.int64), sizes


def portions(texts: list):
    """Runs of texts of about CHUNK bytes, as (first, last) numbers."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK or i + 1 == len(texts):
            yield at, i + 1
            at, size = i + 1, 0


class Counts:
    """Distinct keys of a batch and how often training texts hold them.

    Keys wait until there are WAITING, and are merged into those held without sorting these anew: a worker
    has the old and the new keys in memory, and nothing else of their size.
    """

    def __init__(self):
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.waiting: list = []
        self.size = 0

    def add(self, keys: np.ndarray, held_out: np.ndarray):
        x = keys << 1
        x |= held_out
        x.sort()
        at = np.flatnonzero(np.concatenate([[True], (x[1:] ^ x[:-1]) > 1])) if len(x) else np.zeros(0, np.int64)
        if not len(at):
            return
        self.waiting.append((x[at] >> 1, np.add.reduceat((x & 1) == 0, at, dtype=np.int32)))
        self.size += len(at)
        if self.size >= WAITING:
            self.merge()

    def merge(self):
        """Takes in the keys that wait."""
        if not self.waiting:
            return
        keys, n = zip(*self.waiting, strict=True)
        self.waiting, self.size = [], 0
        keys, n = np.concatenate(keys), np.concatenate(n)
        keys, n = summed(keys, n)
        n = n.astype(np.int32)
        if not len(self.keys):
            self.keys, self.n = keys, n
            return
        at = np.searchsorted(self.keys, keys)
        old = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        self.n[at[old]] += n[old]
        new = ~old
        at, keys, n = at[new], keys[new], n[new]
        self.keys = np.insert(self.keys, at, keys)
        self.n = np.insert(self.n, at, n)


KEYED = "batch long, shard int, size int, keys binary, counts binary"


def shard_rows(batch: int, strings: Counts, tokens: Counts):
    """A batch's rows of KEYED, a record batch at a time."""
    for c, first, low in ((strings, 0, 8 * (DEPTH - 1)), (tokens, TOKENS, 54)):
        c.merge()
        shard = (c.keys >> low).astype(np.int32)
        shard += first
        at = firsts(shard)
        rows = [(int(shard[i]), s, min(s + ROW, e)) for i, e in zip(at.tolist(), [*at[1:].tolist(), len(shard)], strict=True) for s in range(i, e, ROW)]
        for k in range(0, len(rows), 500):
            some = rows[k : k + 500]
            yield [pa.array([batch] * len(some), pa.int64()), pa.array([x[0] for x in some], pa.int32()), pa.array([e - s for _, s, e in some], pa.int32()), pa.array([packed(c.keys[s:e]) for _, s, e in some], pa.binary()), pa.array([packed(c.n[s:e]) for _, s, e in some], pa.binary())]


def gathered(docs: DataFrame) -> DataFrame:
    """KEYED and (ids, held, sizes): a batch's rows by shard, and rows of DOCS with its normalised texts in keys."""
    names = [*(x.split()[0] for x in KEYED.split(", ")), "ids", "held", "sizes"]
    lists = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]

    def run(batches):
        number, size, strings, tokens = TaskContext.get().partitionId() << 32, 0, Counts(), Counts()

        def close():
            for columns in shard_rows(number, strings, tokens):
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(columns[0]), t) for t in lists)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts, out = texts_of(rows.column(2)), rows.column(1).to_numpy(zero_copy_only=False).astype(object)
                out = np.array([bool(x) for x in out])  # a null is not held out
                for i, j in portions(texts):
                    bodies = bodies_of(texts[i:j])
                    stream, begins, ends = stream_of(bodies)
                    trained = inside(len(stream), begins, ends, np.flatnonzero(~out[i:j]))
                    some = inside(len(stream), begins, ends)
                    for keys, places in string_parts(stream, some):
                        strings.add(keys, ~trained[places])
                    keys, each = token_keys(bodies)
                    tokens.add(keys, np.repeat(out[i:j], each))
                    blob = b"".join(bodies)
                    docs_row = [[number], [DOCS], [len(blob)], [pa.compress(blob, codec="zstd", asbytes=True)], [b""], [rows.column(0).slice(i, j - i).to_pylist()], [rows.column(1).slice(i, j - i).to_pylist()], [[len(b) for b in bodies]]]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *lists]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(docs_row, kinds, strict=True)], names=names)
                    size += len(blob)
                if size >= BATCH:
                    yield from close()
                    number, size, strings, tokens = number + 1, 0, Counts(), Counts()
        if size:
            yield from close()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, KEYED + ", ids array<long>, held array<boolean>, sizes array<long>")


# The tree


def groups(batches, by: list):
    """Rows, as dicts, that agree in the columns `by`, of sorted rows: (values, iterator of rows)."""
    from itertools import groupby

    rows = (row for batch in batches for at in range(0, batch.num_rows, 64) for row in batch.slice(at, 64).to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[c] for c in by))


def merged_rows(rows) -> tuple:
    """Keys and sums of the counts of rows of KEYED."""
    keys, n, held, m = [], [], 0, 0
    for r in rows:
        keys.append(unpacked(r["keys"], r["size"]))
        n.append(unpacked(r["counts"], r["size"]))
        held += r["size"]
        if held > 2 * m + ROW:  # sums go on in memory that grows with the distinct keys alone
            a, b = summed(np.concatenate(keys), np.concatenate(n))
            keys, n, held, m = [a], [b], len(a), len(a)
    return summed(np.concatenate(keys), np.concatenate(n))


def merged(rows: DataFrame) -> DataFrame:
    """(shard, size, keys, counts): sums over the batches of KEYED and `salt`; a shard's salts stay apart."""

    def run(batches):
        for (shard, _), some in groups(batches, ["shard", "salt"]):
            keys, n = merged_rows(some)
            for at in range(0, len(keys), ROW):
                k, c = keys[at : at + ROW], n[at : at + ROW]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(k)], pa.int32()), pa.array([packed(k)], pa.binary()), pa.array([packed(c)], pa.binary())], names=["shard", "size", "keys", "counts"])

    return rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt").mapInArrow(run, "shard int, size int, keys binary, counts binary")


class Level:
    """The contexts of one length that have nodes: contexts (sorted), and the sorted (context, byte) keys with their counts n."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        key, n = summed(((keys >> 8 * (DEPTH + 1 - depth)) << 8) | (keys & 255), n)
        at = firsts(key >> 8)
        total = np.add.reduceat(n, at) if len(at) else n
        own = np.repeat(total >= LEAST, np.diff(np.append(at, len(key))))
        self.key, self.n = key[own], n[own]
        self.contexts = self.key[firsts(self.key >> 8)] >> 8

    def decisions(self, bit: int) -> tuple:
        """The sorted (context, decision) keys that occur at one of a byte's eight bits, their zeros and ones."""
        node = ((self.key >> 8) << 8) | (1 << bit) | ((self.key & 255) >> (8 - bit))
        at = firsts(node)
        one = (self.key >> (7 - bit)) & 1
        sums = (lambda x: np.add.reduceat(x, at)) if len(at) else (lambda x: x)
        return node[at], sums(self.n * (1 - one)), sums(self.n * one)


class Subtree:
    """The contexts of 2 to `depth` bytes of whole shards, weighted bottom up, a bit at a time; keys need not be sorted."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        own = n > 0
        self.levels = [Level(keys[own], n[own], d) for d in range(2, depth + 1)]
        for level, below in zip(self.levels, [*self.levels[1:], None], strict=True):
            level.inner = np.isin(level.contexts, below.contexts >> 8) if below else np.zeros(len(level.contexts), bool)

    def nodes(self, bit: int) -> list:
        """For each level: its (context, decision) keys, log block probabilities, own predictions, own weights and the rests' predictions."""
        out: list = []
        below = None
        for level in reversed(self.levels):
            key, z, o = level.decisions(bit)
            inner = level.inner[np.searchsorted(level.contexts, key >> 8)]
            own, rz, ro, sums = log_kt(z, o), z, o, 0.0
            if below and len(below[0]):
                child, cz, co, block = below
                up = np.searchsorted(key, (child >> 16 << 8) | (child & 255))
                rz, ro = z - np.bincount(up, cz, len(key)).astype(np.int64), o - np.bincount(up, co, len(key)).astype(np.int64)
                sums = np.bincount(up, block, len(key))
            both, weight = log_odds(own, log_kt(rz, ro) + sums)
            block = np.where(inner, both - math.log(2), own)
            out.append((key, block, (o + 0.5) / (z + o + 1), np.where(inner, weight, 1.0), (ro + 0.5) / (rz + ro + 1)))
            below = key, z, o, block
        return out[::-1]

    def blocks(self, shards: np.ndarray) -> np.ndarray:
        """Log block probabilities of contexts of two bytes (sorted) at each of the 256 decisions; zeros where one has no node."""
        out = np.zeros((len(shards), 256))
        for bit in range(8):
            key, block, *_ = self.nodes(bit)[0]
            out[np.searchsorted(shards, key >> 8), key & 255] = block
        return out

    def predict(self, keys: np.ndarray, base: np.ndarray, share: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Log10 probability of each key's byte; base and share: what the top of the tree predicts at each decision, and the share that it leaves, of the rows' shards."""
        out = np.zeros(len(keys))
        exists, inner, at = [], [], []
        for d, level in enumerate(self.levels, 2):
            context = keys >> 8 * (DEPTH + 1 - d)
            i = np.minimum(np.searchsorted(level.contexts, context), max(0, len(level.contexts) - 1))
            found = level.contexts[i] == context if len(level.contexts) else np.zeros(len(keys), bool)
            exists.append(found)
            inner.append(level.inner[i] if len(level.contexts) else found)
            at.append(context)
        for bit in range(8):
            node = (1 << bit) | ((keys & 255) >> (8 - bit))
            p, left = base[row, node], share[row, node]
            for k, (own, _, guess, weight, rest) in enumerate(self.nodes(bit)):
                live = np.flatnonzero(exists[k])
                if not len(live):
                    break
                q = (at[k][live] << 8) | node[live]
                i = np.minimum(np.searchsorted(own, q), len(own) - 1)
                seen = own[i] == q
                w = np.where(seen, weight[i], np.where(inner[k][live], 0.5, 1.0))
                mine = left[live]
                p[live] += mine * w * np.where(seen, guess[i], 0.5)
                mine = mine * (1 - w)
                last = ~exists[k + 1][live] if k + 1 < len(self.levels) else np.ones(len(live), bool)
                p[live[last]] += (mine * np.where(seen, rest[i], 0.5))[last]
                left[live] = np.where(last, 0, mine)
            p = np.clip(p, 1e-9, 1 - 1e-9)
            out += np.log10(np.where((keys >> (7 - bit)) & 1, p, 1 - p))
        return out


def decisions(counts: np.ndarray) -> tuple:
    """Zeros and ones at each of the 255 decisions (node 1 is the highest bit's) of rows of 256 counts."""
    zeros, ones = np.zeros((2, len(counts), 256), np.int64)
    level, width = counts, 128
    while width:
        pair = level.reshape(len(counts), width, 2)
        zeros[:, width : 2 * width], ones[:, width : 2 * width] = pair[:, :, 0], pair[:, :, 1]
        level, width = pair.sum(axis=2), width // 2
    return zeros, ones


class Top:
    """The contexts of up to one byte. shards: contexts of two bytes (the last one highest); counts and blocks: their rows of 256."""

    def __init__(self, shards: np.ndarray, counts: np.ndarray, blocks: np.ndarray):
        node = counts.sum(axis=1) >= LEAST
        one, whole = np.zeros((2, 256, 256), np.int64)
        sums = np.zeros((256, 256))
        up = shards >> 8
        np.add.at(whole, up, counts)
        np.add.at(one, up[node], counts[node])
        np.add.at(sums, up[node], blocks[node])
        inner = np.bincount(up[node], minlength=256) > 0
        (z, o), (rz, ro) = decisions(whole), decisions(whole - one)
        own = log_kt(z, o)
        both, weight = log_odds(own, log_kt(rz, ro) + sums)
        weight = np.where(inner[:, None], weight, 1.0)
        block = np.where(inner[:, None], both - math.log(2), own)
        self.held = whole.sum(axis=1) >= LEAST
        root, covered = whole.sum(axis=0, keepdims=True), whole[self.held].sum(axis=0, keepdims=True)
        (z0, o0), (rz0, ro0) = decisions(root), decisions(root - covered)
        _, w0 = log_odds(log_kt(z0, o0), log_kt(rz0, ro0) + block[self.held].sum(axis=0))
        w0 = w0 if self.held.any() else np.ones_like(w0)
        base = np.repeat(w0 * ((o0 + 0.5) / (z0 + o0 + 1)), 256, axis=0)
        share = np.repeat(1 - w0, 256, axis=0)
        rest0 = ((ro0 + 0.5) / (rz0 + ro0 + 1))[0]
        base[~self.held] += share[~self.held] * rest0
        share[~self.held] = 0
        base += share * weight * ((o + 0.5) / (z + o + 1))
        self.share = share * (1 - weight)
        self.base, self.rest = base, (ro + 0.5) / (rz + ro + 1)
        self.nodes = set(shards[node].tolist())

    def of(self, shard: int) -> tuple:
        """base and share of Subtree.predict for a shard."""
        up = shard >> 8
        if shard in self.nodes:
            return self.base[up], self.share[up]
        return self.base[up] + self.share[up] * self.rest[up], np.zeros(256)


def shard_runs(batches):
    """Whole shards of rows sorted by shard, merged: (are they of tokens, keys, counts), some TOGETHER keys at a time unless one shard has more."""
    kind, held, size = False, [], 0

    def close():
        keys, n = zip(*held, strict=True)
        return kind, np.concatenate(keys), np.concatenate(n)

    for (shard,), some in groups(batches, ["shard"]):
        if held and ((shard >= TOKENS) != kind or size >= TOGETHER):
            yield close()
            held, size = [], 0
        kind = shard >= TOKENS
        held.append(merged_rows(some))
        size += len(held[-1][0])
    if held:
        yield close()


def tops(sums: DataFrame, depth: int) -> tuple:
    """(Top, sum of token counts, distinct tokens): a row for each context of two bytes, 65,536 at most, and sums come to the driver."""

    def run(batches):
        for token, keys, n in shard_runs(batches):
            shards, row = np.unique(keys >> 8 * (DEPTH - 1), return_inverse=True) if not token else (np.full(1, -1), None)
            columns = [pa.array(shards, pa.int32()), pa.array([int(n.sum()) if token else 0] * len(shards), pa.int64()), pa.array([int((n > 0).sum()) if token else 0] * len(shards), pa.int64())]
            if token:
                columns += [pa.nulls(1, pa.binary())] * 2
            else:
                counts = np.bincount(row * 256 + (keys & 255), n, len(shards) * 256).astype(np.int64).reshape(-1, 256)
                columns += [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (counts, Subtree(keys, n, depth).blocks(shards))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "n", "distinct", "counts", "block"])

    got = sums.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, n long, distinct long, counts binary, block binary").toArrow().to_pylist()
    own = [r for r in got if r["shard"] >= 0]
    rows = lambda name, kind: np.array([np.frombuffer(r[name], kind) for r in own]).reshape(-1, 256)
    top = Top(np.array([r["shard"] for r in own], np.int64), rows("counts", np.int64), rows("block", np.float64))
    return top, sum(r["n"] for r in got), sum(r["distinct"] for r in got)


def predicted(sums: DataFrame, top, depth: int) -> DataFrame:
    """(shard, size, keys, values): log10 probabilities of strings, as doubles; counts of tokens, as longs."""

    def run(batches):
        for token, keys, n in shard_runs(batches):
            shard, values = (TOKENS + (keys >> 54), n) if token else (keys >> 8 * (DEPTH - 1), None)
            at = firsts(shard)
            if not token:
                base, share = zip(*map(top.value.of, shard[at].tolist()), strict=True)
                values = Subtree(keys, n, depth).predict(keys, np.array(base), np.array(share), np.searchsorted(shard[at], shard))
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
                rows = [(i, min(i + ROW, e)) for i in range(s, e, ROW)]
                yield pa.RecordBatch.from_arrays([pa.array([shard[s]] * len(rows), pa.int32()), pa.array([j - i for i, j in rows], pa.int32()), pa.array([packed(keys[i:j]) for i, j in rows], pa.binary()), pa.array([values[i:j].tobytes() for i, j in rows], pa.binary())], names=["shard", "size", "keys", "values"])

    return sums.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, size int, keys binary, values binary")


def looked_up(rows: DataFrame, model: DataFrame, salts: int) -> DataFrame:
    """(batch, shard, size, keys, values as floats or longs) for the rows of KEYED and `salt`: each shard's model meets its batches."""
    asked = rows.select("shard", "salt", F.lit(1).alias("kind"), "batch", "size", "keys", F.lit(None).cast("binary").alias("values"))
    told = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "size", "keys", "values")

    def run(batches):
        for (shard, _), some in groups(batches, ["shard", "salt"]):
            kind = np.int64 if shard >= TOKENS else np.float64
            known, values = [], []
            table = None
            for r in some:
                keys = unpacked(r["keys"], r["size"])
                if r["kind"] == 0:
                    known.append(keys)
                    values.append(np.frombuffer(r["values"], kind))
                    continue
                if table is None:
                    table, value = np.concatenate(known), np.concatenate(values)
                    order = np.argsort(table, kind="stable")  # the rows of a shard may come in any order
                    table, value = table[order], value[order]
                got = value[np.searchsorted(table, keys)]
                got = got if shard >= TOKENS else got.astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]], pa.int64()), pa.array([shard], pa.int32()), pa.array([r["size"]], pa.int32()), pa.array([r["keys"]], pa.binary()), pa.array([got.tobytes()], pa.binary())], names=["batch", "shard", "size", "keys", "values"])

    both = asked.unionByName(told).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return both.mapInArrow(run, "batch long, shard int, size int, keys binary, values binary")


class Lookup:
    """Values by key, in a table with open addressing. The lists of keys and values are emptied."""

    def __init__(self, keys: list, values: list, kind):
        self.keys, self.values = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (values, kind)))
        keys.clear()
        values.clear()
        self.shift = 64 - max(4, int(2 * len(self.keys) + 1).bit_length())
        self.table = np.full(1 << (64 - self.shift), -1, np.int32)
        todo, slot = np.arange(len(self.keys), dtype=np.int32), self.slots(self.keys)
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            lost = self.table[slot] != todo
            todo, slot = todo[lost], (slot[lost] + 1) & (len(self.table) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        out >>= np.uint64(self.shift)
        return out.view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        slot = self.slots(keys)
        place = self.table[slot]
        todo = np.flatnonzero(self.keys[place] != keys)
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.table) - 1)
            got = self.table[slot]
            if (got < 0).any():
                raise KeyError("a key that no row has told of")
            place[todo] = got
            wrong = self.keys[got] != keys[todo]
            todo, slot = todo[wrong], slot[wrong]
        return self.values[place]


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"


def summed_up(texts: DataFrame, found: DataFrame) -> DataFrame:
    """SCORED: each batch's values meet its texts."""
    blank = lambda kind: F.lit(None).cast(kind)
    a = found.select("batch", "shard", "size", "keys", "values", blank("array<long>").alias("ids"), blank("array<boolean>").alias("held"), blank("array<long>").alias("sizes"))
    b = texts.select("batch", "shard", "size", "keys", blank("binary").alias("values"), "ids", "held", "sizes")

    def run(batches):
        for _, some in groups(batches, ["batch"]):
            held: tuple = ([], [], [], [])
            tables = None
            for r in some:
                if r["shard"] < DOCS:
                    token = r["shard"] >= TOKENS
                    held[2 * token].append(unpacked(r["keys"], r["size"]))
                    held[2 * token + 1].append(np.frombuffer(r["values"], np.int64 if token else np.float32))
                    continue
                if tables is None:
                    tables = Lookup(*held[:2], np.float32), Lookup(*held[2:], np.int64)
                blob = pa.decompress(r["keys"], r["size"], codec="zstd", asbytes=True)
                cuts = np.concatenate([[0], np.cumsum(r["sizes"])]).tolist()
                bodies = [blob[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
                stream, begins, ends = stream_of(bodies)
                own = inside(len(stream), begins, ends)
                each = [tables[0](keys) for keys, _ in string_parts(stream, own)]
                logs = np.concatenate([[0.0], np.cumsum(np.concatenate(each), dtype=np.float64)])
                score = np.diff(logs[cuts])
                keys, each = token_keys(bodies)
                counts = tables[1](keys)
                owner = np.repeat(np.arange(len(each)), each)
                sums = np.bincount(owner, np.log10(counts + 1.0), len(each))
                known = np.bincount(owner, counts > 0, len(each)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(each.astype(np.int64)), pa.array(known), pa.array(sums), pa.array(score), pa.array(r["sizes"], pa.int64())], names=[x.split()[0] for x in SCORED.split(", ")])

    return a.unionByName(b).repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(run, SCORED)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, folds: int = 7, fold: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte): one row per input row.

    Texts whose crc32(id as text) mod folds is fold are held out of all counts; a null id is not held out
    and has held_out null. Null texts count as empty: they are their end alone. score covers the text's
    words in lower case, the spaces between them and its end; depth is 2 to DEPTH. Repeated rows count
    and score as rows of their own. An empty table gives none.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    all_ = spilled(gathered(own))
    keyed = all_.where(F.col("shard") < DOCS).select("batch", "shard", "size", "keys", "counts")
    salts = -(-max(1, all_.select("batch").distinct().count()) // LOOKED_UP)
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
    sums = spilled(merged(keyed))
    top, n, v = tops(sums, depth)
    sent = spark.sparkContext.broadcast(top)
    model = spilled(predicted(sums, sent, depth))
    out = summed_up(all_.where(F.col("shard") == DOCS), looked_up(keyed, model, salts))
    base = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return out.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"))
