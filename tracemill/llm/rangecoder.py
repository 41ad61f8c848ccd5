"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are dealt to lanes, each a contiguous run with a range coder of its own; all lanes share one
model, so numpy codes a step (one id a lane) at once. The counts of what followed each id (order 1) and
each two ids (order 2) are renewed whenever the block has grown by GROWTH. A step codes by which order an
id is predicted, the highest that has seen it follow, and then the id by that order's counts; what neither
has seen goes by adaptive order-0 frequencies. The probability that an order holds is mixed from two
estimates, one by how much and how variously the context was followed and one by the previous id,
weighted by which has done better. All that a model learns holds from the next chunk of steps on, so that
the encoder finds the intervals of a whole chunk at once. All arithmetic is in integers, so that any machine decodes what
another has written.

Block: b"TMR3", ids, vocabulary size, lanes (uint32 each), crc32 of the ids as little-endian uint32, words
of each lane (uint32), the lanes' 16-bit words, and the crc32 of all before. Little-endian throughout.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TMR3"
LANES, PER_LANE = 8192, 64
#: Most steps between renewals of the order-0 frequencies and of the estimates, and growth between those of the counts.
RENEW, GROWTH = 32, 4
#: Of so many ids one tells the shares of the orders; the frequencies are of all.
LEARN = 8
#: Bits of the shares of the orders.
SHARE = 15
U = np.uint64
#: A lane's range is at least BOT before a step; both parts of a step leave it at least 2^4.
TOP, BOT = U(1 << 48), U(1 << 40)
#: Classes of a context by the bits of its count and of its distinct followers.
COUNTS, KINDS = 12, 10
#: Bits of the numbers below 2^COUNTS.
WIDTH = np.frexp(np.arange(1 << COUNTS))[1].astype(np.int32)


def looked_up(table: np.ndarray, values: np.ndarray, side: str = "left") -> np.ndarray:
    """As np.searchsorted(); values are looked up in their order, so that what they touch stays in the processor's caches."""
    order = np.argsort(values, axis=None)
    at = np.empty(values.size, np.int64)
    at[order] = np.searchsorted(table, values.ravel()[order], side)
    return at.reshape(values.shape)


def contexts(n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of contexts that were followed n times, by so many kinds of ids: 0 if never."""
    return WIDTH[np.minimum(n, (1 << COUNTS - 1) - 1)] * KINDS + WIDTH[np.minimum(kinds, (1 << KINDS - 1) - 1)]


def rows_of(columns) -> np.ndarray:
    """Four columns of 32 bits as rows of 16 bytes, which numpy takes as one number each."""
    out = np.empty((len(columns[0]), 4), np.int32)
    for k, x in enumerate(columns):
        out[:, k] = x
    return out.view(np.complex128).ravel()


def taken(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns of rows_of() at some places."""
    return rows[at].view(np.int32).reshape(-1, 4).T


class Counts:
    """What followed one id and two ids so far. A context of two ids is the place of their pair among the pairs of order 1."""

    def __init__(self, vocab: int):
        self.bits = max(1, int(vocab).bit_length())
        self.vocab = vocab
        self.every = [np.zeros(0, np.int64)] * 2
        self.renew()

    def add(self, before2: np.ndarray, before1: np.ndarray, ids: np.ndarray):
        pair = (before1 << self.bits | ids).ravel()
        for k, new in enumerate((pair, before2.ravel() << 2 * self.bits | pair)):
            self.every[k] = np.sort(np.concatenate([self.every[k], new]))
        self.renew()

    def renew(self):
        """Distinct keys with their counts, the cumulative counts, and the place of each of those."""
        changes = [np.concatenate([np.ones(min(len(k), 1), bool), k[1:] != k[:-1]]) for k in self.every]
        self.keys, self.upto, self.n, self.held = [], [], [], []
        for every, new in zip(self.every, changes, strict=True):
            at = np.flatnonzero(new)
            self.keys.append(every[at])
            self.upto.append(np.append(at, len(every)))
            self.n.append(np.diff(self.upto[-1]))
            self.held.append(np.cumsum(new, dtype=np.int32) - np.int32(1))

    def find(self, k: int, keys: np.ndarray) -> tuple:
        """The places of keys, and which are there."""
        return self.places_of(k, keys)

    def places_of(self, k: int, keys: np.ndarray) -> tuple:
        if not len(self.keys[k]):
            return np.zeros(keys.shape, np.int64), np.zeros(keys.shape, bool)
        at = np.minimum(looked_up(self.keys[k], keys), len(self.keys[k]) - 1)
        return at, self.keys[k][at] == keys

    def holding(self, k: int, at: np.ndarray) -> np.ndarray:
        """The places of the keys that hold the cumulative counts `at`: there are as many as ids were added, so each has its place in a table."""
        return self.held[k][at]

    def edges(self) -> tuple:
        """Where the followers begin of each id, and of each pair: in order, so they end where the next ones begin."""
        return np.searchsorted(self.keys[0], np.arange(self.vocab + 1) << self.bits), np.searchsorted(self.keys[1], self.keys[0] << self.bits)

    def contexts(self) -> tuple:
        """Of the contexts of one id and of two: the cumulative count before what followed, its sum, and the class.
        Those of order 2 come after those of order 1; the last one is the pair that has not been seen."""
        first, begin = self.edges()
        out, before = [], 0
        for begin, end, upto in ((first[:-1], first[1:], self.upto[0]), (begin, np.append(begin[1:], len(self.keys[1])), self.upto[1])):
            total = upto[end] - upto[begin]
            out.append([upto[begin] + before, total, contexts(total, end - begin)])
            before = int(upto[-1])
        return out[0], [np.append(x, 0) for x in out[1]]

    def entries(self) -> tuple:
        """By cumulative count the place, and rows of places: the id, the pair it makes (-1: to be searched), the cumulative
        count and the count. One of each is added, so that there is something to take."""
        n, all_ = len(self.keys[0]), len(self.keys[0]) + len(self.keys[1])
        held = np.concatenate([self.held[0], self.held[1], np.zeros(1, np.int32)])
        held[len(self.held[0]) : -1] += n
        rows = np.zeros((all_ + 1, 4), np.int32)
        for k, part in ((0, rows[:n]), (1, rows[n:all_])):
            part[:, 0] = self.keys[k] & (1 << self.bits) - 1
            part[:, 1] = -1 if k else np.arange(n)
            part[:, 2] = self.upto[k][:-1]
            part[:, 3] = self.n[k]
        rows[n:all_, 2] += len(self.held[0])
        return held, rows.view(np.complex128).ravel()

    def pairs(self, before2: np.ndarray, before1: np.ndarray) -> np.ndarray:
        """The contexts of two ids."""
        at, seen = self.find(0, before2 << self.bits | before1)
        return np.where(seen, at, len(self.keys[0]))


def ranked(keys: np.ndarray, bits: int) -> tuple:
    """The ranks of keys below 2^bits, and the distinct keys."""
    n, shape = keys.size, keys.shape
    more = n.bit_length()
    if bits + more < 64:  # sorting numbers is faster than sorting places
        keys = keys.ravel() << more
        keys |= np.arange(n)
        keys.sort()
        order = keys & (1 << more) - 1
        keys >>= more
    else:
        order = np.argsort(keys, axis=None)
        keys = keys.ravel()[order]
    new = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    new[0] = False
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return rank.reshape(shape), keys


class Ranked(Counts):
    """The counts of a block whose ids are all known: keys are the ranks of its pairs, and of its threes of ids, so that nothing
    is searched. Those that were not added yet have the count 0."""

    def __init__(self, vocab: int, before1: np.ndarray, ids: np.ndarray):
        self.bits, self.vocab = max(1, int(vocab).bit_length()), vocab
        pair, pairs = ranked(before1 << self.bits | ids, 2 * self.bits)
        context = ids.copy()
        context[0] |= (0 if pairs[0] == 0 else len(pairs)) << self.bits
        context[1:] |= pair[:-1].astype(np.int64) << self.bits
        three, threes = ranked(context, len(pairs).bit_length() + self.bits)
        self.ranks, self.keys = [pair, three], [pairs]
        sizes = len(pairs), len(threes)
        self.n = [np.zeros(k, np.int32) for k in sizes]
        self.upto, self.kinds = ([np.zeros(k + 1, np.int32) for k in sizes] for _ in range(2))
        self.first = np.searchsorted(pairs, np.arange(vocab + 1) << self.bits)
        self.begin = np.zeros(len(pairs) + 1, np.int64)
        np.cumsum(np.bincount(threes >> self.bits, minlength=len(pairs))[: len(pairs)], out=self.begin[1:])

    def follow(self, first: int, last: int):
        """Adds the steps first to last."""
        for n, upto, kinds, rank in zip(self.n, self.upto, self.kinds, self.ranks, strict=True):
            if first < last:
                np.add(n, np.bincount(rank[first:last].ravel(), minlength=len(n)), out=n, casting="unsafe")
                np.cumsum(n, out=upto[1:])
                np.cumsum(n > 0, out=kinds[1:])

    def places_of(self, k: int, keys: np.ndarray) -> tuple:
        return keys, self.n[k][keys] > 0

    def contexts(self) -> tuple:
        out: list = []
        for at, upto, kinds in zip((self.first, self.begin), self.upto, self.kinds, strict=True):
            base, kinds = upto[at], kinds[at]
            total = np.diff(base)
            out.append([base[:-1] + (self.upto[0][-1] if out else 0), total, contexts(total, np.diff(kinds))])
        return out[0], [np.append(x, np.int32(0)) for x in out[1]]

    def entries(self) -> np.ndarray:
        """The cumulative count and the count of each place, as one number."""
        n = len(self.n[0])
        out = np.empty((n + len(self.n[1]), 2), np.int32)
        for k, part in ((0, out[:n]), (1, out[n:])):
            part[:, 0], part[:, 1] = self.upto[k][:-1], self.n[k]
        out[n:, 0] += self.upto[0][-1]
        return out.view(np.int64).ravel()


class Model:
    """What encoder and decoder learn alike, chunk by chunk: order-0 frequencies and the shares of the orders."""

    def __init__(self, vocab: int):
        self.vocab = vocab
        self.f0 = np.ones(vocab, np.int64)
        self.holds2, self.holds1 = (np.ones((COUNTS * KINDS, 2), np.int64) for _ in range(2))
        self.followed, self.held = np.full(vocab, 2, np.int32), np.ones(vocab, np.int32)
        self.won = [8, 8]
        self.renew()

    def renew(self):
        if self.f0.sum() > 1 << 23:
            self.f0 = (self.f0 + 1) >> 1
        self.cum = np.zeros(self.vocab + 1, np.int64)
        np.cumsum(self.f0, out=self.cum[1:])
        self.total = int(self.cum[-1])
        self.share2, self.share1 = (np.clip((t[:, 1] << SHARE) // t.sum(axis=1), 32, 32000).astype(np.int32) for t in (self.holds2, self.holds1))
        self.share1[0] = 0  # the class of what has seen nothing
        self.by_prev = np.clip((self.held << SHARE) // self.followed, 32, 32000)
        weight = self.won[0] * 32 // sum(self.won)
        self.part2, self.part1 = np.int32(weight) * self.share2, np.int32(32 - weight) * self.by_prev

    def rows(self, base, total, classes) -> np.ndarray:
        """Of the contexts of one id: the cumulative count before, the sum, the share of order 1 and the id's part in that of order 2."""
        return rows_of([base, total, self.share1[classes], self.part1])

    def shares(self, class2, share1, part1) -> tuple:
        """Of 2^SHARE the shares of order 2 and order 1; none for one that has seen nothing."""
        q2 = self.part2[class2]
        q2 += part1
        q2 >>= 5
        q2 *= class2 > 0
        q1 = (1 << SHARE) - q2
        q1 *= share1
        q1 >>= SHARE
        return q2, q1

    def learn(self, before1, escaped, choice, class2, classes):
        """From a chunk: of some ids the id before, the choice and the class of the context of two; the ids by order 0; and the classes of all contexts of one id."""
        class1 = classes[before1]
        hit, known = choice == 0, class2 > 0
        a, b = self.share2[class2], self.by_prev[before1]
        good, all_ = int(np.count_nonzero(((a > b) == hit) & known)), int(np.count_nonzero(known))
        self.won = [self.won[0] + good, self.won[1] + all_ - good]
        while sum(self.won) > 1 << 16:
            self.won = [(w >> 1) + 1 for w in self.won]
        for table, seen in ((self.holds2, class2 * 2 + hit), (self.holds1, np.where(hit, 0, class1 * 2 + (choice == 1)))):
            table += np.bincount(seen, minlength=table.size).reshape(table.shape)
            big = table.sum(axis=1) > 1 << 16
            table[big] = (table[big] >> 1) + 1
        seen = np.bincount(np.where(known, before1 * 2 + hit, 2 * self.vocab), minlength=2 * self.vocab + 1)[:-1].reshape(-1, 2).astype(np.int32)
        self.followed += seen[:, 0] + seen[:, 1]
        self.held += seen[:, 1]
        big = self.followed > 1 << 12
        self.followed[big], self.held[big] = (self.followed[big] >> 1) + 2, (self.held[big] >> 1) + 1
        self.f0 += 32 * np.bincount(escaped, minlength=self.vocab)
        self.renew()


def settle(low, rng, shift):
    """Renormalises lanes; shift(lanes, lows) moves one word of the given lanes out or in before they shift."""
    settled = (low ^ (low + rng)) < TOP
    at = np.flatnonzero(settled | (rng < BOT))
    l, r, settled = low[at], rng[at], settled[at]
    while len(at):
        cut = np.flatnonzero(~settled)
        if len(cut):
            r[cut] = (~l[cut] + U(1)) & (BOT - U(1))
        shift(at, l)
        l <<= U(16)
        r <<= U(16)
        low[at], rng[at] = l, r
        settled = (l ^ (l + r)) < TOP
        go = np.flatnonzero(settled | (r < BOT))
        at, l, r, settled = at[go], l[go], r[go], settled[go]


def epochs(steps: int):
    """Steps (first, last) between which the counts stay. They are not renewed for a rest of less than half of what they hold."""
    at, end = 0, 1
    while at < steps:
        end = steps if steps - end < end // 2 else end
        yield at, end
        at, end = end, end * GROWTH


def chunks(first: int, last: int):
    """Steps between which the model stays, too."""
    return ((t, min(t + RENEW, last)) for t in range(first, last, RENEW))


def encode_block(ids: np.ndarray, vocab: int) -> bytes:
    """One block's bytes."""
    n = len(ids)
    lanes = max(1, min(LANES, n // PER_LANE))
    steps = -(-n // lanes)
    dealt = np.zeros(lanes * steps, np.int32)
    dealt[:n] = ids
    every = np.zeros((steps + 1, lanes), np.int64)  # a step of no ids comes first
    every[1:] = dealt.reshape(lanes, steps).T
    before1, grid = every[:-1], every[1:]
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    by, out = [], []

    def shift(at, lows):
        by.append(at.astype(np.uint16))
        out.append((lows >> U(48)).astype("<u2"))

    m, counts = Model(vocab), Ranked(vocab, before1, grid) if steps else None
    none = len(counts.keys[0]) if steps else 0
    before = 0
    for begin, end in epochs(steps):
        counts.follow(before, begin)
        before = begin
        one, two = counts.contexts()
        by_two, entries = rows_of(two), counts.entries()
        at1, in1 = counts.find(0, counts.ranks[0][max(begin - 1, 0) : end])
        pairs = np.where(in1, at1, none)
        if begin:
            at1, in1 = at1[1:], in1[1:]
        else:
            pairs = np.concatenate([np.full((1, lanes), none), pairs])
        at2, in2 = counts.find(1, counts.ranks[1][begin:end])
        for first, last in chunks(begin, end):
            here = slice(first - begin, last - begin)
            x, b1, pair, place1, place2, hit, middle = (v.ravel() for v in (grid[first:last], before1[first:last], pairs[here], at1[here], at2[here], in2[here], in1[here]))
            middle = middle & ~hit
            escape = ~(hit | middle)
            e = np.flatnonzero(escape)
            base2, total2, class2, _ = taken(by_two, pair)
            base1, total1, *known = taken(m.rows(*one), b1)
            q2, q1 = m.shares(class2, *known)
            both = q2 + q1
            starts1, sizes1 = np.where(escape, both, q2 * middle), np.where(hit, q2, np.where(middle, q1, (1 << SHARE) - both))
            entry = entries[np.where(hit, place2 + none, place1)].view(np.int32).reshape(-1, 2)
            starts, sizes, totals = entry[:, 0] - np.where(hit, base2, base1), entry[:, 1].copy(), np.where(hit, total2, total1)
            y = x[e]
            starts[e], sizes[e], totals[e] = m.cum[y], m.f0[y], m.total
            for s1, z1, s, z, total in zip(*(v.astype(np.uint64).reshape(-1, lanes) for v in (starts1, sizes1, starts, sizes, totals)), strict=True):
                rng >>= U(SHARE)
                low += s1 * rng
                rng *= z1
                rng //= total
                low += s * rng
                rng *= z
                settle(low, rng, shift)
            m.learn(b1[::LEARN], y, (middle + 2 * escape)[::LEARN], class2[::LEARN], one[2])
    for _ in range(4):
        shift(np.arange(lanes), low)
        low <<= U(16)
    by = np.concatenate(by)
    words = np.concatenate(out)[np.argsort(by, kind="stable")]
    head = MAGIC + struct.pack("<IIII", n, vocab, lanes, zlib.crc32(ids.astype("<u4").tobytes()))
    body = head + np.bincount(by, minlength=lanes).astype("<u4").tobytes() + words.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(data: bytes) -> np.ndarray:
    """A block's ids; ValueError where a checksum or the form is wrong."""
    if len(data) < 24 or data[:4] != MAGIC or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a block, or a damaged one")
    n, vocab, lanes, crc = struct.unpack("<IIII", data[4:20])
    if not n:
        return np.zeros(0, np.int64)
    size = np.frombuffer(data, "<u4", lanes, 20).astype(np.int64)
    words = np.frombuffer(data, "<u2", int(size.sum()), 20 + 4 * lanes)
    steps = -(-n // lanes)
    low, rng, code, pos = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64), np.cumsum(size) - size
    for _ in range(4):
        code = (code << U(16)) | words[pos]
        pos += 1

    def shift(at, _):
        p = pos[at]
        code[at] = (code[at] << U(16)) | words[p]
        pos[at] = p + 1

    counts, m = Counts(vocab), Model(vocab)
    out = np.zeros((steps + 2, lanes), np.int64)  # two steps of no ids come first
    for begin, end in epochs(steps):
        pair = counts.pairs(out[begin], out[begin + 1])
        one, two = counts.contexts()
        by_two, none = rows_of(two), len(counts.keys[0])
        held, entries = counts.entries()
        memo = entries.view(np.int32).reshape(-1, 4)[:, 1]
        for first, last in chunks(begin, end):
            by_one, cum = m.rows(*one), m.cum.astype(np.int32)
            seen: list = []
            for t in range(first, last):
                b1 = out[t + 1]
                base2, total2, class2, _ = taken(by_two, pair)
                base1, total1, *known = taken(by_one, b1)
                q2, q1 = m.shares(class2, *known)
                both = q2 + q1
                rng >>= U(SHARE)
                v = ((code - low) // rng).astype(np.int64)
                hit, escape = v < q2, v >= both
                middle = ~(hit | escape)
                low += np.where(escape, both, q2 * middle).astype(np.uint64) * rng
                rng *= np.where(hit, q2, np.where(middle, q1, (1 << SHARE) - both)).astype(np.uint64)
                totals, base = np.where(hit, total2, total1), np.where(hit, base2, base1)
                e = np.flatnonzero(escape)
                totals[e] = m.total
                rng //= totals.astype(np.uint64)
                v = np.minimum(((code - low) // rng).astype(np.int64), totals - 1)
                y = cum.searchsorted(v[e].astype(np.int32), "right") - 1
                v += base
                v[e] = 0
                at = held[v]
                x, following, start, size = taken(entries, at)
                start -= base
                x[e], following[e], start[e], size[e] = y, none, cum[y], m.f0[y]
                low += start.astype(np.uint64) * rng
                rng *= size.astype(np.uint64)
                settle(low, rng, shift)
                out[t + 2] = x
                seen.append((b1, middle + 2 * escape, class2, y))
                pair = following.astype(np.int64)
                new = np.flatnonzero(following < 0)
                if len(new):
                    pair[new] = f = counts.pairs(b1[new], out[t + 2, new])
                    memo[at[new]] = f
            *of_lanes, escaped = zip(*seen, strict=True)
            b1, choice, class2 = (np.concatenate(x)[::LEARN] for x in of_lanes)
            m.learn(b1, np.concatenate(escaped), choice, class2, one[2])
        if end < steps:
            counts.add(out[begin:end], out[begin + 1 : end + 1], out[begin + 2 : end + 2])
    ids = out[2:].T.ravel()[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids do not match their checksum")
    return ids
