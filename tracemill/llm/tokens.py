"""Token-id output: documents in id order, as blocks of the adaptive context-mixing range coder."""

from __future__ import annotations

import json
import zlib
from array import array
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import shared_dir

#: Ids after which a block closes at the end of its document.
BLOCK = 1 << 21
#: Pieces after which a worker starts a new cache of their ids, at some 250 bytes each. It keeps the one before
#: and takes over what recurs, so that only pieces that have not come again since are forgotten. Parts of
#: pieces have a cache of a quarter of that.
CACHE = 250_000
#: Bytes of text that are split at once, in whole documents.
SLICE = 1 << 20
#: Parts a worker remembers, at some 50 bytes each, and the bytes of the longest that are packed; longer ones have a cache of a 64th of that.
PARTS, PACKED = 1 << 20, 31
#: The bytes of a part that are packed with their number into its first two words; most parts have no more.
NEAR = 15
#: The end of a document.
END = 2

_tokenizers: dict = {}


def byte_letters() -> dict:
    """The letters that byte-level vocabularies write bytes as: printable ones themselves, the others in order from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


class Encoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, a piece at a time, and remembers pieces.

    The vocabulary's pattern never matches across the step from a character that is no white space to
    one that is, so a text split at such single spaces encodes as its pieces do. Other texts, with two
    white-space characters in a row at a split or with the string of an added token, are encoded whole. A new piece is split by the pattern
    and each part goes to the library's model; other kinds of tokenizers encode it with all their steps.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.vocab = self.tok.get_vocab_size()
        self.kind = np.uint16 if self.vocab <= 1 << 16 else np.uint32
        form = json.loads(self.tok.to_str())
        pre = form["pre_tokenizer"] or {}
        self.by_parts = form["model"]["type"] == "BPE" and not form["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.parts = regex.compile(self.PATTERN).findall
        self.letters = byte_letters()
        self.space = chr(self.letters[32])
        self.code = "H" if self.kind is np.uint16 else "I"
        self.cache: dict = {}
        self.older: dict = {}
        self.ends: dict = {}
        self.split: dict = {}
        self.older_split: dict = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def part(self, part: str) -> bytes:
        """The ids of a part as the pattern splits it."""
        if part.isascii() and part[1:].isalnum():
            part = self.space + part[1:] if part[0] == " " else part
        else:
            part = part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.tok.model.tokenize(part)]).tobytes()

    def known(self, piece: str) -> bytes | None:
        """The ids of a piece that is remembered, which stays so."""
        out = self.cache.get(piece)
        if out is None:
            out = self.older.get(piece)
            if out is not None:
                self.cache[piece] = out
        return out

    def recurring(self, part: str) -> bytes:
        """As part(), of a part that may be a piece with its space, and is remembered else."""
        out = self.cache.get(part[1:]) if part[0] == " " else None
        if out is None:
            out = self.split.get(part)
            if out is None:
                out = self.split[part] = self.older_split.get(part) or self.part(part)
        return out

    def piece(self, piece: str) -> bytes | None:
        """The ids of a piece with the space before it, or None if it does not stand alone."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if not self.by_parts:
            return self.whole(" " + piece)
        if piece.isalpha():
            return self.part(" " + piece)
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            out = self.known(piece[:-1])
            if out is None:
                out = self.cache[piece[:-1]] = self.part(" " + piece[:-1])
            end = self.ends.get(piece[-1])
            if end is None:
                end = self.ends[piece[-1]] = self.part(piece[-1])
            return out + end
        return b"".join(map(self.recurring, self.parts(" " + piece)))

    def encode(self, texts: list) -> list:
        """The ids of each text, as arrays."""
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        if len(self.split) > CACHE // 4:  # most are the first words of lines
            self.older_split, self.split = self.split, {}
        cache, out = self.cache, []
        for text in texts:
            if any(a in text for a in self.added):
                out.append(self.whole(text))
                continue
            first, *pieces = text.split(" ")
            got = [*map(cache.get, pieces)]
            alone = not first or not first[-1].isspace()
            if alone:
                for i in [i for i, x in enumerate(got) if x is None]:
                    x = self.known(pieces[i])
                    if x is None:
                        x = self.piece(pieces[i])
                        if x is None:
                            alone = False
                            break
                        cache[pieces[i]] = x
                    got[i] = x
            if alone and (first or not pieces):
                out.append(self.whole(first) + b"".join(got))
            else:
                out.append(self.whole(text))
        return [np.frombuffer(x, self.kind) for x in out]


class Parts:
    """Encodes many texts at once with an Encoder whose pattern splits them into parts (`by_parts`).

    All bytes of a slice are split by numpy, as the pattern would, and every part is looked up in a table by
    its bytes, packed with their number into words, so that equal keys are equal parts. Only parts that are
    not there go to the library. What kind of character one is, the library's own splitting tells.
    """

    LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)

    def __init__(self, enc: Encoder):
        self.enc = enc
        self.model = enc.tok.model
        self.pre = enc.tok.pre_tokenizer.pre_tokenize_str
        self.added = [a.encode() for a in enc.added]
        self.letter = np.array([enc.letters.get(b, b) for b in range(256)], "<u4")
        self.kinds = np.full(0x110000, self.UNKNOWN, np.uint8)
        self.classes = bytes([*map(self.kind_of, map(chr, range(128))), *[self.UNKNOWN] * 128])
        self.masks = [np.array([(1 << 8 * min(max(n - first, 0), size)) - 1 for n in range(PACKED + 1)], np.uint64) for first, size in ((0, 8), (8, 7), (15, 8), (23, 8))]
        self.lengths = np.arange(PACKED + 1, dtype=np.uint64) << np.uint64(56)
        self.long: dict = {}
        self.start()

    def start(self):
        """An empty table. Entry 0 is of no part, and what free places hold."""
        self.n = 1
        self.keys = np.zeros((1024, 4), np.uint64)
        self.runs, self.used = np.zeros(1024, np.int64), np.zeros(1024, bool)  # a run of ids: where it begins << 8 | how many
        self.ids, self.held = np.zeros(4096, self.enc.kind), 0
        self.bits = 11
        self.table = np.zeros(1 << self.bits, np.int32)

    def kind_of(self, c: str) -> int:
        return next((k for k, x in ((self.LETTER, "a"), (self.NUMBER, "1"), (self.OTHER, "!")) if len(self.pre(x + c)) == 1), self.SPACE)

    def classed(self, data: bytes, buf: np.ndarray) -> np.ndarray:
        """The kind of each byte's character."""
        cls = np.frombuffer(data.translate(self.classes), np.uint8)
        if data.isascii():
            return cls
        data.decode()  # an error if it is not UTF-8
        cls, lead = cls.copy(), np.flatnonzero(buf[: len(cls)] >= 0xC0)
        first = buf[lead]
        width = 2 + (first >= 0xE0) + (first >= 0xF0).astype(np.int64)
        point = first & 0x7F >> width
        for k in (1, 2, 3):
            point = np.where(width > k, point << 6 | buf[lead + k] & 0x3F, point)
        kinds = self.kinds[point]
        if (kinds == self.UNKNOWN).any():
            for p in np.unique(point[kinds == self.UNKNOWN]).tolist():
                self.kinds[p] = self.kind_of(chr(p))
            kinds = self.kinds[point]
        cls[lead] = kinds
        for k in (1, 2, 3):
            wide = width > k
            cls[lead[wide] + k] = kinds[wide]
        return cls

    def split(self, data: bytes, buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where parts start in texts that begin at `begins`; buf has zeros after the data."""
        n = len(data)
        cls = self.classed(data, buf)
        begin = np.zeros(n + 1, bool)
        begin[begins] = True
        space = cls == self.SPACE
        start = begin[:-1].copy()
        start[1:] |= (cls[1:] != cls[:-1]) & ((buf[: n - 1] != 32) | space[1:])  # a space goes with what follows
        start[:-1] |= space[:-1] & ~space[1:] & ~begin[1:-1]  # as the last of several
        inside = np.flatnonzero(start & (buf[:n] & 0xC0 == 0x80))
        start[inside] = False
        for _ in range(3):
            inside -= buf[inside] & 0xC0 == 0x80
        start[inside] = True
        at = np.flatnonzero(start[:-1] & (buf[: n - 1] == 39) & (cls[1:] == self.LETTER) & ~begin[1:-1])
        if len(at):  # 's 't 'm 'd 're 've 'll
            a, b = buf[at + 1], np.where(begin[np.minimum(at + 2, n)], 0, buf[at + 2])
            two = (((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))
            go = two | (a == 115) | (a == 116) | (a == 109) | (a == 100)
            start[at[go] + 1] = False
            end = (at + 2 + two)[go]
            start[end[end < n]] = True
        return np.flatnonzero(start)

    def far(self, second: np.ndarray) -> np.ndarray:
        """Which keys have more than two words, by their second words."""
        return np.flatnonzero(second > self.lengths[NEAR + 1] - np.uint64(1))

    def hashed(self, keys) -> np.ndarray:
        a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        h = keys[0] * a
        h ^= h >> np.uint64(32)
        h ^= keys[1]
        h *= a
        far = self.far(keys[1])
        for k in keys[2:]:
            x = h[far]
            h[far] = (x ^ x >> np.uint64(32) ^ k[far]) * a
        h ^= h >> np.uint64(32)
        h *= b
        return h

    def places(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys) -> np.ndarray:
        """The entries of keys, 0 of those that are not there."""
        place = self.places(self.hashed(keys))
        entry = self.table[place]
        mine = self.keys.view(np.complex128)[:, 0][entry].view(np.uint64).reshape(-1, 2)  # 16 bytes are taken at once
        differs = mine[:, 0] != keys[0]
        differs |= mine[:, 1] != keys[1]
        far = self.far(keys[1])
        for k in (2, 3):
            differs[far] |= self.keys[:, k][entry[far]] != keys[k][far]
        left = np.flatnonzero(differs & (entry > 0))
        entry[differs] = 0
        while len(left):
            place[left] = (place[left] + 1) & (len(self.table) - 1)
            found = self.table[place[left]]
            same = np.logical_and.reduce([self.keys[:, k][found] == x[left] for k, x in enumerate(keys)])
            entry[left[same]] = found[same]
            left = left[~same & (found > 0)]
        return entry

    def enter(self, first: int):
        """Puts the entries from `first` on into the table."""
        if 2 * self.n > len(self.table):
            first, self.bits = 1, self.n.bit_length() + 2
            self.table = np.zeros(1 << self.bits, np.int32)
        entry = np.arange(first, self.n, dtype=np.int32)
        place = self.places(self.hashed(self.keys[first : self.n].T))
        while len(entry):
            free = self.table[place] == 0
            self.table[place[free]] = entry[free]
            left = self.table[place] != entry
            entry, place = entry[left], (place[left] + 1) & (len(self.table) - 1)

    def add(self, keys, flat: np.ndarray, size: np.ndarray):
        """New entries of distinct keys and their ids, one after the other."""
        first, self.n = self.n, self.n + len(size)
        if self.n > len(self.keys):
            room = 3 * self.n // 2
            self.keys, self.runs, self.used = (np.concatenate([x, np.zeros((room - len(x), *x.shape[1:]), x.dtype)]) for x in (self.keys, self.runs, self.used))
        if self.held + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.held], flat, np.zeros((self.held + len(flat)) // 2, self.enc.kind)])
        self.ids[self.held : self.held + len(flat)] = flat
        self.keys[first : self.n] = np.stack([*keys], axis=1)
        self.runs[first : self.n] = self.held + np.cumsum(size) - size << 8 | size
        self.held += len(flat)
        self.enter(first)

    def renew(self):
        """Forgets the parts that have not come since the last time; of more than half of the room, the newer ones too."""
        kept = 1 + np.flatnonzero(self.used[1 : self.n])[: PARTS // 2]
        keys, runs, ids = self.keys[kept].T, self.runs[kept], self.ids
        self.start()
        if len(kept):
            self.add(keys, ragged(ids, runs >> 8, runs & 255), runs & 255)

    def of_parts(self, parts: list) -> tuple:
        """The ids of parts, by the library, one after the other, and how many each has."""
        text = self.letter[np.frombuffer(b"".join(parts), np.uint8)].tobytes().decode("utf-32-le")
        ids, size, at, tokenize = [], [], 0, self.model.tokenize
        for part in parts:
            end = at + len(part)
            got = tokenize(text[at:end])
            ids += [t.id for t in got]
            size.append(len(got))
            at = end
        return np.array(ids, self.enc.kind), np.array(size, np.int64)

    def long_part(self, part: bytes) -> np.ndarray:
        ids = self.long.get(part)
        if ids is None:
            if len(self.long) > PARTS // 64:
                self.long = {}
            ids = self.of_parts([part])[0]
            if len(part) < 256:
                self.long[part] = ids
        return ids

    def encode(self, data: bytes, offsets: np.ndarray) -> tuple:
        """The ids of the texts that end where the next begins, one after the other, and how many each has."""
        if self.n > PARTS:
            self.renew()
        n = len(data)
        sizes = np.zeros(len(offsets) - 1, np.int64)
        if not n:
            return np.zeros(0, self.enc.kind), sizes
        padded = data + bytes(PACKED + 9)
        buf = np.frombuffer(padded, np.uint8)
        start = self.split(data, buf, offsets[:-1])
        length = np.diff(start, append=n)
        long = np.flatnonzero(length > PACKED)
        packed = np.minimum(length, PACKED)
        packed[long] = 0
        words = [np.ndarray((n + 8,), "<u8", padded, first, (1,)) for first in (0, 8, 15, 23)]
        keys = [words[0][start] & self.masks[0][packed], words[1][start] & self.masks[1][packed] | self.lengths[packed], *np.zeros((2, len(start)), np.uint64)]
        far = np.flatnonzero(packed > NEAR)
        for k in (2, 3):
            keys[k][far] = words[k][start[far]] & self.masks[k][packed[far]]
        entry = self.find(keys)
        missing = np.flatnonzero(entry == 0)
        missing = missing[length[missing] <= PACKED]
        if len(missing):
            new: dict = {}
            which = [new.setdefault(data[s : s + k], len(new)) for s, k in zip(start[missing].tolist(), length[missing].tolist(), strict=True)]
            which = np.array(which)
            _, one = np.unique(which, return_index=True)
            entry[missing] = self.n + which
            self.add([k[missing[one]] for k in keys], *self.of_parts([*new]))
        self.used[entry] = True
        ids, runs = self.ids, self.runs[entry]
        at, size = runs >> 8, runs & 255
        if len(long):
            others = [self.long_part(data[s : s + k]) for s, k in zip(start[long].tolist(), length[long].tolist(), strict=True)]
            size[long] = [len(x) for x in others]
            at[long] = self.held + np.cumsum(size[long]) - size[long]
            ids = np.concatenate([ids[: self.held], *others])
        flat = ragged(ids, at, size)
        upto = np.concatenate([[0], np.cumsum(size)])
        sizes = np.diff(upto[np.searchsorted(start, offsets)])
        whole = sorted({int(np.searchsorted(offsets, m, "right")) - 1 for a in self.added for m in occurrences(data, a)})
        if whole:
            texts = np.split(flat, np.cumsum(sizes)[:-1])
            for i in whole:
                texts[i] = np.frombuffer(self.enc.whole(data[offsets[i] : offsets[i + 1]].decode()), self.enc.kind)
            flat, sizes = np.concatenate(texts), np.array([*map(len, texts)], np.int64)
        return flat, sizes


def ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `size` values from `at` on, one after the other."""
    upto = np.cumsum(size)
    return values[np.repeat(at - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def occurrences(data: bytes, what: bytes):
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def parts_encoder(path: str) -> Parts | None:
    """None where the tokenizer does not split texts by the pattern."""
    enc = encoder(path)
    if enc.by_parts and ("parts", path) not in _tokenizers:
        _tokenizers["parts", path] = Parts(enc)
    return _tokenizers.get(("parts", path))


def ids_of(path: str, texts: pa.Array):
    """(first row, ids, sizes) of slices of texts, where null is empty."""
    enc, parts = encoder(path), parts_encoder(path)
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        if parts:
            data = texts.buffers()[2].slice(offsets[at], offsets[to] - offsets[at]).to_pybytes() if offsets[to] > offsets[at] else b""
            yield at, *parts.encode(data, offsets[at : to + 1] - offsets[at])
        else:
            ids = enc.encode(texts.slice(at, to - at).to_pylist())
            yield at, np.concatenate(ids), np.array([*map(len, ids)], np.int64)
        at = to


BLOCKS = "part int, block int, doc_ids array<long>, sizes array<long>, n_ids long, payload binary"


def token_blocks(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Blocks of whole documents in ascending id order (nulls first, equal ids by text hash); `part` and `block` give their order."""

    def run(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        ids, names, held, n = [], [], 0, 0

        def close():
            sizes = [len(x) for x in ids]
            payload = rangecoder.encode_block(np.concatenate(ids), max(enc.vocab, end + 1))
            cols = [pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([sum(sizes)], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "block", "doc_ids", "sizes", "n_ids", "payload"])

        for batch in batches:
            every = batch.column(0).to_pylist()
            for first, flat, sizes in ids_of(tokenizer, batch.column(1)):
                each = np.split(np.insert(flat, np.cumsum(sizes), end), np.cumsum(sizes + 1)[:-1])
                for name, x in zip(every[first : first + len(each)], each, strict=True):
                    ids.append(x)
                    names.append(name)
                    held += len(ids[-1])
                    if held >= block:
                        yield close()
                        ids, names, held, n = [], [], 0, n + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).mapInArrow(run, BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, **options) -> None:
    """Writes token_blocks() under `path`, a new folder that all executors reach, by Spark's own committer."""
    token_blocks(docs, tokenizer, **options).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in files of write_tokens(); every block's checksums are verified."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.select("part", "block", "n_ids")
    parts = totals.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    starts = totals.join(parts, "part").withColumn("first", F.col("before") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).select("part", "block", "first")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = rangecoder.decode_block(row["payload"]).astype("<u4")
                ends = np.cumsum(row["sizes"], dtype=np.int64)
                begins = ends - np.array(row["sizes"], np.int64)
                crcs = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(ends - begins), pa.array(crcs, pa.int64())], names=["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])

    each = blocks.select("part", "block", "doc_ids", "sizes", "payload").mapInArrow(run, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return each.join(starts, ["part", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Writes the ids of `docs` (under the shared folder if no path is given) and returns read_tokens() of the files.

    Null and empty texts have the end id alone. Repeated rows and ids are documents of their own. An
    empty table writes no blocks and gives no rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(spark, path)
