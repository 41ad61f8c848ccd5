"""Secret scans with corpus-wide ownership frequency.

Patterns give the base spans and, as candidates, further long mixed tokens. Candidate hashes are then
aggregated over the corpus by distinct repositories and owners: a value that many share is a copied
example, one that a single owner holds looks live. Live-looking candidates are added as `owned` spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG = re.compile("[A-Za-z0-9+/_-]+")
WORDS = ("passw", "secret", "token", "api")
#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "owned")
#: A further candidate has as many characters, of all three kinds, and as many bits of entropy a character.
LEAST, BITS = 20, 3.5
HEX_RUN, LONG_RUN = (bytes(49 if chr(b) in of else 48 for b in range(256)) for of in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))


def base_spans(text: str, raw: bytes) -> list:
    """(start, kind number, end) of the base patterns, sorted."""
    out, low = [], text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in raw.translate(HEX_RUN):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def mixed(token: str) -> bool:
    """Whether a token has upper and lower case, a digit and the entropy of a random key."""
    if not (any("0" <= c <= "9" for c in token) and any("a" <= c <= "z" for c in token) and any("A" <= c <= "Z" for c in token)):
        return False
    n = len(token)
    return sum(-k / n * math.log2(k / n) for k in Counter(token).values()) >= BITS


def further(text: str, raw: bytes, base: list) -> list:
    """(start, end) of long mixed tokens outside the base spans."""
    if b"1" * LEAST not in raw.translate(LONG_RUN):
        return []
    found = [(m.start(), m.end()) for m in LONG.finditer(text) if m.end() - m.start() >= LEAST and mixed(m[0])]
    return [(s, e) for s, e in found if not any(s < y and x < e for x, _, y in base)]


def value_hash(text: str, start: int, kind: int, end: int) -> int:
    """Of a candidate's value: an assignment's is what follows its sign."""
    value = text[start:end]
    if kind == 0:
        value = ASSIGN.match(value)[2]
    return xxhash.xxh64_intdigest(value.encode(), 42) - (1 << 63)


def scan(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """A row a document: its ids, base span counts and digest, and candidates (hash, kind, start, end)."""
    kinds = "doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, candidates array<struct<hash: long, kind: int, start: int, end: int>>"
    cand = pa.list_(pa.struct([("hash", pa.int64()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            counts, digests, found = ([], [], []), [], []
            for text in batch.column(3).to_pylist():
                text = text or ""
                raw = text.encode()
                base = base_spans(text, raw)
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                every = base + [(s, 3, e) for s, e in further(text, raw, base)]
                found.append([{"hash": value_hash(text, s, k, e), "kind": k, "start": s, "end": e} for s, k, e in every])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(found, cand)], names=["doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "candidates"])

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    return taken.mapInArrow(run, kinds)


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of (hash, repo, owner): distinct ones are counted after a distinct with map-side combine."""
    seen = candidates.select("hash", "repo", "owner").distinct()
    owners = seen.select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("n_owners"))
    repos = seen.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("n_repos"))
    return owners.join(repos, "hash")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", owners: int = 1, repos: int = 2) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied): one row per input row.

    A candidate is live-looking if at most `owners` distinct owners and at most `repos` distinct
    repositories hold its value, else copied; null owners and repositories are not counted. Base spans
    always stay, whatever their class; `owned` spans are the live-looking further candidates. A null text
    counts as empty and has no spans; repeated rows each get their result; an empty table gives none.
    """
    rows = cut(scan(docs, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()))
    each = rows.select("row", "repo", "owner", F.explode("candidates").alias("c")).select("row", "repo", "owner", "c.*")
    freq = ownership(each)
    judged = each.join(freq, "hash").withColumn("live", (F.col("n_owners") <= owners) & (F.col("n_repos") <= repos))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    shown = judged.where("kind < 3 OR live").select("row", F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span")).alias("s"), "live").unionByName(judged.where("kind = 3 AND NOT live").select("row", F.lit(None).alias("s"), "live"), allowMissingColumns=True)
    per = shown.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["span"]), ",").alias("spans"), F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"))
    zero = F.lit(0).cast("long")
    return rows.join(per, "row", "left").select(F.col("doc_id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
