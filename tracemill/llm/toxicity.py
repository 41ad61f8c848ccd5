"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a row for the word itself (if the training sample knows it) and of rows for
its hashed character trigrams; a long word is several overlapping pieces. Both directions of a GRU read windows of words; attention pools their
states into one logit a window. A text's windows overlap by half and cover it whole; its logit is that
of its highest window, and the training takes gradients through each text's highest windows alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

#: Labelled rows of each class that training takes at most, and words that it knows at most.
SAMPLE, KNOWN = 2000, 20_000
WINDOW, STRIDE = 32, 16
DIM, HIDDEN, GRAMS, CHARS = 16, 8, 1 << 13, 20
EPOCHS, STEPS, BATCH, RATE = 12, 600, 128, 0.01
#: Lower case, and punctuation of ASCII as white space.
PLAIN = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256))


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def words_of(text: bytes) -> list:
    """Words of at most CHARS bytes; longer ones are cut into pieces that overlap by half or more and cover them whole."""
    words = text.translate(PLAIN).split()
    if max(map(len, words), default=0) <= CHARS:
        return words
    return [p for w in words for p in ([w] if len(w) <= CHARS else [w[i : i + CHARS] for i in (*range(0, len(w) - CHARS, CHARS // 2), len(w) - CHARS)])]


def numbered(texts: list) -> tuple:
    """The distinct words of texts, and each text as numbers of them: words take memory once, however often they come."""
    place: dict = {}
    docs = [np.fromiter((place.setdefault(w, len(place)) for w in words_of(t)), np.int32) for t in texts]
    return [*place], docs


def trigram_rows(words: list) -> np.ndarray:
    """For each word, of at most CHARS bytes, the table rows of its trigrams, with boundary marks; 0 is none."""
    wide = np.zeros((len(words), CHARS + 2), np.uint8)
    if words:
        marked = [b"^" + w + b"$" for w in words]
        flat = np.frombuffer(b"".join(marked), np.uint8)
        sizes = np.array([len(w) for w in marked])
        wide[np.arange(CHARS + 2) < sizes[:, None]] = flat
    a = wide.astype(np.uint32)
    h = (a[:, :-2] * np.uint32(2654435761) ^ a[:, 1:-1] * np.uint32(2246822519) ^ a[:, 2:] * np.uint32(3266489917)) * np.uint32(668265263)
    return np.where(a[:, 2:] > 0, 1 + (h >> np.uint32(8)) % np.uint32(GRAMS - 1), 0).astype(np.int32)


def windows_of(n: int) -> list:
    """Starts of the windows over n words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


@dataclass
class Network:
    """Weights, and the rows of known words. p: the arrays by name."""

    known: dict
    p: dict

    @classmethod
    def fresh(cls, known: dict, odds: np.ndarray, seed: int = 9):
        rng = np.random.default_rng(seed)
        r = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        p = {"word": (rng.standard_normal((len(known) + 1, DIM)) * 0.1).astype(np.float32), "gram": (rng.standard_normal((GRAMS, DIM)) * 0.05).astype(np.float32)}
        p["word"][0] = p["gram"][0] = 0
        p["word"][1:, 0] = odds
        for d in "fb":
            p |= {f"x{d}": r(DIM, 3 * HIDDEN), f"h{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"u": r(2 * HIDDEN, HIDDEN), "a": r(HIDDEN, 1)[:, 0], "o": r(2 * HIDDEN, 1)[:, 0], "bias": np.full(1, -1.0, np.float32)}
        return cls(known, p)

    def word_inputs(self, words: list):
        """Rows of distinct words in both tables."""
        return np.array([self.known.get(w, 0) for w in words], np.int32), trigram_rows(words)

    def vectors(self, rows, grams) -> np.ndarray:
        out = self.p["word"][rows]
        for k in range(grams.shape[1]):
            some = np.flatnonzero(grams[:, k])
            if not len(some):
                break
            out[some] += self.p["gram"][grams[some, k]]
        return out

    def run(self, x: dict, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. x: projected inputs of the distinct words by direction; index: their places, word by step."""
        n, steps = index.shape
        p, states, tape = self.p, np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h, at = np.zeros((n, HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                px, ph = x[d][index[:, t]], h @ p[f"h{d}"]
                rz = sigmoid(px[:, : 2 * HIDDEN] + ph[:, : 2 * HIDDEN])
                r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
                c = np.tanh(px[:, 2 * HIDDEN :] + r * ph[:, 2 * HIDDEN :])
                new = np.where(mask[:, t, None], c + z * (h - c), h)
                if keep:
                    tape[d, t] = (h, r, z, c, ph[:, 2 * HIDDEN :])
                h = states[t, :, at] = new
        q = np.tanh(states @ p["u"])
        e = np.where(mask.T, q @ p["a"], -30)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnd->nd", w, states)
        return pooled @ p["o"] + p["bias"][0], (states, q, w, pooled, tape)

    def project(self, vectors: np.ndarray) -> dict:
        return {d: vectors @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, rows, grams, index, mask, slope, held) -> dict:
        """Of the loss with the given slope by each window's logit."""
        p, (states, q, w, pooled, tape), g = self.p, held, {}
        n, steps = index.shape
        g["bias"], g["o"] = np.array([slope.sum()], np.float32), pooled.T @ slope
        dp = slope[:, None] * p["o"]
        dw = np.einsum("nd,tnd->tn", dp, states)
        de = w * (dw - (w * dw).sum(axis=0))
        dq = de[:, :, None] * p["a"] * (1 - q * q)
        g["a"], g["u"] = np.einsum("tn,tnh->h", de, q), np.einsum("tnd,tnh->dh", states, dq)
        ds = w[:, :, None] * dp + dq @ p["u"].T
        dx = {d: np.zeros((len(rows), 3 * HIDDEN), np.float32) for d in "fb"}
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            at = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            dh, g[f"h{d}"] = np.zeros((n, HIDDEN), np.float32), np.zeros_like(p[f"h{d}"])
            for t in order:
                h, r, z, c, phn = tape[d, t]
                dh = dh + ds[t, :, at]
                live = np.where(mask[:, t, None], dh, 0)
                dc = live * (1 - z) * (1 - c * c)
                gate = np.concatenate([dc * phn * r * (1 - r), live * (h - c) * z * (1 - z)], axis=1)
                dph = np.concatenate([gate, dc * r], axis=1)
                np.add.at(dx[d], index[:, t], np.concatenate([gate, dc], axis=1))
                g[f"h{d}"] += h.T @ dph
                dh = np.where(mask[:, t, None], live * z, dh) + dph @ p[f"h{d}"].T
        v = self.vectors(rows, grams)
        dv = np.zeros_like(v)
        for d in "fb":
            g[f"x{d}"], g[f"c{d}"] = v.T @ dx[d], dx[d].sum(axis=0)
            dv += dx[d] @ p[f"x{d}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], rows, dv)
        np.add.at(g["gram"], grams, dv[:, None, :])
        g["word"][0] = g["gram"][0] = 0
        return g

    def score(self, texts: list) -> np.ndarray:
        """Logit of each text: its highest window's. A text without words has one window without words."""
        return np.array([x for x, _ in self.best([words_of(t) for t in texts])], np.float32)

    def best(self, docs: list, top: int = 1) -> list:
        """For each text, as its words, its highest logit and the starts of its highest windows."""
        place: dict = {}
        flat = np.fromiter((place.setdefault(w, len(place)) for d in docs for w in d), np.int32)
        x = self.project(self.vectors(*self.word_inputs([*place])))
        if not place:
            x = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}
        flat = np.append(flat, np.zeros(WINDOW, np.int32))
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        starts = [windows_of(len(d)) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(s) for s in starts])
        inside = np.concatenate([np.array(s) for s in starts]) if docs else np.zeros(0, int)
        left = np.array([len(d) for d in docs])[owner] - inside if docs else inside
        logits = np.zeros(len(owner), np.float32)
        for at in range(0, len(owner), 4096):
            s = slice(at, at + 4096)
            index = flat[(first[owner[s]] + inside[s])[:, None] + np.arange(WINDOW)]
            mask = np.arange(WINDOW) < left[s][:, None]
            logits[s] = self.run(x, np.where(mask, index, 0), mask)[0]
        out, at = [], 0
        for s in starts:
            own = logits[at : at + len(s)]
            at += len(s)
            out.append((float(own.max()), [s[i] for i in np.argsort(-own, kind="stable")[:top]]))
        return out


def train(texts: list, labels: list, prior: float, epochs: int = EPOCHS, seed: int = 9) -> Network:
    """A network of labelled texts, its bias moved from the sample's share of label 1 to `prior`.

    As many epochs as asked for, and more where the sample is so small that they make fewer than STEPS steps.
    """
    epochs = max(epochs, -(-STEPS * BATCH // max(1, 2 * len(texts))))
    labels = np.array(labels, np.float32)
    words, docs = numbered(texts)
    seen, toxic = np.zeros((2, len(words)), np.int64)
    for d, y in zip(docs, labels, strict=True):
        own = np.unique(d)
        seen[own] += 1
        if y:
            toxic[own] += 1
    known = sorted(np.flatnonzero(seen >= 4).tolist(), key=lambda i: (-seen[i], words[i]))[:KNOWN]
    n1, n0 = max(1.0, float(labels.sum())), max(1.0, float(len(labels) - labels.sum()))
    odds = np.array([math.log((toxic[i] + 1) / (n1 + 2)) - math.log((seen[i] - toxic[i] + 1) / (n0 + 2)) for i in known], np.float32)
    net = Network.fresh({words[i]: k + 1 for k, i in enumerate(known)}, np.clip(odds, -3, 3), seed)
    if not len(texts):
        return net
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    step, weight = 0, np.where(labels > 0, len(labels) / (2 * n1), len(labels) / (2 * n0))
    log_odds = np.zeros(len(words), np.float32)
    log_odds[known] = odds
    for epoch in range(epochs):
        if epoch == 0:  # the windows of the highest log odds
            picks = []
            for d in docs:
                own = log_odds[d] if len(d) else np.zeros(1, np.float32)
                s = windows_of(len(d))
                value = [np.maximum(own[i : i + WINDOW], 0).max() for i in s]
                picks.append([s[i] for i in np.argsort(-np.array(value), kind="stable")[:1]])
        elif epoch % max(2, epochs // 6) == 0:
            picks = [s for at in range(0, len(docs), 500) for _, s in net.best([[words[w] for w in d.tolist()] for d in docs[at : at + 500]])]
        spans = [(d[s : s + WINDOW], i) for i, (d, ss) in enumerate(zip(docs, picks, strict=True)) for s in ss]
        spans += [(d[s : s + WINDOW], i) for i, d in enumerate(docs) if not labels[i] for s in [int(rng.integers(0, max(1, len(d) - WINDOW + 1)))]]
        order = rng.permutation(len(spans))
        for at in range(0, len(order), BATCH):
            some = [spans[i] for i in order[at : at + BATCH]]
            place: dict = {}
            index, mask = np.zeros((len(some), WINDOW), np.int32), np.zeros((len(some), WINDOW), bool)
            for i, (ws, _) in enumerate(some):
                ids = [place.setdefault(w if rng.random() > 0.05 else -1, len(place)) for w in ws.tolist()]
                index[i, : len(ids)], mask[i, : len(ids)] = ids, True
            rows, grams = net.word_inputs([words[w] if w >= 0 else b"?" for w in place] or [b"?"])
            own = np.array([i for _, i in some])
            logit, held = net.run(net.project(net.vectors(rows, grams)), index, mask, keep=True)
            slope = ((sigmoid(logit) - labels[own]) * weight[own] / len(some)).astype(np.float32)
            g = net.gradients(rows, grams, index, mask, slope, held)
            step += 1
            rate = RATE * (1 - step / (epochs * -(-len(order) // BATCH) + 1))
            for k in g:
                grad = g[k] + (1e-5 * net.p[k] if k in ("word", "gram") else 0)
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    net.p["bias"] = net.p["bias"] + np.float32(math.log(prior / (1 - prior)))
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, holdout: int = 5):
    """(texts, labels, share of label 1): at most `limit` rows of each class by a hash of their id, none whose crc32(id) mod holdout is 0."""
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % holdout != 0).select("doc_id", "toxic")
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = own.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(limit).union(own.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(limit))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic").collect()  # 2 * limit rows
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return [(r.text or "").encode() for r in rows], [r.toxic for r in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted): one row per input row, scored over the whole text.

    Null and empty texts are scored as texts without words. held_out is null for a null id. Without
    labelled rows all texts get the untrained network's score at the least prior. Repeated rows get equal
    scores; an empty table gives none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    net = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(own, labels, limit)))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            logits = [net.value.score(texts[at : at + 1500]) for at in range(0, len(texts), 1500)]
            p = sigmoid(np.concatenate([np.zeros(0, np.float32), *logits]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = own.mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored.select(F.col("doc_id").alias(id_col), held.alias("held_out"), "score", "predicted")


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that are predicted toxic; the rows pass through the scoring whole."""
    net = docs.sparkSession.sparkContext.broadcast(train(*labelled_sample(docs.select("doc_id", "text"), labels)))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1500):
                rows = batch.slice(k, 1500)
                yield rows.filter(pa.array(net.value.score(texts_of(rows.column(at))) < 0))

    return docs.mapInArrow(run, docs.schema)
