"""Language identification by a bidirectional gated recurrent network over bytes.

One recurrent layer reads the bytes forwards, one backwards; at every byte their
two states give the probabilities of the languages, and a document's
probabilities are the mean over its bytes.  The gates use x / (1 + |x|), which
numpy computes fast.  The network is trained in numpy by backpropagation
through time on pieces of a bounded sample of documents.

Texts are read whole, in segments of ``SEGMENT`` bytes that each start with an
empty state, so all segments of a batch advance together.

Defined results
    null text, or one without a letter   language ``und``, score 0
    nothing to learn from                every text is ``und`` with score 0
    one language only                    that language, score 1
    ties                                 the first language in order of code points
    very long texts                      more segments; memory is bounded by ``ROWS`` segments at a time
    repeated rows                        one result each; other columns are not carried
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch

HIDDEN = 12
SEGMENT = 256
ROWS = 2048
PIECE = 64
MAX_DOCS, MIN_DOCS = 80_000, 20
CELLS = 1 << 15
F4 = np.float32


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * squash(x)


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``squash`` by its value."""
    return (1 - np.abs(y)) ** 2


class Net:
    """``inp``: what each byte adds to update gate, reset gate and candidate (3 x 256 x H);
    ``rec``: from the state (3 x H x H); both for each direction; ``out``: 2 x H x languages; ``bias``."""

    NAMES = ("inp", "rec", "out", "bias")

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.inp = rng.normal(0, 0.5, (2, 3, 256, hidden)).astype(F4)
        self.rec = rng.normal(0, hidden ** -0.5, (2, 3, hidden, hidden)).astype(F4)
        self.out = rng.normal(0, hidden ** -0.5, (2, hidden, len(langs))).astype(F4)
        self.bias = np.zeros(len(langs), F4)

    def step(self, d: int, x: np.ndarray, h: np.ndarray) -> tuple:
        """New state and the values that the backward pass needs."""
        (iz, ir, ic), (uz, ur, uc) = self.inp[d], self.rec[d]
        z, r = gate(iz[x] + h @ uz), gate(ir[x] + h @ ur)
        s = r * h
        c = squash(ic[x] + s @ uc)
        return h + z * (c - h), z, r, s, c

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all bytes of ``x`` (rows of bytes) labelled ``y``, and its gradients."""
        n, length = x.shape
        trace, states = [[], []], [[], []]
        for d in (0, 1):
            h = np.zeros((n, self.rec.shape[-1]), F4)
            for t in range(length) if d == 0 else range(length - 1, -1, -1):
                new, *rest = self.step(d, x[:, t], h)
                trace[d].append((t, h, *rest))
                states[d].append(new)
                h = new
        forth, back = np.stack(states[0]), np.stack(states[1][::-1])
        logits = forth @ self.out[0] + back @ self.out[1] + self.bias
        p = np.exp(logits - logits.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        loss = -np.log(p[:, np.arange(n), y] + 1e-9).mean()
        p[:, np.arange(n), y] -= 1
        p /= n * length
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        g["bias"] = p.sum((0, 1))
        for d, own in ((0, forth), (1, back)):
            g["out"][d] = np.einsum("tnh,tnc->hc", own, p)
            far = p @ self.out[d].T  # what each state's own byte asks for
            dh = np.zeros_like(own[0])
            uz, ur, uc = self.rec[d]
            for t, h, z, r, s, c in reversed(trace[d]):
                dh = dh + far[t]
                dc = dh * z * slope(c)
                dz = dh * (c - h) * 0.5 * slope(2 * z - 1)
                ds = dc @ uc.T
                dr = ds * h * 0.5 * slope(2 * r - 1)
                for k, (v, by) in enumerate(((dz, h), (dr, h), (dc, s))):
                    np.add.at(g["inp"][d, k], x[:, t], v)
                    g["rec"][d, k] += by.T @ v
                dh = dh * (1 - z) + ds * r + dz @ uz.T + dr @ ur.T
        return float(loss), g

    def run(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each row of the languages' probabilities.

        Rows are sorted by size, longest first: at each step only rows that
        still have bytes take part."""
        n, length = x.shape
        hid = self.rec.shape[-1]
        logits = np.zeros((length, n, len(self.langs)), F4)
        live = np.searchsorted(-size, -np.arange(length), "left")  # rows longer than t
        every = np.arange(n)
        for d in (0, 1):
            gates_in, gates_rec = np.concatenate(self.inp[d, :2], 1), np.concatenate(self.rec[d, :2], 1)
            cand_in, cand_rec = self.inp[d, 2], self.rec[d, 2]
            state = np.zeros((n, hid), F4)
            for t in range(int(size[0]) if n else 0):
                m = live[t]
                at = t if d == 0 else size[:m] - 1 - t
                byte = x[:m, t] if d == 0 else x[every[:m], at]
                h = state[:m]  # advanced in place
                g = h @ gates_rec
                g += gates_in.take(byte, 0)
                g /= 1 + np.abs(g)
                g *= 0.5
                g += 0.5
                c = (g[:, hid:] * h) @ cand_rec
                c += cand_in.take(byte, 0)
                c /= 1 + np.abs(c)
                c -= h
                c *= g[:, :hid]
                h += c
                if d == 0:
                    logits[t, :m] = h @ self.out[0] + self.bias
                else:
                    logits[at, every[:m]] += h @ self.out[1]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        logits *= (np.arange(length)[:, None] < size)[:, :, None]
        return logits.sum(0, dtype=np.float64)


def train(pieces: list[bytes], labels: list[str], steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Net | None:
    """Fit on labelled pieces; batches take the languages in equal shares.  Adam, with a rate that falls to zero."""
    langs = sorted(set(labels))
    if not langs:
        return None
    net = Net(langs, seed=seed)
    if len(langs) == 1:
        return net
    x = np.stack([np.frombuffer((p * (PIECE // len(p) + 1))[:PIECE], np.uint8) for p in pieces])  # short ones are repeated
    place = {v: k for k, v in enumerate(langs)}
    y = np.array([place[v] for v in labels])
    rows = [np.flatnonzero(y == k) for k in range(len(langs))]
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in net.NAMES} for _ in "ab")
    for i in range(1, steps + 1):
        pick = np.array([rng.choice(rows[k]) for k in rng.permutation(np.arange(max(batch, len(langs))) % len(langs))])
        _, g = net.gradients(x[pick], y[pick])
        norm = max(1.0, float(np.sqrt(sum((v * v).sum() for v in g.values()))))
        lr = rate * (1 - i / (steps + 1))
        for k in net.NAMES:
            v = g[k] / norm
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            getattr(net, k)[...] -= lr * (first[k] / (1 - 0.9 ** i)) / (np.sqrt(second[k] / (1 - 0.99 ** i)) + 1e-6)
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def identify(texts: list[str | None], net: Net | None) -> tuple[list[str], list[float]]:
    """Language and pooled probability of each text."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if net is None:
        return langs, scores
    total, owner, parts = np.zeros((len(texts), len(net.langs))), [], []
    size = np.zeros(len(texts))
    at_once = max(16, min(ROWS, CELLS // len(net.langs)))  # a probability for each byte and language

    def flush() -> None:
        lens = np.array([len(p) for p in parts])
        order = np.argsort(-lens, kind="stable")
        x = np.zeros((len(parts), SEGMENT), np.uint8)
        for row, i in enumerate(order):
            x[row, :lens[i]] = np.frombuffer(parts[i], np.uint8)
        np.add.at(total, np.array(owner)[order], net.run(x[:, :lens[order[0]]], lens[order]))
        owner.clear(), parts.clear()

    for i, t in enumerate(texts):
        if has_letter(t):
            raw = t.encode()
            size[i] = len(raw)
            for at in range(0, len(raw), SEGMENT):
                parts.append(raw[at:at + SEGMENT])
                owner.append(i)
                if len(parts) == at_once:
                    flush()
    if parts:
        flush()
    for i in np.flatnonzero(size):
        p = total[i] / size[i]
        k = int(p.argmax())
        langs[i], scores[i] = net.langs[k], float(min(max(p[k], 0.0), 1.0))
    return langs, scores


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_docs: int = 400, pieces: int = 6) -> Net | None:
    """Train on ``pieces`` pieces each of about ``max_docs`` documents of each
    language, from places spread over the whole texts.  Every language that
    occurs is learned; of many, fewer documents each, so that there are about
    ``MAX_DOCS`` in all (the bound on what the driver holds), ``MIN_DOCS`` at least."""
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("y")) \
        .filter(F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = rows.groupBy("y").count().collect()
    if not counts:
        return None
    each = min(max_docs, max(MIN_DOCS, MAX_DOCS // len(counts)))
    share = [(r.y, min(1 << 20, int((1 << 20) * each / r["count"]) + 1)) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(share, "y string, share long"))  # a row a language
    at = lambda j: F.pmod(F.xxhash64("k", F.lit(j)), F.greatest(F.length("t") - (PIECE - 1), F.lit(1))).cast("int") + 1
    picked = rows.join(share, "y").filter(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)) < F.col("share")) \
        .select("y", "k", F.array(*(F.substring("t", at(j), F.lit(PIECE)) for j in range(pieces))).alias("p"))
    got = sorted(picked.limit(2 * each * len(counts)).collect(), key=lambda r: (r.y, r.k or "", r.p))
    both = [(p.encode(), r.y) for r in got for p in r.p if p]
    return train([p for p, _ in both], [y for _, y in both])


def predict(docs: DataFrame, net: Net | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ``lang_pred`` and ``score`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kB, whatever the input
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            schema = pa.schema([b.schema.field("key"), ("lang_pred", pa.string()), ("score", pa.float64())])
            yield record_batch(schema, [b.column("key"), *identify(b.column("text").to_pylist(), sent.value)])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)
