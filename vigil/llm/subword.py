"""Supervised subword embeddings for document quality.

A document is the average of learned vectors of its features: words, pairs of
equal neighbours and character n-grams, hashed into a table of vectors.  A softmax
layer on the average gives the class; vectors and layer are trained together
by stochastic gradient descent in numpy.

The average is linear, so a trained model folds into one number per hash slot.

Defined results
    null or empty text   no features: the score is the softmax of the bias alone
    null label           the row is not learned from
    one class or none    the prior of the labelled rows (0.5 without any)
    very long texts      every word counts; work grows with the length
    repeated rows        each is scored; other columns are not carried
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch
from .textvec import BLANK, slices, span_hashes, word_spans

SLOTS, DIM = 1 << 17, 8
REPEAT_WEIGHT = 4


def slots_of(texts: list[bytes], slots: int = SLOTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, slot) of every feature of the texts, some at a time.

    Features are words, pairs of neighbouring words that are equal (one slot,
    as the pair's pattern is hashed, not its words) and 2- to 4-grams of the
    UTF-8 bytes, blanks included as word ends."""
    for rows, data in slices(texts):
        buf = np.frombuffer(data, np.uint8)
        owner = np.repeat(rows[:, 0], rows[:, 1])
        start, end = word_spans(buf)
        words = span_hashes(buf, start, end)
        yield owner[start], (words % np.uint64(slots)).astype(np.int32)
        again = np.flatnonzero((words[1:] == words[:-1]) & (owner[start[1:]] == owner[start[:-1]]))
        for k in range(REPEAT_WEIGHT):
            yield owner[start[again]], np.full(len(again), k, np.int32)
        code = np.where(BLANK[buf], 32, buf).astype(np.uint32)
        for n in (2, 3, 4):
            m = len(code) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n * 7919, np.uint32)
            for k in range(n):
                h = (h ^ code[k:k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            inside = owner[:m] == owner[n - 1:]
            yield owner[:m][inside], (h[inside] % np.uint32(slots)).astype(np.int32)


class Model:
    """``weight``: the class-1 logit that each slot adds per unit of average; ``bias``; ``prior`` if there was nothing to learn."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def score_texts(texts: list[str | None], model: Model) -> list[float]:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, slot in slots_of([(t or "").encode() for t in texts], len(model.weight)):
        total += np.bincount(owner, model.weight[slot], len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return [logistic(model.bias + (t / k if k else 0.0)) for t, k in zip(total, n)]


def features_of(texts: list[str | None], slots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and their shares of each text: views of two long buffers, so that the driver gives their memory back after training.
    As many small arrays they would leave the heap in pieces that stay with the process."""
    slot, share, ends = array("i"), array("f"), [0]
    for t in texts:
        found = [s for _, s in slots_of([(t or "").encode()], slots)]
        ids, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
        slot.frombytes(ids.astype(np.int32).tobytes())
        share.frombytes((counts / max(counts.sum(), 1)).astype(np.float32).tobytes())
        ends.append(len(slot))
    ids, shares = np.frombuffer(slot, np.int32), np.frombuffer(share, np.float32)
    return [(ids[a:b], shares[a:b]) for a, b in zip(ends, ends[1:])]


def train(texts: list[str | None], labels: list[int], epochs: int = 6, rate: float = 0.5, batch: int = 32,
          seed: int = 17, slots: int = SLOTS, dim: int = DIM) -> Model:
    """Fit vectors, softmax layer and bias on (text, 0/1) rows.

    Each batch gathers the vectors of its documents' features, averages them,
    and scatters the gradient of the cross-entropy back; steps fall linearly to zero."""
    y = np.asarray(labels, dtype=np.int64)
    ones = int(y.sum())
    if len(y) == 0 or ones in (0, len(y)):
        p = (ones + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(slots, np.float32), math.log(p / (1 - p)))
    docs = features_of(texts, slots)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (slots, dim)).astype(np.float32)
    layer = rng.uniform(-1, 1, (dim, 2)).astype(np.float32)
    bias = np.log(np.array([len(y) - ones, ones], np.float32) / len(y))
    steps, step = epochs * -(-len(docs) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at:at + batch]
            lr = rate * (1 - step / steps)
            step += 1
            sizes = [len(docs[i][0]) for i in rows]
            ids, share = np.concatenate([docs[i][0] for i in rows]), np.concatenate([docs[i][1] for i in rows])
            owner = np.repeat(np.arange(len(rows)), sizes)
            vectors = table[ids] * share[:, None]
            mean = np.stack([np.bincount(owner, vectors[:, d], len(rows)) for d in range(dim)], 1).astype(np.float32)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1  # gradient of the cross-entropy
            back = p @ layer.T
            layer -= lr * mean.T @ p / len(rows)
            bias -= lr * p.mean(0)
            # share * slots touched is small, so the step on the table is not divided by the batch
            slot, where = np.unique(ids, return_inverse=True)
            grad = back[owner] * share[:, None]
            for d in range(dim):
                table[slot, d] -= lr * 20 * np.bincount(where, grad[:, d], len(slot)).astype(np.float32)
    return Model(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0]))


def labelled_sample(labelled: DataFrame, key: str, text: str, label: str, max_rows: int) -> tuple[list, list]:
    """At most about ``max_rows`` labelled rows, taken by a hash of the key over the whole table.

    The share is set from the count, so that rows from everywhere take part; the text of other rows is not moved."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("y").isin(0, 1))
    n = rows.select("y").count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("k", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * max_rows / n))
    got = sorted(rows.limit(max_rows + max_rows // 8).collect(), key=lambda r: (str(r.k), r.t or "", r.y))
    return [r.t for r in got], [r.y for r in got]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = 3000) -> Model:
    """Train on a bounded sample of labelled rows (``max_rows`` is the bound on what the driver holds)."""
    return train(*labelled_sample(labelled, key, text, label, max_rows))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``score`` (probability of class 1) of every row; texts are read whole."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weight, model.bias))  # SLOTS floats, whatever the input
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for b in it:
            schema = pa.schema([b.schema.field("key"), ("score", pa.float64())])
            yield record_batch(schema, [b.column("key"), score_texts(b.column("text").to_pylist(), fitted)])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep(docs: DataFrame, model: Model, min_score: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``min_score``.

    Rows pass through whole batches, so no join back is needed and repeated or null keys are no matter."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weight, model.bias))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*shared.value)
        for b in it:
            yield b.filter(pa.array([s >= min_score for s in score_texts(b.column(text).to_pylist(), fitted)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
