"""Importance resampling towards a target distribution, with an Aho-Corasick dictionary.

The different words of some megabytes of text, bounded by delimiters, go into an automaton; each carries its CRC-32
and its length in bytes.  A scan of the texts emits these payloads in order, and adjacent payloads compose: the CRC of
two strings in a row follows from their CRCs and the length of the second, so runs of words get
their bucket without being written out.  Counts of the buckets in the corpus and in the target give each
bucket a gain, documents the mean of their features' gains, and a seeded draw by perturbed weights the sample.

A dictionary serves ``SLICE`` bytes of text, so its size doesn't grow with the corpus.  A longer text is
scanned slice by slice, cut at delimiters; a word longer than ``FRAGMENT`` bytes goes in as fragments that compose likewise.

Defined results
    null, empty or wordless text   no features, weight 0
    very long texts or words       whole, in slices or fragments
    ties of the score              the smaller key first
    null key                       drawn with the hash of the seed alone, before other keys
    repeated rows                  each counts and is drawn by itself
    empty corpus or target         its counts are 0; an empty corpus gives no rows
    other columns                  are not carried; the result has the columns below only
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from zlib import crc32

from .common import positions, stored

SLICE = 1 << 22
FRAGMENT = 512
GLUE = b"\x01"  # between fragments of a word; never in a normalised text
#: Lower-cases A-Z; every ASCII byte but digits and letters becomes a blank.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CUT = re.compile(rb"([^ ]{%d})(?=[^ ])" % FRAGMENT)
BOUNDED = re.compile(rb"(?=([ \x01][^ \x01]+[ \x01]))")
SPACE = np.uint32(crc32(b" "))
U = np.uint32


@lru_cache(maxsize=1)
def zero_tables() -> list[np.ndarray]:
    """Tables (4 x 256) that append 1, 2, 4, ... zero bytes to a CRC."""
    bits = np.arange(256, dtype=U)
    for _ in range(8):
        bits = np.where(bits & 1, (bits >> 1) ^ U(0xEDB88320), bits >> 1).astype(U)
    images = np.array([bits[v & 255] ^ U(v >> 8) for v in (1 << k for k in range(32))], U)
    out = []
    for _ in range(40):
        table = np.zeros((4, 256), U)
        for byte in range(4):
            for bit in range(8):
                on = (np.arange(256) >> bit & 1).astype(bool)
                table[byte, on] ^= images[8 * byte + bit]
        out.append(table)
        images = appended(images, table)
    return out


def appended(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & U(255)] ^ table[1][crc >> U(8) & U(255)] ^ table[2][crc >> U(16) & U(255)] ^ table[3][crc >> U(24)]


def composed(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of strings in a row, from the CRC of each and the size of the second."""
    crc, left = first.astype(U), size.astype(np.int64)
    for table in zero_tables():
        on = left & 1 == 1
        crc = np.where(on, appended(crc, table), crc)
        left = left >> 1
        if not left.any():
            break
    return crc ^ second.astype(U)


def slices(text: str | None) -> list[bytes]:
    """The normalised text, in slices that begin and end with a delimiter."""
    raw = b" " + (text or "").encode().translate(NORMAL) + b" "
    if CUT.search(raw):
        raw = CUT.sub(rb"\1" + GLUE, raw)
    out, at = [], 0
    while len(raw) - at > SLICE:
        end = max(raw.rfind(b" ", at + 1, at + SLICE), raw.rfind(GLUE, at + 1, at + SLICE))
        out.append(raw[at:end + 1])
        at = end
    return [*out, raw[at:]]


class Dictionary:
    """An automaton of the words of some slices, with their payloads."""

    def __init__(self, texts: list[bytes]):
        keys: set[bytes] = set()
        for t in texts:
            keys.update(BOUNDED.findall(t) if GLUE in t else [b" %b " % w for w in set(t.split())])
        self.machine = ahocorasick.Automaton()
        for k, w in enumerate(keys):
            self.machine.add_word(w.decode("latin-1"), k)
        if keys:
            self.machine.make_automaton()
        self.crc = np.array([crc32(w[1:-1]) for w in keys], U)
        self.size = np.array([len(w) - 2 for w in keys], np.int64)
        self.joins = np.array([w[:1] == GLUE for w in keys], bool)

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, size and whether it continues the word before, of each match in order."""
        found = self.machine.iter(text.decode("latin-1")) if len(self.crc) else ()
        k = np.fromiter(map(itemgetter(1), found), np.int64)
        return self.crc[k], self.size[k], self.joins[k]


def whole_words(crc: np.ndarray, size: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fragments composed to words: pairs of neighbours in rounds, so a word of any length takes a few."""
    while joins.any():
        order = np.arange(len(joins)) - np.maximum.accumulate(np.where(joins, 0, np.arange(len(joins))))
        second = order % 2 == 1
        first = np.flatnonzero(second) - 1
        crc, size, joins = crc.copy(), size.copy(), joins.copy()
        crc[first] = composed(crc[first], crc[first + 1], size[first + 1])
        size[first] += size[first + 1]
        crc, size, joins = crc[~second], size[~second], joins[~second]
    return crc, size


def words_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """CRC and size of the words of each text; a dictionary for about ``SLICE`` bytes at a time."""
    held: list[list[bytes]] = []
    size = 0

    def scanned() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if all(len(parts) == 1 for parts in held):
            own = Dictionary([t for (t,) in held])
            for (t,) in held:
                yield whole_words(*own.payloads(t))
        else:  # one text, longer than a slice
            for parts in held:
                found = [Dictionary([t]).payloads(t) for t in parts]
                yield whole_words(*(np.concatenate(x) for x in zip(*found)))

    for text in texts:
        parts = slices(text)
        if held and (len(parts) > 1 or size + len(parts[0]) > SLICE):
            yield from scanned()
            held, size = [], 0
        held.append(parts)
        size += sum(map(len, parts))
    if held:
        yield from scanned()


def buckets_of(crc: np.ndarray, size: np.ndarray, longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` words joined by a space."""
    runs, out = crc, [crc]
    for k in range(1, longest):
        runs = runs[:-1]
        if not len(runs):
            break
        runs = composed(composed(runs, np.full(len(runs), SPACE), np.ones(len(runs), np.int64)), crc[k:], size[k:])
        out.append(runs)
    return (np.concatenate(out) % U(buckets)).astype(np.int32)


def features(rows: DataFrame, text: str, key: Column | None = None, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(key, n_words, buckets): the bucket of each feature, repeats counted."""
    own = rows.select((F.lit(None).cast("long") if key is None else key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([own.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, lists = [], []
            for crc, size in words_of(b.column("text").to_pylist()):
                n.append(len(crc))
                lists.append(buckets_of(crc, size, longest, buckets))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))],
                                             ["key", "n_words", "buckets"])

    return own.mapInArrow(run, schema)


def counts(found: DataFrame, name: str) -> DataFrame:
    return found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): how much more often than in the corpus a feature of the bucket stands in the target, as a smoothed log."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(corpus, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = stored(both, "buckets")
    sums, sumt = (both.agg(F.sum(c).cast("double")).scalar() for c in ("s", "t"))
    ratio = ((F.col("t") + 1.0) * (sums + float(buckets))) / ((F.col("s") + 1.0) * (sumt + float(buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean of the features' gains, 0 without features."""
    schema = T.StructType([*found.schema.fields[:2], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("buckets")
            ends = lists.offsets.to_numpy().astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(gain[lists.values.to_numpy()])))
            n = np.diff(ends)
            weight = (upto[ends[1:]] - upto[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                                             ["key", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(rows: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
             buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; the ``percent`` of those with ``least_words``
    words that score highest have a rank from 1, others null."""
    found = stored(features(rows, text, F.col(key), longest, buckets), "features")
    table = gains(found, features(target, target_text, None, longest, buckets), buckets).collect()  # ``buckets`` rows
    gain = np.zeros(buckets, np.int64)
    for bucket, value in table:
        gain[bucket] = value
    scored = stored(weighed(found, gain).withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "scores")
    enough = scored.filter(F.col("n_words") >= least_words)
    drawn = positions(enough.withColumn("one", F.lit(None).cast("int")).withColumn("down", -F.col("score")), ["one"],
                      [F.col("down"), F.col("key")], "place", "n", "at")
    rank = F.when(F.col("place") < F.expr(f"{int(percent)} * n div 100"), F.col("place") + 1)
    out = drawn.withColumn("rank", rank).select(*scored.columns, "rank").unionByName(
        scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
