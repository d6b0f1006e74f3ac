"""Near-duplicate classes by a Jaccard join over parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes.  A sketch of
the set is a row of 64-bit words: each shingle is dealt to a word and flips one
of its bits, so equal shingles of two sets cancel and the Hamming distance of
two sketches is at most the size of the sets' symmetric difference.  Sets with
Jaccard similarity of t or more differ in at most (1-t)/(1+t) * (|A|+|B|)
shingles.  In a band of sizes with at most D such differences, the sketches that
are joined have more than D words, so two similar sets agree in one word at
least (pigeonhole), and are found by a join on (band, word number, word).
Candidates are verified on the whole sets.

In the joined sketches a shingle flips the bits of a whole hash, so words agree
only if the same shingles stand in them, not by chance.  Words without a shingle
say nothing and are left out: a set with at most ``spare`` of them, in D + 1 +
``spare`` words, agrees with a similar one in a word that has some.  A set with
more is dealt anew, and after ``DEALS`` times its empty words join too.

Bands grow by a quarter; a set also enters the next band if it could be the
smaller partner of a set there, so each pair meets in the band of the larger.

Groups of copies never make all pairs.  Equal sets are one set.  Of the sets
that share a sketch word, each is first compared with the smallest id only;
verified links give components, and only sets of *different* components that
still share a word are compared with each other, until no word is left with
an untested pair.  So no link between components is lost.

Set ids are 64-bit hashes of the whole set: among 10**10 different sets about
three pairs would be taken for equal.

Defined results
    null or blank text     set of size 0, linked with nothing, not even another empty one
    fewer words than k     one shingle: the whole sequence
    repeated rows          one row each; equal texts share their class
    null key               the row takes part and has a class; a class whose keys are all null has class id null
    ties                   similarity that exactly reaches the threshold links
    empty table            no rows
    other columns          are not carried (``keep_one`` carries all)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from vigil.session import cut_lineage

from .common import dropped, fresh, record_batch, stored
from .textvec import P, hashed_words, mix, windows

U = np.uint64
MAP_BITS = 24
SEEN_SETS = 1 << 20
SKETCH_WORDS = 64
BLOCK = 512
DEALS = 4


class Join:
    """Threshold ``num / den`` and shingle length ``k``."""

    def __init__(self, k: int = 3, num: int = 90, den: int = 100):
        self.k, self.num, self.den = k, num, den
        self.bounds = [1]
        self.spares: dict[int, int] = {}

    def bound(self, i: int) -> int:
        """Smallest size in band ``i``."""
        while len(self.bounds) <= i:
            self.bounds.append(max(self.bounds[-1] + 1, self.bounds[-1] * 5 // 4))
        return self.bounds[i]

    def band(self, n: int) -> int:
        while self.bound(len(self.bounds) - 1) <= n:
            self.bound(len(self.bounds))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def differences(self, band: int) -> int:
        """Most shingles in which two similar sets of the band can differ."""
        return (self.den - self.num) * 2 * (self.bound(band + 1) - 1) // (self.den + self.num)

    def bands(self, n: int) -> list[int]:
        """The bands that a set of ``n`` shingles enters; none whose sets can only be similar if equal."""
        b = self.band(n)
        both = [b] + [b + 1] * (self.den * n >= self.num * self.bound(b + 1))
        return [x for x in both if self.differences(x) > 0]

    def shingle_sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Distinct shingle hashes of each text, sorted."""
        hashes, counts = hashed_words([(t or "").encode() for t in texts], lower=True)
        grams, owner = windows(hashes, counts, self.k)
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = []
        for i, n in enumerate(counts):
            if 0 < n < self.k:  # the whole sequence is one shingle
                out.append(windows(hashes[starts[i]:starts[i + 1]], counts[i:i + 1], int(n))[0] ^ U(n))
            else:
                out.append(np.unique(grams[at[i]:at[i + 1]]))
        return out

    @staticmethod
    def set_id(grams: np.ndarray) -> int:
        """Hash of a set: wrapping sum and xor of mixed members."""
        m = mix(grams ^ U(0x5851F42D4C957F2D))
        both = np.array([np.bitwise_xor.reduce(m)], U) * U(P) + np.array([m.sum(dtype=U)], U) + U(len(grams))
        return int(mix(both).view(np.int64)[0])

    def sketch(self, grams: np.ndarray, band: int) -> np.ndarray:
        """The parity sketch by which candidates of a band are compared: thirty bits or so for each allowed difference, ``SKETCH_WORDS`` words at most."""
        words = np.zeros(min(2 + self.differences(band) // 2, SKETCH_WORDS), U)
        h = mix(grams ^ U(0xD6E8FEB86659FD93))
        place = ((h >> U(32)) * U(len(words))) >> U(32)
        np.bitwise_xor.at(words, place.astype(np.int64), U(1) << (h & U(63)))
        return words

    def spare(self, band: int) -> int:
        """Words beyond D + 1: about as many as the smallest set of the band leaves empty."""
        if band not in self.spares:
            least = -(-self.num * self.bound(band) // self.den)
            out = 0
            for _ in range(3):
                words = self.differences(band) + 1 + out
                empty = words * math.exp(-least / words)
                out = math.ceil(empty + math.sqrt(empty))
            self.spares[band] = out
        return self.spares[band]

    def dealt(self, grams: np.ndarray, band: int, deal: int) -> tuple[np.ndarray, np.ndarray]:
        """One hash for each word of the joined sketch, of band, deal, word number and word; and which words have a shingle."""
        words = np.zeros(self.differences(band) + 1 + self.spare(band), U)
        seed = U(band + (deal << 32))
        h = mix(grams + seed)
        place = ((h >> U(32)) * U(len(words))) >> U(32)
        np.bitwise_xor.at(words, place.astype(np.int64), mix(h))
        return mix(mix(words) ^ (np.arange(len(words), dtype=U) * U(P) + seed)).view(np.int64), words != 0

    def sketch_keys(self, grams: np.ndarray, band: int) -> np.ndarray:
        """The hashes of all words of the first deal."""
        return self.dealt(grams, band, 0)[0]

    def posted_keys(self, grams: np.ndarray, band: int) -> np.ndarray:
        """The hashes by which a set is joined: two similar sets of a band share one at least."""
        out = []
        for deal in range(DEALS):
            keys, full = self.dealt(grams, band, deal)
            out.append(keys[full])
            if len(keys) - full.sum() <= self.spare(band):
                return np.concatenate(out)
        return np.concatenate([*out, keys[~full]])


def sets_of(docs: DataFrame, key: str, text: str, join: Join) -> DataFrame:
    """key, set id (null: no set), number of shingles and ``marks`` (a sketch for each band entered) of every row."""
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    mark = pa.list_(pa.struct([("band", pa.int32()), ("sketch", pa.list_(pa.int64()))]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = join.shingle_sets(b.column("text").to_pylist())
            marks = [[{"band": x, "sketch": join.sketch(s, x).view(np.int64)} for x in join.bands(len(s))] if len(s) else [] for s in sets]
            schema = pa.schema([b.schema.field("key"), ("sid", pa.int64()), ("n", pa.int64()), ("marks", mark)])
            yield record_batch(schema, [b.column("key"), [join.set_id(s) if len(s) else None for s in sets], [len(s) for s in sets], marks])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, sid bigint, n bigint, marks array<struct<band:int,sketch:array<bigint>>>")


def postings(docs: DataFrame, text: str, join: Join) -> DataFrame:
    """word (hash of band, number, sketch word), band, sid, n.  A task emits a set
    once, however many copies it reads, so a sketch word that a third of all
    rows share has a row a task."""
    src = docs.select(F.col(text).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in it:
            words, bands, sids, sizes = [], [], [], []
            for s in join.shingle_sets(b.column("text").to_pylist()):
                if not len(s) or (sid := join.set_id(s)) in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(sid)
                for band in join.bands(len(s)):
                    words.append(join.posted_keys(s, band))
                    bands.append(np.full(len(words[-1]), band, np.int32))
                    sids.append(np.full(len(words[-1]), sid, np.int64))
                    sizes.append(np.full(len(words[-1]), len(s), np.int64))
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (words, bands, sids, sizes)], ["word", "band", "sid", "n"])

    return src.mapInArrow(run, "word bigint, band int, sid bigint, n bigint")


def shared_words(posts: DataFrame) -> DataFrame:
    """word, band, sid, n and the smallest sid of the words that two sets or more share."""
    w = Window.partitionBy("word")
    return (posts.withColumns({"center": F.min("sid").over(w), "last": F.max("sid").over(w)})
            .filter("center <> last").select("word", "band", "sid", "n", "center").distinct())


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash, in a map of fixed size: the driver gets at most 2**(MAP_BITS-6) rows."""
    bit = F.pmod(F.col("sid"), F.lit(1 << MAP_BITS))
    rows = ids.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def whole_sets(docs: DataFrame, text: str, join: Join, ids: DataFrame) -> DataFrame:
    """sid and shingles of the sets in ``ids`` (sid).  The texts are read once
    more; a fixed-size map of the ids keeps most other sets from being moved,
    the join with ``ids`` the rest."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(ids))
    src = docs.select(F.col(text).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for b in it:
            sids, grams = [], []
            for s in join.shingle_sets(b.column("text").to_pylist()):
                if not len(s) or (sid := join.set_id(s)) in seen:
                    continue
                at = sid % (1 << MAP_BITS)
                if bits[at >> 6] >> (at & 63) & 1:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(sid)
                    sids.append(sid)
                    grams.append(s.view(np.int64))
            if sids:
                offsets = np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(grams)))], ["sid", "grams"])

    return src.mapInArrow(run, "sid bigint, grams array<bigint>").join(ids, "sid", "left_semi").dropDuplicates(["sid"])


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    a, b = (sets.select(F.col("sid").alias(x), F.col("grams").alias(f"g{x}")) for x in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - common
    return both.filter(join.den * common >= join.num * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """sid and comp (smallest sid that links reach) of the sets in ``links`` (a, b).

    Alternating large-star and small-star steps: each set's neighbours are
    hung on the smallest, until nothing moves.  Stars of any size are handled
    by partial minima and joins."""
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
                            .filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("sid"), F.col("v").alias("comp")).distinct())


def similar_size(join: Join, x: str, y: str):
    return join.den * F.least(x, y) >= join.num * F.greatest(x, y)


def sketches(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """sid, band and sketch of the sets that share a word in that band."""
    return rows.filter("sid is not null").dropDuplicates(["sid"]).select("sid", F.inline("marks")) \
        .join(shared.select("sid", "band").distinct(), ["sid", "band"], "left_semi")


def star_pairs(shared: DataFrame, marks: DataFrame, join: Join) -> DataFrame:
    """Each set with the smallest id beside which it stands in a word, if sizes and sketches allow that they are similar."""
    a = marks.select(F.col("sid").alias("a"), "band", F.col("sketch").alias("sa"))
    b = marks.select(F.col("sid").alias("b"), "band", F.col("sketch").alias("sb"))
    sizes = shared.select(F.col("sid").alias("a"), F.col("n").alias("na")).distinct()
    pairs = shared.filter("sid <> center").select(F.col("center").alias("a"), F.col("sid").alias("b"), F.col("n").alias("nb"), "band").distinct()
    distance = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return (pairs.join(sizes, "a").filter(similar_size(join, "na", "nb")).join(a, ["a", "band"]).join(b, ["b", "band"])
            .filter((join.den + join.num) * distance <= (join.den - join.num) * (F.col("na") + F.col("nb"))).select("a", "b").distinct())


def close_rows(sketch: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, join: Join) -> Iterator[tuple[int, int]]:
    """Pairs of rows of different components and, if there are two sides, of
    different sides, that sizes and sketch distance allow to be similar."""
    two = side.any() and not side.all()
    for i in range(len(n) - 1):
        j = np.flatnonzero((comp[i + 1:] != comp[i]) & ((side[i + 1:] != side[i]) | (not two))
                           & (join.den * np.minimum(n[i + 1:], n[i]) >= join.num * np.maximum(n[i + 1:], n[i]))) + i + 1
        if len(j):
            far = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
            for k in j[(join.den + join.num) * far <= (join.den - join.num) * (n[j] + n[i])]:
                yield i, int(k)


def cross_pairs(left: DataFrame, marks: DataFrame, join: Join) -> DataFrame:
    """Candidate pairs of different components that share a word.

    A word's sets are dealt to blocks of about ``BLOCK``; each two blocks meet
    in a group of their own, so a word that very many sets share is compared
    by many tasks, and only pairs that pass leave a task."""
    w = Window.partitionBy("word")
    dealt = left.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(w) / BLOCK).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.join(marks, ["sid", "band"]).select("word", "sid", "n", "comp", "sketch", "block", other.alias("other"))
    dealt = dealt.select("word", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                         (F.col("block") > F.col("other")).alias("side"), "sid", "n", "comp", "sketch")
    keys = ["word", "p", "q"]

    def flush(rows: list) -> list[tuple[int, int]]:
        sid, n, comp, side, sketch = zip(*rows)
        if len(set(comp)) < 2:
            return []
        found = close_rows(np.array(sketch, np.int64).view(U), np.array(n), np.array(comp), np.array(side), join)
        return [(min(sid[i], sid[j]), max(sid[i], sid[j])) for i, j in found]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in it:
            out = []
            cols = [b.column(c).to_pylist() for c in (*keys, "sid", "n", "comp", "side", "sketch")]
            for *key, sid, n, comp, side, sketch in zip(*cols):
                if key != now:
                    out += flush(rows) if len(rows) > 1 else []
                    now, rows = key, []
                rows.append((sid, n, comp, side, sketch))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})
        out = flush(rows) if len(rows) > 1 else []
        yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def links_between(docs: DataFrame, text: str, shared: DataFrame, marks: DataFrame, join: Join) -> DataFrame:
    """Verified links (a, b) between different sets, enough that sets are
    connected by them exactly if they are connected by similar pairs.  Uses up
    the tables ``shared`` and ``marks``.

    Whole sets are fetched only for pairs that sizes and sketches leave."""

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "parity-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        sets = stored(whole_sets(docs, text, join, ids), "parity-sets")
        out = stored(verified(pairs, sets, join), "parity-links")
        dropped(pairs)
        dropped(sets)
        return out

    links = checked(star_pairs(shared, marks, join))
    left = shared.drop("center").join(components(links), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    w = Window.partitionBy("word")
    left = left.withColumns({"lo": F.min("comp").over(w), "hi": F.max("comp").over(w)}).filter("lo <> hi").drop("lo", "hi")
    left = stored(left, "parity-left")
    dropped(shared)
    out = links.unionByName(checked(cross_pairs(left, marks, join)))
    dropped(left)
    dropped(marks)
    return out


def classes(docs: DataFrame, key: str, text: str, join: Join) -> tuple[DataFrame, DataFrame]:
    """Rows (key, sid, n) and the classes of their sets (sid, comp, component_id)."""
    shared = stored(shared_words(postings(docs, text, join)), "parity-words")
    whole = stored(sets_of(docs, key, text, join), "parity-rows")
    rows = stored(whole.drop("marks"), "parity-rows")
    marks = stored(sketches(whole, shared), "parity-sketches")
    dropped(whole)  # its sketches are the larger part
    comps = components(links_between(docs, text, shared, marks, join))
    first = rows.filter("sid is not null").groupBy("sid").agg(F.min("key").alias("key")).join(comps, "sid", "left") \
        .withColumn("comp", F.coalesce("comp", "sid"))
    ids = first.groupBy("comp").agg(F.min("key").alias("component_id"))
    return rows, stored(first.select("sid", "comp").join(ids, "comp").select("sid", "comp", "component_id"), "parity-classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """key, ``n_shingles`` and ``component_id`` (smallest key that links reach, equal
    texts included) of every row, and ``set_id``."""
    rows, known = classes(docs, key, text, Join(k, num, den))
    return rows.join(known, "sid", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("sid").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"), F.col("sid").alias("set_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest key (of repeated
    rows of it, any one).  Rows without a word are in no class and stay."""
    join = Join(k, num, den)
    rows, known = classes(docs, key, text, join)
    sid, comp, best = (fresh(docs, c) for c in ("sid", "comp", "best"))
    schema = T.StructType([*docs.schema.fields, T.StructField(sid, T.LongType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = pa.array([join.set_id(s) if len(s) else None for s in join.shingle_sets(b.column(text).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, sid])

    decided = known.select(F.col("sid").alias(sid), F.col("comp").alias(comp), F.col("component_id").alias(best))
    kept = docs.mapInArrow(run, schema).join(decided, sid, "left").filter(F.col(sid).isNull() | F.col(key).eqNullSafe(F.col(best)))
    again = rows.join(known, "sid").filter(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("comp").count().filter("count > 1")
    if not again.isEmpty():
        kept = kept.filter(F.col(sid).isNull()).unionByName(kept.filter(F.col(sid).isNotNull()).dropDuplicates([comp]))
    return kept.select(*docs.columns)
