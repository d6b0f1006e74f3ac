"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits a bounded sample of the vectors by hyperplanes between two
centres, at the median of the projections, down to leaves; every vector is
then sent down every tree.  A query goes down all trees through one shared
priority queue: the branch that its projections least rule out comes next,
whatever its tree, until enough leaves are found.  All vectors of these
leaves are scored exactly, in double precision.

Vectors move once, with the numbers of their leaves, into blocks of a bounded
number; every query goes to every block with the numbers of the leaves that it
visits, and a block answers with its best.

How many leaves are enough is measured on the index itself: the nearest vectors
of ``CALIBRATED`` queries are found by full comparison, and queries visit as
many leaves as it takes to meet ``recall`` of them, ``probes`` at least.

Nearness is the inner product.  Trees see vectors with one more component,
sqrt(M - |x|**2) with M the largest squared norm, so that nearest by angle is
nearest by inner product; queries have 0 there.

Equal vectors are indexed once: any number of copies is one entry of a leaf,
with the ``k + 1`` smallest ids, which is all that a result can show.

Defined results
    null or zero vectors, null or non-finite components, other lengths than
    the most frequent (ties: the shorter)    take no part, as query or as candidate
    null ids             take no part
    repeated rows        one id is one candidate
    ties                 smaller id first
    fewer than k others  all of those found
    empty table          no rows
    other columns        are not carried
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import dropped, stored

LEAF = 128
CALIBRATED = 128
BLOCK = 1 << 18  # vectors of a block at most, or nearly
SMALL_BLOCK = 1 << 13  # below that, no blocks for the sake of busy cores
BUSY = 32  # blocks made for that sake at most, as each gets all queries
WHOLE = 1 << 16  # nodes up to which a query's margins at all of them are one product
STEP = 1 << 16  # margins computed at once where they aren't


class Forest:
    """Nodes of all trees in one numbering: ``normal`` and ``at`` of each, children ``low`` and ``high``
    (a child c < 0 is the leaf -1 - c, leaves are numbered over all trees), ``roots``."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        self.normal: list = []
        self.at: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.roots = [self.grow(sample, np.arange(len(sample)), leaf, rng) for _ in range(trees)]
        self.normal = np.array(self.normal, np.float32).reshape(len(self.at), sample.shape[1])
        self.at = np.array(self.at, np.float32)
        self.children = np.array([self.low, self.high], np.int64).reshape(2, len(self.at))

    def grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(3):
                a, b = x[rng.choice(rows, 2, replace=False)]
                for _ in range(2):  # two steps towards the means of two halves
                    near = ((x[rows] - a) ** 2).sum(1) < ((x[rows] - b) ** 2).sum(1)
                    if near.any() and not near.all():
                        a, b = x[rows[near]].mean(0), x[rows[~near]].mean(0)
                way = a - b
                norm = float(np.sqrt((way * way).sum()))
                p = x[rows] @ way / (norm or 1.0)
                middle = float(np.median(p))
                if norm and 0 < (p > middle).sum() < len(rows):
                    node = len(self.at)
                    self.normal.append(way / norm), self.at.append(middle), self.low.append(0), self.high.append(0)
                    self.low[node] = self.grow(x, rows[p <= middle], leaf, rng)
                    self.high[node] = self.grow(x, rows[p > middle], leaf, rng)
                    return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        low, high = self.children
        out = np.zeros((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while len(live := np.flatnonzero(node >= 0)):
                n = node[live]
                right = (self.normal[n] * x[live]).sum(1) > self.at[n]
                node[live] = np.where(right, high[n], low[n])
            out[:, t] = -1 - node
        return out

    def probes(self, margins: np.ndarray, count: int) -> list[int]:
        """The ``count`` most promising leaves of all trees for one query, given its margin at every node."""
        return list(islice(self.promising(margins), count))

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """``probes`` of each query (float32), in any order: all queries go down all trees at once, level by level.

        Of the branches reached, only the ``count`` least ruled out go on, as each leads to a leaf no more ruled out."""
        count = min(count, self.leaves)
        node = np.broadcast_to(np.array(self.roots, np.int64), (len(x), len(self.roots)))
        far = np.zeros(node.shape)
        margins = x @ self.normal[:, :-1].T - self.at if len(self.at) <= WHOLE else None
        while True:
            if node.shape[1] > count:
                least = np.argpartition(far, count - 1, axis=1)[:, :count]
                node, far = np.take_along_axis(node, least, 1), np.take_along_axis(far, least, 1)
            r, c = np.nonzero(node >= 0)
            if not len(r):
                return (-1 - node).astype(np.int32)
            at = node[r, c]
            if margins is not None:
                m = margins[r, at].astype(float)
            else:
                m = np.concatenate([np.einsum("ij,ij->i", self.normal[at[i:i + STEP], :-1], x[r[i:i + STEP]]) - self.at[at[i:i + STEP]]
                                    for i in range(0, len(at), STEP)]).astype(float)
            # the low child takes the branch's place, the high child a new one; places without a branch are never taken
            more, away = np.zeros_like(node), np.full(far.shape, np.inf)
            more[r, c], away[r, c] = self.children[1][at], far[r, c] + np.minimum(m, 0.0) ** 2
            node, far = node.copy(), far.copy()
            node[r, c] = self.children[0][at]
            far[r, c] += np.maximum(m, 0.0) ** 2
            node, far = np.concatenate([node, np.where(np.isinf(away), -1, more)], 1), np.concatenate([far, away], 1)

    def promising(self, margins: np.ndarray) -> Iterator[int]:
        """All leaves, the most promising first."""
        heap = [(0.0, i, root) for i, root in enumerate(self.roots)]
        heapq.heapify(heap)
        order = len(heap)
        while heap:
            far, _, node = heapq.heappop(heap)
            if node < 0:
                yield -1 - node
                continue
            m = float(margins[node])
            # squared margins on the wrong side add up along the way, as distances to a corner do
            heapq.heappush(heap, (far + min(m, 0.0) ** 2, order, self.high[node]))
            heapq.heappush(heap, (far + max(m, 0.0) ** 2, order + 1, self.low[node]))
            order += 2

    def met_at(self, margins: np.ndarray, leaves: np.ndarray) -> list[int]:
        """Number of leaves to visit until each vector is met, given the leaves of each."""
        holders: dict[int, list[int]] = {}
        for i, of in enumerate(leaves.tolist()):
            for leaf in of:
                holders.setdefault(leaf, []).append(i)
        found: dict[int, int] = {}
        for n, leaf in enumerate(self.promising(margins), 1):
            for i in holders.get(leaf, ()):
                found.setdefault(i, n)
            if len(found) == len(leaves):
                break
        return list(found.values())


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part."""
    v = F.col(vector)
    src = rows.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.filter(finite & F.exists("v", lambda x: x != 0))
    size = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return src.filter(F.size("v") == (size[0].d if size else 0))


def entries(rows: DataFrame, k: int) -> DataFrame:
    """vid and id: the ``k + 1`` smallest ids of each vector.  The
    limit is applied before the shuffle too, and again by salt, so copies never meet."""
    rows = rows.select("vid", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["vid", "salt"], ["vid"]):
        w = Window.partitionBy(*keys).orderBy("id")
        rows = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    return rows.select("vid", "id", "rn")


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))[:, None]], 1).astype(np.float32)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(vectors: DataFrame, n: int, trees: int, leaf: int, max_sample: int, seed: int) -> tuple[Forest, float] | None:
    """A forest on about ``max_sample`` vectors (the bound on what the driver holds), and
    the largest squared norm.  Leaves hold ``leaf`` of all vectors, as far as the sample allows."""
    if not n:
        return None
    most = vectors.agg(F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    picked = vectors.filter(F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_sample / n)) + 1)
    rows = sorted(picked.limit(max_sample + max_sample // 8).collect(), key=lambda r: r.vid)
    x = lifted(np.array([r.v for r in rows]), most)
    return Forest(x, trees, max(4, leaf * len(rows) // n), seed), most


def enough(wanted: DataFrame, vectors: DataFrame, forest: Forest, most: float, k: int, recall: float, seed: int) -> int:
    """Leaves to visit so that ``recall`` of the true ``k`` nearest vectors of ``CALIBRATED`` queries are met, by one pass over all vectors."""
    asked = wanted.orderBy(F.xxhash64("vid", F.lit(seed)), "vid").limit(CALIBRATED).collect()
    if not asked:
        return 0
    vids, q = np.array([r.vid for r in asked]), np.array([r.v for r in asked])
    sent = wanted.sparkSession.sparkContext.broadcast((vids, q))

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vids, q = sent.value
        floor = np.full(len(q), -np.inf)
        for b in it:
            if len(b):
                r, c, s = best_of(q, matrix(b.column("v")).astype(float), b.column("id").to_numpy(), k + 1, floor)
                yield pa.RecordBatch.from_arrays([pa.array(vids[r]), *(b.column(n).take(pa.array(c)) for n in ("vid", "id", "v")), pa.array(s)],
                                                 ["qvid", "vid", "id", "v", "score"])

    near = Window.partitionBy("qvid").orderBy(F.desc("score"), "id")
    kind = vectors.schema["v"].dataType.simpleString()
    rows = vectors.mapInArrow(score, f"qvid bigint, vid bigint, id bigint, v {kind}, score double").filter("vid <> qvid") \
        .withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= k).select("qvid", "v").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.qvid, []).append(r.v)
    at: list[int] = []
    for vid, x in zip(vids.tolist(), q.astype(np.float32)):
        if vid in by:
            at += forest.met_at(x @ forest.normal[:, :-1].T - forest.at, forest.leaf_of(lifted(np.array(by[vid]), most)))
    return sorted(at)[max(0, int(np.ceil(recall * len(at))) - 1)] if at else 0


def narrowed(rows: DataFrame, element: str) -> DataFrame:
    """With vid, the hash of the vector, and the vector as it was given."""
    return rows.withColumn("vid", F.xxhash64("v")).withColumn("v", F.col("v").cast(f"array<{element}>"))


def blocks_for(n: int, cores: int) -> int:
    """Blocks that ``n`` vectors are dealt into: as few as hold them, rounded up to rounds of all cores."""
    least = max(1, -(-n // BLOCK), min(cores, BUSY, -(-n // SMALL_BLOCK)))
    return -(-least // cores) * cores if n > BLOCK and least > cores else least


def dealt(vectors: DataFrame, wanted: DataFrame, forest: Forest, most: float, probes: int, blocks: int) -> DataFrame:
    """block, side (0: a vector, 1: a query), vid, id, and as bytes v and the numbers of leaves (int32): those that hold
    the vector, or that the query visits.  A vector is in one block, a query in all."""
    sent = vectors.sparkSession.sparkContext.broadcast((forest, most))  # trees over a bounded sample
    names = ["vid", "id", "v", "leaves"]

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, most = sent.value
        for b in it:
            if len(b):
                x = matrix(b.column("v"))
                leaves = forest.leaf_of(lifted(x.astype(float), most)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("id"), packed(x), packed(leaves)], names)

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = sent.value
        for b in it:
            if len(b):
                x = matrix(b.column("v"))
                near = x.astype(np.float32)
                found = np.concatenate([forest.visits(near[at:at + 256], probes) for at in range(0, len(x), 256)])
                yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("vid"), packed(x), packed(found)], names)

    shape = "vid bigint, id bigint, v binary, leaves binary"
    member = vectors.mapInArrow(index, shape).select(F.pmod(F.xxhash64("vid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("side"), *names)
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    query = wanted.select("vid", "v").repartition(cores).mapInArrow(probe, shape).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), *names)
    return member.unionByName(query)


def search(queries: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 32,
           probes: int = 256, leaf: int = LEAF, max_sample: int = 20_000, seed: int = 3, recall: float = 0.95) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest rows found for each
    query, without the row of its own id."""
    single = all(df.schema[vector].dataType.simpleString() == "array<float>" for df in (queries, rows))
    element, kind = ("float", "<f4") if single else ("double", "<f8")
    own = stored(narrowed(usable(rows, key, vector), element), "ann-rows")
    asked = stored(narrowed(usable(queries, key, vector), element), "ann-queries")
    ids = stored(entries(own, k), "ann-entries")
    first = ids.filter("rn = 1").select("vid", "id")
    vectors = stored(own.join(first, ["vid", "id"]).dropDuplicates(["vid"]).select("vid", "id", "v"), "ann-vectors")
    dropped(own)
    wanted = asked.select("vid", "v").dropDuplicates(["vid"])
    spark = rows.sparkSession
    n = vectors.count()
    fitted = fit(vectors, n, trees, leaf, max_sample, seed)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = max(probes, enough(wanted, vectors, *fitted, k, recall, seed))
    blocks = blocks_for(n, spark.sparkContext.defaultParallelism)
    both = dealt(vectors, wanted, *fitted, probes, blocks).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side")
    scored = both.mapInArrow(lambda it: score_blocks(it, k + 1, kind), "qvid bigint, vid bigint, id bigint, score double")
    near = Window.partitionBy("qvid").orderBy(F.desc("score"), "id")
    best = scored.withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= k + 1).select("qvid", "vid", "score")
    every = best.join(ids.select("vid", "id"), "vid").withColumn("rn", F.row_number().over(near)).filter(F.col("rn") <= k + 1)
    rows_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("id").alias("query_id"), F.col("vid").alias("qvid")).distinct().join(every, "qvid")
            .filter(F.col("id") != F.col("query_id")).select("query_id", F.col("id").alias("vec_id"), "score")
            .withColumn("rank", F.row_number().over(rows_of)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _single(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in single precision, scaled where their size could be lost in it, and the scale of each or of all."""
    top = float(np.abs(x).max(initial=0.0)) or 1.0
    if x.dtype == np.float32 and 1e-12 < top < 1e12:
        return x, 1.0
    return (x / top).astype(np.float32), top


def _slack(d: int) -> float:
    """Twice the error of a product of ``d`` components in single precision, for vectors of length 1."""
    return 2 * (d + 4) * 2.0 ** -23


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the ``k`` best of the block for each query, ties to smaller ids, without what
    scores less than its ``floor``; the floor rises to the k-th best.

    Products in single precision leave out what can't be among the best by more than their error; the rest are summed in
    double precision along the vector alone, so a pair scores the same in every block."""
    scale = np.abs(q).max(1)
    first, (near, top) = (q / scale[:, None]).astype(np.float32), _single(x)
    s = first @ near.T
    slack = _slack(x.shape[1]) * np.linalg.norm(first, axis=1) * np.linalg.norm(near, axis=1).max()
    cut = floor / scale / top
    if s.shape[1] > k:
        cut = np.maximum(cut, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    r, c = np.nonzero(s >= (cut - slack)[:, None])
    score = (q[r] * x[c]).sum(-1)
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    good = (place < k) & (score >= floor[r])
    last = place == k - 1
    floor[r[last]] = np.maximum(floor[r[last]], score[last])
    return r[good], c[good], score[good]


class Block:
    """Vectors with the leaves that hold them, by leaf."""

    def __init__(self, vid: np.ndarray, ids: np.ndarray, v: np.ndarray, leaves: np.ndarray):
        order = np.argsort(leaves[:, 0], kind="stable")  # what one leaf holds lies together
        self.vid, self.ids, self.v = vid[order], ids[order], v[order]
        flat = leaves[order].ravel()
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(flat))])
        self.member = (np.argsort(flat, kind="stable") // leaves.shape[1]).astype(np.int32)
        self.near, _ = _single(self.v)
        self.slack = _slack(v.shape[1]) * float(np.sqrt(np.einsum("ij,ij->i", self.near, self.near).max()))
        self.seen = np.zeros(len(vid), bool)

    def best(self, q: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best vectors of the leaves, ties to smaller ids."""
        leaves = leaves[leaves < len(self.ends) - 1]
        start = self.ends[leaves]
        n = self.ends[leaves + 1] - start
        self.seen[self.member[np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)]] = True
        rows = np.flatnonzero(self.seen)
        self.seen[rows] = False
        if len(rows) > k:
            first = (q / np.abs(q).max()).astype(np.float32)
            s = np.take(self.near, rows, axis=0) @ first
            rows = rows[s >= np.partition(s, len(s) - k)[len(s) - k] - self.slack * float(np.linalg.norm(first))]
        score = (q * self.v[rows]).sum(-1)
        order = np.lexsort((self.ids[rows], -score))[:k]
        return rows[order], score[order]


def score_blocks(it: Iterator[pa.RecordBatch], k: int, kind: str) -> Iterator[pa.RecordBatch]:
    """The ``k`` best vectors of each block for each query, of those in the leaves that it visits.

    Rows come sorted, the vectors of a block before its queries; a block has
    about ``BLOCK`` vectors, queries pass in any number."""
    now, parts, held = None, [], None
    for b in it:
        block, side = (b.column(c).to_numpy() for c in ("block", "side"))
        edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1
        out: list = [[], [], [], []]
        for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(block)]):
            if s == e:
                continue
            part = b.slice(s, e - s)
            vid, ids = part.column("vid").to_numpy(), part.column("id").to_numpy()
            v, leaves = unpacked(part.column("v"), kind), unpacked(part.column("leaves"), "<i4")
            if now != block[s]:
                now, parts, held = block[s], [], None
            if side[s] == 0:
                parts.append((vid, ids, v, leaves))
                continue
            if parts:
                held, parts = Block(*(np.concatenate(c) for c in zip(*parts))), []
            if held is not None:
                for i in range(len(vid)):
                    rows, score = held.best(v[i].astype(float), leaves[i], k)
                    for o, a in zip(out, (np.full(len(rows), vid[i]), held.vid[rows], held.ids[rows], score)):
                        o.append(a)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["qvid", "vid", "id", "score"])
