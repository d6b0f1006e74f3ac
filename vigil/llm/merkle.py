"""Merkle manifest over rows: proofs, and versions that share all nodes but a path.

Rows of a group (a source) ascend by key; every ``FAN`` consecutive nodes of a level become their hash,
until one node is left, the group's.  The groups' nodes, ordered by group, become the root likewise.

A tree is cut into aligned blocks of ``FAN ** HEIGHT`` children, one row each.  A block's node is a child in a
block of the next tier, so a group of any size takes a few rounds, and no task holds more than its blocks.
Each child's siblings up to the root are joined from tier to tier, on the block's number.

The tree is persistent: a tampered leaf makes a version that copies the ancestors of that leaf and shares every
other node.  In its block the copies come from the block's own nodes (``Block.copied``); above it
the version goes on in the distributed tiers, where it again copies the path only, next to the
siblings that all versions share.  A leaf is verified if its copied path ends in the root.

Defined results
    null value        ``-`` in the leaf, other values are preceded by their length in bytes
    null group        a group of its own, the first one
    null key          first in its group; rows of equal key ascend by leaf
    repeated rows     a leaf each
    single leaf       is its group's node; a single group's node is the root
    empty table       no rows
    very long texts   are hashed as a whole by Spark
    other columns     names that clash don't matter: the columns used inside are named anew
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import positions, stored

FAN = 3
HEIGHT = 6  # levels of a block: at most 729 children


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """Lowercase hex sha256 of the fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def node(children: Sequence[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def run_of(i: int, n: int) -> tuple[int, int]:
    """First and end of the run that child ``i`` of ``n`` lies in."""
    first = i - i % FAN
    return first, min(first + FAN, n)


def climbed(digest: str, i: int, n: int, siblings: Sequence[str]) -> list[str]:
    """Nodes above child ``i`` of ``n``, the last of them the top one, from its siblings level by level."""
    out, at = [], 0
    while n > 1:
        first, end = run_of(i, n)
        others = siblings[at:at + end - first - 1]
        at += end - first - 1
        digest = node([*others[:i - first], digest, *others[i - first:]])
        out.append(digest)
        i, n = i // FAN, -(-n // FAN)
    return out


class Block:
    """The nodes of an aligned block, level by level; ``n`` children in the whole tier decide where it ends."""

    def __init__(self, children: Sequence[str], n: int, height: int = HEIGHT):
        self.levels = [list(children)]
        while (len(self.levels) <= height) if n > FAN ** height else len(self.levels[-1]) > 1:
            low = self.levels[-1]
            self.levels.append([node(low[i:i + FAN]) for i in range(0, len(low), FAN)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[list[str]]:
        """The other members of the run of child ``i``, level by level."""
        out = []
        for low in self.levels[:-1]:
            first, end = run_of(i, len(low))
            out.append(low[first:i] + low[i + 1:end])
            i //= FAN
        return out

    def copied(self, i: int, digest: str) -> list[str]:
        """New ancestors of child ``i`` in a version where it is ``digest``; all other nodes stay shared."""
        out = []
        for low in self.levels[:-1]:
            first, end = run_of(i, len(low))
            digest = node([*low[first:i], digest, *low[i + 1:end]])
            out.append(digest)
            i //= FAN
        return out


HEX = T.StringType()
NODES = T.StructType([T.StructField("g", HEX), T.StructField("i", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", HEX)])
PATHS = T.StructType([T.StructField("g", HEX), T.StructField("i", T.LongType()), T.StructField("path", T.ArrayType(HEX)), T.StructField("top", HEX)])


def hexes(values: list[bytes]) -> list[str]:
    return [v.hex() for v in values]


def blocks_of(nodes: DataFrame, height: int, *others: str) -> DataFrame:
    """One row for each aligned block of (g, i, n, digest): g, block, n, digests in order (as bytes) and ``others`` in the same order."""
    size = FAN ** height
    members = F.sort_array(F.collect_list(F.struct("i", F.unhex("digest").alias("digest"), *others)))
    rows = nodes.groupBy("g", F.expr(f"i div {size}").alias("block"), "n").agg(members.alias("m"))
    return rows.select("g", "block", "n", F.col("m.digest").alias("digests"), *[F.col(f"m.{c}").alias(c) for c in others])


def block_tops(it: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Each block's node: child ``block`` of the next tier."""
    for b in it:
        n = b.column("n").to_pylist()
        tops = [Block(hexes(d), k, height).top for d, k in zip(b.column("digests").to_pylist(), n)]
        n = [-(-k // FAN ** height) for k in n]
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("block"), pa.array(n, pa.int64()), pa.array(tops, pa.string())], ["g", "i", "n", "digest"])


def tops_of(blocks: DataFrame, height: int) -> DataFrame:
    return stored(blocks.select("g", "block", "n", "digests").mapInArrow(lambda it: block_tops(it, height), NODES), "nodes")


def block_paths(it: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Of each block's children: their siblings inside the block, then ``path``; and the tier's top node."""
    for b in it:
        rows: list[list] = [[], [], [], []]
        for g, block, n, digests, path, top in zip(*(b.column(c).to_pylist() for c in ("g", "block", "n", "digests", "path", "top"))):
            tree = Block(hexes(digests), n, height)
            for j in range(len(digests)):
                rows[0].append(g)
                rows[1].append(block * FAN ** height + j)
                rows[2].append([x for level in tree.siblings(j) for x in level] + (path or []))
                rows[3].append(top or tree.top)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string()))], ["g", "i", "path", "top"])


def with_upper(blocks: DataFrame, tops: DataFrame, height: int) -> DataFrame:
    """The blocks and, where their tier goes on above them, ``path`` and ``top`` of their nodes."""
    most = tops.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        upper = tops.select("g", "i", F.array().cast("array<string>").alias("path"), F.col("digest").alias("top"))
    else:
        upper = paths(tops, height)
    u = upper.select(F.col("g").alias("ug"), F.col("i").alias("ui"), "path", "top")
    return blocks.join(u, blocks["g"].eqNullSafe(u["ug"]) & (blocks["block"] == u["ui"])).drop("ug", "ui")


def paths(nodes: DataFrame, height: int) -> DataFrame:
    """(g, i, path, top) of (g, i, n, digest): the siblings of each node up to the top node of its g."""
    blocks = stored(blocks_of(nodes, height), "blocks")
    return stored(with_upper(blocks, tops_of(blocks, height), height).mapInArrow(lambda it: block_paths(it, height), PATHS), "paths")


LEAVES = T.StructType([
    T.StructField("leaf", HEX), T.StructField("altered", HEX), T.StructField("subroot", HEX), T.StructField("root", HEX),
    T.StructField("proof", T.ArrayType(HEX)), T.StructField("copied", T.ArrayType(HEX)), T.StructField("folded", HEX)])


def proved(it: Iterator[pa.RecordBatch], key: pa.DataType, height: int) -> Iterator[pa.RecordBatch]:
    """A row for each leaf: its proof, the nodes that its version copies and the node in which they end."""
    names = ["digests", "n", "block", "path", "top", "place", "groups", "upper", "root", "key", "altered"]
    for b in it:
        out: list[list] = [[] for _ in range(8)]
        for digests, n, block, path, top, place, groups, upper, root, keys, altered in zip(*(b.column(c).to_pylist() for c in names)):
            tree = Block(hexes(digests), n, height)
            above = -(-n // FAN ** height)
            for j, (k, own, other) in enumerate(zip(keys, tree.levels[0], altered)):
                version = own if other is None else other.hex()
                copies = tree.copied(j, version)
                copies += climbed((copies or [version])[-1], block, above, path)
                copies += climbed((copies or [version])[-1], place, groups, upper)
                proof = [x for level in tree.siblings(j) for x in level] + path + upper
                values = k, own, None if other is None else version, top, root, proof, copies if other is not None else [], (copies or [version])[-1]
                for column, v in zip(out, values):
                    column.append(v)
        kinds = [key, pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["key", *LEAVES.names])


def manifest(rows: DataFrame, key: Column, group: Column, leaf_of: Column, altered: Column, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, altered, subroot, root, proof, copied, folded) of every row.

    ``leaf_of`` is the leaf's digest; ``altered`` the digest of a tampered leaf or null.  ``proof``
    holds the siblings up to the root; ``copied`` the nodes of the tampered leaf's version, bottom up
    (none if null); ``folded`` is the root that its copies, else the leaf and the proof, lead to.
    The group becomes its text, the key keeps its type.
    """
    own = rows.select(key.alias("key"), group.cast("string").alias("g"), leaf_of.alias("digest"), F.unhex(altered).alias("altered"))
    leaves = positions(own, ["g"], [F.col("key"), F.col("digest")], "i", "n", "at")
    blocks = stored(blocks_of(leaves, height, "key", "altered"), "blocks")
    whole = stored(with_upper(blocks.select("g", "block"), tops_of(blocks, height), height), "upper")
    groups = whole.filter("block = 0").select("g", F.col("top").alias("digest"))  # a row for each group
    ranked = stored(positions(groups.withColumn("one", F.lit(None).cast("string")), ["one"], [F.col("g")], "i", "n", "at"), "groups")
    above = paths(ranked.select(F.col("one").alias("g"), "i", "n", "digest"), height)
    above = above.select(F.col("i").alias("place"), F.col("path").alias("upper"), F.col("top").alias("root")).join(
        ranked.select(F.col("i").alias("place"), F.col("g").alias("name"), F.col("n").alias("groups")), "place")
    upper = whole.join(above, whole["g"].eqNullSafe(above["name"])).drop("name")
    upper = upper.withColumnRenamed("g", "name").withColumnRenamed("block", "number")
    full = blocks.join(upper, blocks["g"].eqNullSafe(upper["name"]) & (blocks["block"] == upper["number"])).drop("name", "number")
    kind = own.schema["key"]
    arrow = to_arrow_type(kind.dataType)
    return full.mapInArrow(lambda it: proved(it, arrow, height), T.StructType([kind, *LEAVES.fields]))
