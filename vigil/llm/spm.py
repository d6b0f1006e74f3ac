"""Sampled SentencePiece encoding, lossless decoding.

The pieces of a public model span a lattice over the text: an arc for each
piece that matches, and for a character without a piece an arc of its UTF-8
bytes' pieces.  A segmentation has the probability of the product of its arcs'
weights to the power ``alpha``.  Forward filtering sums the weights of all ways
to reach each place; backward sampling then draws the last arc, the one before
it and so on, so segmentations come exactly from that distribution.

No piece holds a blank after another character, nor a line end; so the lattice
falls apart into chunks (blanks and the word after them) that are independent.
The forward pass is done once for each different chunk of a batch, for many at
a time, and all chunks are sampled together.  The draws come from a hash of the row
key, the chunk's number in the text and the step, so that a row has the same
segmentation in every run, batch and cluster.

A blank is written as the piece's blank mark; the mark itself, if a text has it,
as bytes.  A text that isn't empty gets one blank in front, which decoding drops.

Defined results
    null text        null
    empty text       no pieces, decodes to the empty text
    null key         sampled with the key of the empty string
    repeated rows    the same segmentation each
    very long texts  sampled some million chunks at a time
    other columns    ``encode`` keeps them all and adds ``pieces`` (under another name if taken)
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh
from .textvec import P, mix

U = np.uint64
MARK = "▁"
CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
CELLS = 1 << 17
AT_ONCE = 400_000
BYTE_RANK = 40_000


def piece_hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * P + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([h], U))[0])


class Pieces:
    """What is needed of a model: id and log weight of each piece, byte ids, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = [sp.get_score(i) for i in usual]
        # merge ranks (0, -1, -2, ...) are no probabilities: they become those of Zipf's law
        ranked = all(s == -k for k, s in enumerate(scores))
        logs = [-math.log(k + 2.7) if ranked else s for k, s in enumerate(scores)]
        self.arcs = {sp.id_to_piece(i): (i, w) for i, w in zip(usual, logs)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.arcs):
            raise ValueError("a piece holds a blank after another character, or a line end")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.is_unknown(b) for b in self.bytes):
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        self.longest = max(map(len, self.arcs))
        self.byte_log = -math.log(BYTE_RANK) if ranked else min(logs) - 1
        # pieces by the hash of their code points, and a filter of 20 bits of it
        h = np.array([piece_hash(p) for p in self.arcs], U)
        order = np.argsort(h)
        self.hashes = h[order]
        self.ids, self.logs = (np.array([v[k] for v in self.arcs.values()])[order] for k in (0, 1))
        self.may = np.zeros(1 << 20, bool)
        self.may[(h >> U(44)).astype(np.int64)] = True
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        self.out = [b""] * size
        for p, (i, _) in self.arcs.items():
            self.out[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            self.out[i] = bytes([b])


class Lattices:
    """Lattices of the different chunks of one batch, and a sampler over them.

    The forward pass runs for many chunks at once, place by place.  The arcs
    into state j are ``first[j]`` to ``first[j + 1] - 1``, longest first:
    cumulated probability in 32 bits, state before, what is written (a run of
    byte pieces as -1 - its number).  State 0 is the beginning of every chunk.
    A chunk's numbers are the same whatever other chunks are there."""

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces, self.alpha = pieces, alpha

    def build(self, chunks: list[str]) -> np.ndarray:
        """The state at the end of each chunk."""
        self.runs: dict[str, int] = {}
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(-size, kind="stable")
        ends = np.zeros(len(chunks), np.int64)
        parts, at, base = [], 0, 1
        while at < len(order):
            n = max(1, CELLS // max(1, int(size[order[at]])))
            rows = order[at:at + n]
            upto, back, write, count, last = self.block([chunks[i] for i in rows], size[rows], base)
            parts.append((upto, back, write, count))
            ends[rows] = last
            base, at = base + len(count), at + n
        cat = lambda k, t: np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t)
        self.upto, self.back, self.write = cat(0, np.uint32), cat(1, np.int32), cat(2, np.int32)
        self.first = np.concatenate(([0, 0], np.cumsum(cat(3, np.int64))))
        self.texts = [[self.pieces.bytes[b] for b in c.encode()] for c in self.runs]
        return ends

    def block(self, chunks: list[str], size: np.ndarray, base: int) -> tuple:
        """Tables of some chunks, longest first; their states are numbered from ``base``, place by place."""
        p, a = self.pieces, self.alpha
        width, n = int(size[0]), len(chunks)
        code = np.full((n, width), 0xFFFFFFFF, np.uint32)
        code[np.arange(width) < size[:, None]] = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        seen = np.where(code == ord(" "), ord(MARK), np.where(code == ord(MARK), 0xFFFF, code)).astype(U)  # no piece has U+FFFF
        live = np.searchsorted(-size, -np.arange(width + 1), "right")  # chunks that have place j
        place = base + np.concatenate(([0, 0], np.cumsum(live[1:])))  # first state of place j is place[j]
        found: list[tuple] = []  # arcs, longest pieces last until they are turned round
        h = np.zeros((n, width), U)
        for length in range(1, min(p.longest, width) + 1):
            h = (h[:, :width - length + 1] * U(P)) + seen[:, length - 1:] + U(1)
            mixed = mix(h)
            row, start = np.nonzero(p.may[(mixed >> U(44)).astype(np.int64)] & (np.arange(width - length + 1) + length <= size[:, None]))
            g = mixed[row, start]
            k = np.minimum(np.searchsorted(p.hashes, g), len(p.hashes) - 1)
            hit = p.hashes[k] == g
            pieces = row[hit], start[hit], start[hit] + length, p.ids[k[hit]], a * p.logs[k[hit]]
            if length == 1:
                alone = np.arange(width) < size[:, None]
                alone[row[hit], start[hit]] = False
                row, start = np.nonzero(alone)
                chars, of = np.unique(code[row, start], return_inverse=True)
                chars = [chr(c) for c in chars.tolist()]
                number = np.array([self.runs.setdefault(c, len(self.runs)) for c in chars], np.int64)
                cost = np.array([a * p.byte_log * len(c.encode()) for c in chars])
                found.append((row, start, start + 1, -1 - number[of], cost[of]) if chars else (row, start, start, row, np.zeros(0)))
            found.append(pieces)
        row, start, end, out, log = (np.concatenate(x) for x in zip(*found[::-1]))
        state = place[end] + row
        order = np.argsort(state, kind="stable")
        state, start, row, out, log = state[order], start[order], row[order], out[order], log[order]
        back = np.where(start == 0, 0, place[start] + row)
        count = np.bincount(state - base, minlength=int(place[-1]) - base)
        first = np.concatenate(([0], np.cumsum(count)))
        total, share = np.zeros(len(count) + 1), np.zeros(len(state))  # total[0] is state 0, then from base on
        source = np.where(back == 0, 0, back - base + 1)
        for j in range(1, width + 1):
            lo, hi = int(place[j]) - base, int(place[j + 1]) - base
            cut = first[lo:hi]
            way = total[source[cut[0]:first[hi]]] + log[cut[0]:first[hi]]
            of, cut = np.repeat(np.arange(hi - lo), count[lo:hi]), cut - cut[0]
            top = np.maximum.reduceat(way, cut)
            way = np.exp(way - top[of])
            rank = np.arange(len(way)) - cut[of]
            for k in range(1, int(rank.max()) + 1):  # sums in order, alike in every batch
                here = np.flatnonzero(rank == k)
                way[here] += way[here - 1]
            whole = way[np.append(cut[1:], len(way)) - 1]
            total[lo + 1:hi + 1] = top + np.log(whole)
            share[first[lo]:first[hi]] = way / whole[of]
        upto = np.minimum(share * 4294967296.0, 4294967295.0)
        upto[first[1:] - 1] = 4294967295.0
        return upto, back, out, count, place[size] + np.arange(n)

    def sample(self, ends: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one segmentation of the chunk of each state, and their number."""
        first, upto, back, write = self.first, self.upto, self.back, self.write
        live = np.flatnonzero(ends)
        state, own = ends[live], seeds[live]
        steps, taken, step = np.zeros(len(ends), np.int64), [], 0
        while len(live):
            step += 1
            draw = (mix(own + U((step * P) & 0xFFFFFFFFFFFFFFFF)) >> U(32)).astype(np.uint32)
            at = first[state]
            late = np.flatnonzero(draw > upto[at])
            while len(late):
                at[late] += 1
                late = late[draw[late] > upto[at[late]]]
            taken.append((live, write[at]))
            steps[live] = step
            state = back[at]
            on = np.flatnonzero(state)
            live, state, own = live[on], state[on], own[on]
        last = np.cumsum(steps) - 1
        out = np.zeros(int(steps.sum()), np.int32)
        for k, (rows, ids) in enumerate(taken):
            out[last[rows] - k] = ids
        return (out, steps) if not len(out) or out.min() >= 0 else self.spelled(out, steps)

    def spelled(self, out: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of byte pieces written out."""
        sizes = np.array([len(t) for t in self.texts], np.int64)
        flat = np.array([i for t in self.texts for i in t], np.int32)
        first = np.concatenate(([0], np.cumsum(sizes)))
        run = -1 - out
        n = np.where(out < 0, sizes[np.maximum(run, 0)], 1)
        whole = np.repeat(out, n)
        place = np.arange(len(whole)) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(run, n)
        whole = np.where(of >= 0, flat[np.minimum(first[np.maximum(of, 0)] + place, len(flat) - 1)], whole).astype(np.int32)
        owner = np.repeat(np.arange(len(steps)), steps)
        return whole, np.bincount(owner, n, len(steps)).astype(np.int64)


class Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh3_64_intdigest("" if key is None else str(key), seed=seed)


def encode_texts(texts: list[str | None], keys: list, lattices: Lattices, seed: int) -> list[np.ndarray | None]:
    """Ids of one sampled segmentation of each text."""
    out: list = [[] if t is not None else None for t in texts]
    ids_of = Numbers()
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        """Sample what has been gathered; chunks are numbered anew afterwards."""
        ends = lattices.build(list(ids_of))
        upto = np.concatenate(([0], np.cumsum([len(c) for _, c, _ in held])))
        ids, n = lattices.sample(ends[np.concatenate([c for _, c, _ in held])], np.concatenate([s for _, _, s in held]))
        cut = np.concatenate(([0], np.cumsum(n)))[upto]
        for (d, _, _), x, y in zip(held, cut[:-1].tolist(), cut[1:].tolist()):
            out[d].append(ids[x:y])
        held.clear(), ids_of.clear()

    size = 0
    for d, text in enumerate(texts):
        if not text:
            continue
        chunks, own = CHUNK.findall(" " + text), np.array([row_seed(keys[d], seed)], U)
        for at in range(0, len(chunks), AT_ONCE):
            part = chunks[at:at + AT_ONCE]
            number = np.array(list(map(ids_of.__getitem__, part)), np.int64)
            held.append((d, number, mix(own + np.arange(at, at + len(part), dtype=U) * U(0xD1342543DE82EF95))))
            size += len(part)
            if size >= AT_ONCE:
                flush()
                size = 0
    if held:
        flush()
    return [None if x is None else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]


def decode_ids(ids: list[int] | np.ndarray | None, pieces: Pieces) -> str | None:
    if ids is None:
        return None
    return b"".join(map(pieces.out.__getitem__, ids if isinstance(ids, list) else ids.tolist()))[1:].decode()


@lru_cache(maxsize=4)
def pieces_at(path: str) -> Pieces:
    return Pieces(path)


def list_array(values: list[np.ndarray | None]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([0 if v is None else len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate([v for v in values if v is not None]) if any(v is not None for v in values) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()), mask=pa.array([v is None for v in values]))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", alpha: float = 0.5, seed: int = 11,
           keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``), and ``pieces`` (ids of
    a sampled segmentation) and ``lossless`` (whether they decode to the text)."""
    name, ok = fresh(docs, "pieces"), fresh(docs, "lossless")
    sent = docs.sparkSession.sparkContext.broadcast(pieces_at(path))  # the vocabulary of the model file
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(T.IntegerType())), T.StructField(ok, T.BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sent.value
        lattices = Lattices(pieces, alpha)
        for b in it:
            texts = b.column(text).to_pylist()
            ids = encode_texts(texts, b.column(key).to_pylist(), lattices, seed)
            right = [None if t is None else decode_ids(i, pieces) == t for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), list_array(ids), pa.array(right, pa.bool_())], [*kept, name, ok])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "pieces") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the text that the ids stand for."""
    name = fresh(rows, "decoded")
    sent = rows.sparkSession.sparkContext.broadcast(pieces_at(path))
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = pa.array([decode_ids(x, sent.value) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*b.schema.names, name])

    return rows.mapInArrow(run, schema)
