"""Byte-level subword ids by a ranked merge table, as a plug-in of ``chat.tokenize``.

A text is cut at its special strings, the rest by a pattern; each piece starts as its
UTF-8 bytes, and the neighbours whose joint bytes have the least rank merge, the
leftmost first, until none has a rank.  Pieces repeat, so their ids are kept.

Defined results
    null or empty text    no ids
    a byte without a rank KeyError: the table must hold all 256 single bytes
    special strings       their own ids wherever they stand, the longest first
    very long pieces      a heap of pairs: n log n for n bytes
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable

from pyspark.sql import SparkSession

KEPT_PIECES = 1 << 16
KEPT_BYTES = 64
KEPT_LINE = 160
KEPT_PARTS = 256  # texts between special strings: turns that recur, such as a system prompt


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A merge table of lines "base64 of the bytes, rank", read by Spark from any file system; as large as the vocabulary."""
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in spark.read.text(path).collect() if r.value.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it has merged into the one before
    before = list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two has merged since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


def packed_ids(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class _Known(dict):
    """Ids of pieces as bytes, found when first asked for; short ones are kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        found = packed_ids(merged(raw, self.ranks))
        if len(raw) <= KEPT_BYTES:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found


def lines(text: str) -> list[str]:
    """The text cut before each newline that follows anything but white space."""
    first, *rest = text.split("\n")
    out = [first]
    for line in rest:
        last = out[-1]
        if last and not last[-1].isspace():
            out.append("\n" + line)
        else:
            out[-1] = f"{last}\n{line}"
    return out


def words(line: str) -> list[str] | None:
    """A line cut before its spaces, if these stand alone and are all its white space but a newline at the start; else None."""
    found = line.split(" ")
    body = [found[0][1:], *found[1:]] if line.startswith("\n") else found
    if line.split() != body:
        return None
    return [found[0], *[" " + w for w in found[1:]]]


def tokenizer(ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None, by_line: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """``list[str] -> list[list[int]]`` for ``chat.tokenize``; each task keeps the ids of up to ``KEPT_PIECES`` short pieces.
    Its ``packed`` gives the ids of a text as the bytes of int32 numbers, which are joined from those kept.

    ``by_line`` also keeps those of short lines, and of the words of longer ones.  It needs a pattern none of whose matches goes
    on from a character that isn't white space into white space, or looks behind: then lines and words have the ids that they
    have in the text."""
    special = special or {}
    codes = {name: packed_ids([i]) for name, i in special.items()}
    state: dict = {}

    def start() -> None:
        import regex
        state["words"] = regex.compile(pattern)
        names = sorted(special, key=len, reverse=True)
        state["special"] = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        state["known"], state["parts"], state["lines"], state["chunks"] = _Known(ranks), {}, {}, {}

    def pieces(text: str) -> bytes:
        of = state["words"]
        found = [m.group() for m in of.finditer(text)] if of.groups else of.findall(text)
        return b"".join(map(state["known"].__getitem__, found))

    def kept(name: str, text: str, longest: int) -> bytes:
        """Ids that are kept for short texts."""
        if len(text) > longest:
            return pieces(text)
        ids = pieces(text)
        if len(state[name]) >= KEPT_PIECES:
            state[name].clear()
        state[name][text] = ids
        return ids

    def line(text: str) -> bytes:
        ids = state["lines"].get(text)
        if ids is not None:
            return ids
        if len(text) <= KEPT_LINE:
            return kept("lines", text, KEPT_LINE)
        cut = words(text)
        if cut is None:
            return pieces(text)
        have = state["chunks"].get
        return b"".join([i if (i := have(w)) is not None else kept("chunks", w, KEPT_BYTES) for w in cut])

    def encode(part: str) -> bytes:
        parts = state["parts"]
        ids = parts.get(part)
        if ids is None:
            ids = b"".join(map(line, lines(part))) if by_line else pieces(part)
            if len(parts) >= KEPT_PARTS:
                parts.clear()
            parts[part] = ids
        return ids

    def packed(texts: list[str]) -> list[bytes]:
        if not state:
            start()
        cut = state["special"].split if state["special"] else lambda t: [t]
        return [b"".join([codes[p] if p in codes else encode(p) for p in cut(t or "")]) for t in texts]

    def run(texts: list[str]) -> list[list[int]]:
        return [array("i", ids).tolist() for ids in packed(texts)]

    run.packed = packed
    return run
