"""Vectorised hashing of words and byte n-grams for a batch of texts.

Texts are UTF-8 bytes.  A word is a maximal run of bytes other than \\x20 and
\\x09-\\x0D.  Its hash is a polynomial in its bytes modulo 2**64, mixed with its
length; it depends on the word alone, so it agrees between tasks and runs.
Work goes in slices, so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 2 << 20
P = 0x9E3779B97F4A7C15 | 1
P_INV = pow(P, -1, 1 << 64)
U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables of P**i and P**-i for i below ``n``."""
    if len(_powers.get("p", ())) < n:
        n = max(n, SLICE + 4096)
        for name, base in (("p", P), ("q", P_INV)):
            t = np.full(n, base, U)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one buffer."""
    edge = np.diff(np.concatenate(([0], (~BLANK[buf]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, q = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * p[:len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(U))


def slices(texts: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Groups of texts joined by blank bytes: (index of the text of each byte's
    group as [owner, length] rows, buffer).  A longer text comes in several
    slices, cut at blanks where there are any."""
    rows: list[tuple[int, int]] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > SLICE:
            cut = max(t.rfind(b, at, at + SLICE) for b in (b" ", b"\n", b"\t", b"\r"))
            if cut <= at:  # one word longer than a slice: up to its end
                found = [x for b in (b" ", b"\n", b"\t", b"\r") if (x := t.find(b, at + SLICE)) >= 0]
                cut = min(found) if found else len(t)
            if rows:
                yield np.array(rows), b"".join(parts)
                rows, parts, size = [], [], 0
            yield np.array([(i, cut - at)]), t[at:cut]
            at = cut
        if size + len(t) - at > SLICE and rows:
            yield np.array(rows), b"".join(parts)
            rows, parts, size = [], [], 0
        part = t[at:] + b"\n"
        rows.append((i, len(part)))
        parts.append(part)
        size += len(part)
    if rows:
        yield np.array(rows), b"".join(parts)


def hashed_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and the number of words of each text."""
    counts, out = np.zeros(len(texts), np.int64), []
    for rows, data in slices(texts):
        buf = np.frombuffer(data, np.uint8)
        if lower:
            buf = LOWER[buf]
        start, end = word_spans(buf)
        out.append(span_hashes(buf, start, end))
        ends = np.cumsum(rows[:, 1])
        upto = np.searchsorted(start, ends)
        np.add.at(counts, rows[:, 0], np.diff(np.concatenate(([0], upto))))
    return (np.concatenate(out) if out else np.zeros(0, U)), counts


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within one text, and its text's index."""
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    h = np.zeros(m, U)
    for k in range(n):
        h = (h ^ hashes[k:k + m]) * U(P)
        h ^= h >> U(29)
    same = owner[:m] == owner[n - 1:]
    return mix(h[same]), owner[:m][same]
