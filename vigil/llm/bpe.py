"""Byte-level BPE by recursive queries.

A text is split by the vocabulary's pattern; each match is a word of its own.  The different
words of a batch become token-position rows in a DuckDB database inside the task, one row a
byte at first.  A recursive query joins neighbouring rows with the merge table and contracts each
word's leftmost pair of least rank, until no word has a pair left.  A word that is a token is
that token.  Decoding joins ids with the vocabulary and aggregates the bytes in the order of the positions.

Words over ``LONG`` bytes would take a step for each merge, each over the whole word.  Theirs contract
in a step every pair that no other merge can reach before: a token has at most ``span`` bytes, so a
pair whose rank is the least of all pairs from ``span`` bytes before to ``2 * span`` bytes after it
stays as it is until its turn.  Of equal ranks the leftmost comes first; in a run of the same pair every second
one is contracted at once, unless the merged token is part of a token of lower rank (``alone``).

Spark deals the texts out in batches; a task keeps the words that it has met, ``KEPT`` at most,
then starts anew.  A word's ids don't depend on the batch, so reruns agree.

Defined results
    null text         as the empty text: no ids, decodes to nothing
    very long texts   whole; words are resolved ``AT_ONCE`` characters at a time
    very long words   one word after another, in memory that grows with its length
    repeated rows     the same ids each
    empty table       no rows
    other columns     kept; results get other names where theirs are taken
    ties              the leftmost pair of the least rank
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh

LONG = 64
GROUP = 1 << 21
AT_ONCE = 1 << 18
KEPT = 400_000
DECODE_ROWS = 2_000_000

SHORT_QUERY = """
WITH RECURSIVE s(step, w, p, q, tok) AS (
    SELECT 0, w, p, p + 1, tok FROM short
    UNION ALL
    (WITH best AS (
        SELECT a.w, min(id * 1048576 + a.p * 1024 + b.p) AS x, min_by(b.q, id * 1048576 + a.p) AS q
        FROM s a JOIN s b ON a.w = b.w AND a.q = b.p JOIN merges ON l = a.tok AND r = b.tok GROUP BY a.w)
     SELECT step + 1, s.w, p, CASE WHEN p = (x >> 10) & 1023 THEN best.q ELSE s.q END,
            CASE WHEN p = (x >> 10) & 1023 THEN (x >> 20)::INT ELSE tok END
     FROM s JOIN best ON s.w = best.w WHERE p <> x & 1023))
SELECT w, p, tok FROM s JOIN (SELECT w, max(step) AS step FROM s GROUP BY w) USING (w, step)"""

LONG_QUERY = """
WITH RECURSIVE s(w, p, step, tok) USING KEY (w, p) AS (
    SELECT w, p, 0, tok FROM long
    UNION
    (WITH pair AS (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY p) AS nxt FROM s WHERE tok IS NOT NULL),
     ranked AS (SELECT w, p, step, tok, id, alone FROM pair LEFT JOIN merges ON l = tok AND r = nxt),
     near AS (SELECT *, id = min(id) OVER (PARTITION BY w ORDER BY p RANGE BETWEEN {span} PRECEDING AND 2 * {span} FOLLOWING) AS hit,
                  min(id) OVER (PARTITION BY w ORDER BY p RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING) AS earlier,
                  CASE WHEN id IS DISTINCT FROM lag(id) OVER (PARTITION BY w ORDER BY p) THEN p END AS start FROM ranked),
     run AS (SELECT *, max(start) OVER (PARTITION BY w ORDER BY p ROWS UNBOUNDED PRECEDING) AS first FROM near),
     place AS (SELECT *, row_number() OVER o AS nth, bool_and(coalesce(hit, false)) OVER o AS clear FROM run
               WINDOW o AS (PARTITION BY w, first ORDER BY p ROWS UNBOUNDED PRECEDING)),
     taken AS (SELECT *, coalesce(clear AND CASE WHEN alone THEN nth = 1 AND (earlier IS NULL OR earlier > id) ELSE nth % 2 = 1 END, false) AS take
               FROM place),
     gone AS (SELECT *, lag(take, 1, false) OVER (PARTITION BY w ORDER BY p) AS drop, bool_or(take) OVER (PARTITION BY w) AS moves FROM taken)
     SELECT w, p, step + 1, CASE WHEN take THEN id WHEN NOT drop THEN tok END FROM gone WHERE moves))
SELECT w, p, tok FROM s WHERE tok IS NOT NULL"""

WORDS_QUERY = """
SELECT w, string_agg(id, ',' ORDER BY p), string_agg(bytes, '' ORDER BY p) FROM ({parts}) JOIN vocab USING (tok) GROUP BY w"""


@lru_cache(maxsize=2)
def ranks_at(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """The vocabulary and its merge table in a database, and the words resolved so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        self.ranks, self.limit = ranks, kept
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks some single bytes")
        self.pattern = regex.compile(pattern)
        narrow = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.narrow = None if "\\p" in narrow else re.compile(narrow, re.ASCII)  # the same matches in a text of ASCII, faster
        self.span = max(map(len, ranks))
        merges = [(ranks[b[:i]], ranks[b[i:]], t) for b, t in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        later = {x for l, r, t in merges for x in (l, r) if x > t}  # merged tokens that can be part of a token of lower rank
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        left, right, ids = (np.array(x, np.int32) for x in zip(*merges)) if merges else (np.zeros(0, np.int32),) * 3
        self.table("m", l=left, r=right, id=ids.astype(np.int64), alone=np.isin(ids, list(later)))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.table("v", tok=np.array(list(ranks.values()), np.int32), id=pa.array(map(str, ranks.values()), pa.string()),
                   bytes=pa.array([b.decode("latin-1") for b in ranks], pa.string()))  # a character for each byte
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM v")
        self.words: dict[str, tuple[str, bytes]] = {}

    def table(self, name: str, **columns) -> None:
        self.db.register(name, pa.table(columns))

    def split(self, text: str) -> list[str]:
        return (self.narrow if self.narrow and text.isascii() else self.pattern).findall(text)

    def resolve(self, words: list[str]) -> None:
        """Ids (as text) and decoded bytes of words not met before."""
        raw = [w.encode() for w in words]
        whole = np.array([self.ranks.get(b, -1) for b in raw], np.int32)
        size = np.array([len(b) for b in raw])
        word = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        place = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        token = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        for name, of in (("short", (whole < 0) & (size <= LONG)), ("long", (whole < 0) & (size > LONG))):
            pick = of[word]
            self.table(name, w=word[pick], p=place[pick], tok=token[pick])
        own = np.flatnonzero(whole >= 0).astype(np.int32)
        self.table("own", w=own, p=np.zeros(len(own), np.int32), tok=whole[own])
        parts = [f"({SHORT_QUERY})", "SELECT w, p, tok FROM own"]
        if (size > LONG).any():
            parts.append(f"({LONG_QUERY.format(span=self.span)})")
        for w, ids, decoded in self.db.execute(WORDS_QUERY.format(parts=" UNION ALL ".join(parts))).fetchall():
            self.words[words[w]] = ids, decoded.encode("latin-1")

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, bytes]]:
        """Decimal ids joined by commas, and the bytes that they stand for, of each text."""
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(self.split(text or ""))
            size += len(text or "")
            if size >= GROUP or i == len(texts) - 1:
                self.meet(group)
                for found in group:
                    parts = [self.words[w] for w in found]
                    yield ",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])
                group, size = [], 0

    def meet(self, group: list[list[str]]) -> None:
        """Resolve the words of some texts, ``AT_ONCE`` characters at a time."""
        if len(self.words) > self.limit:
            self.words.clear()
        new = list(set().union(*group).difference(self.words))
        at = size = 0
        for i, w in enumerate(new):
            size += len(w)
            if size >= AT_ONCE or i == len(new) - 1:
                self.resolve(new[at:i + 1])
                at, size = i + 1, 0

    def decode(self, lists: list[list[int] | None]) -> list[bytes | None]:
        """The bytes of each list of ids; null for null; an id outside the vocabulary raises."""
        out: list = [None if x is None else b"" for x in lists]
        size, held = 0, []

        def flush() -> None:
            n = np.array([len(lists[i]) for i in held])
            flat = np.concatenate([np.asarray(lists[i], np.int32) for i in held])
            self.table("ids", d=np.repeat(np.array(held, np.int32), n), p=np.arange(len(flat), dtype=np.int64), tok=flat)
            found = self.db.execute("""SELECT d, string_agg(bytes, '' ORDER BY p), count(bytes) = count(*) FROM ids LEFT JOIN vocab USING (tok)
                                       GROUP BY d""").fetchall()
            for d, b, known in found:
                if not known:
                    raise ValueError("an id outside the vocabulary")
                out[d] = b.encode("latin-1")
            held.clear()

        for i, x in enumerate(lists):
            if x:
                held.append(i)
                size += len(x)
                if size >= DECODE_ROWS:
                    flush()
                    size = 0
        if held:
            flush()
        return out


@lru_cache(maxsize=1)
def merger(path: str, pattern: str) -> Merger:
    """One for each worker process: tasks after another share the merge table and the words."""
    return Merger(ranks_at(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_text: bool = True, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (without the text unless ``keep_text``), ``ids`` (a list, or with ``as_text``
    their decimals joined by commas), ``n_tokens`` and ``decoded`` (the bytes that the ids stand for)."""
    kept = [c for c in docs.columns if keep_text or c != text]
    names = [fresh(docs, c) for c in ("ids", "n_tokens", "decoded")]
    kinds = [T.StringType() if as_text else T.ArrayType(T.IntegerType()), T.LongType(), T.BinaryType()]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, t) for c, t in zip(names, kinds))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, pattern)
        for b in it:
            ids, decoded = map(list, zip(*m.encode(b.column(text).to_pylist()))) if b.num_rows else ([], [])
            n = [x.count(",") + 1 if x else 0 for x in ids]
            if not as_text:
                ids = [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in ids]
            columns = [pa.array(ids, pa.string() if as_text else pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], [*kept, *names])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of ``rows`` and ``decoded``, the bytes that the ids stand for (null for null)."""
    name = fresh(rows, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path, pattern)
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.decode(b.column(ids).to_pylist()), pa.binary())], [*b.schema.names, name])

    return rows.mapInArrow(run, schema)
