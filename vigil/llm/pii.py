"""Personal data: direct identifiers by pattern, revealing terms by information.

Direct identifiers (email, ip, card, phone) are found by pattern.  All words of
a text that don't touch one are its terms.  Over the whole corpus,
co-occurrence in a document gives how strongly a term discloses an entity.  All
counts are of different texts, so copies are neither evidence nor its opposite:
with ``c`` texts that hold both, ``n`` that hold the term, and ``m`` of ``N``
that hold the entity,

    posterior = c / (n + 1)            how sure the entity follows from the term
    bits      = log2(posterior / (m / N))   information gained on the entity

A term discloses an entity if its posterior reaches ``min_posterior`` and its
information ``min_bits``; one text is enough where the term stands nowhere else.
As c <= m and c is at most the number of texts with identifiers that hold the
term, most terms can be left out before any is paired.  Entities that stand in
the same texts have equal counts with every term, so they are paired as one: a
list of thousands of addresses on one page is one entity.  Disclosing terms are
then replaced wherever they stand: capitalised ones are generalised to
``[TERM]``, others are removed.

Defined results
    null text        empty: no spans; the sanitised text stays null
    repeated rows    each row has its own result; equal texts count once (those with identifiers, up to blanks)
    ties             a term that exactly reaches a limit discloses
    empty table      no rows, no terms
    very long texts  scanned from end to end
    other columns    are not carried
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, stored

# The kinds in their order of listing and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{2,}")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

FLUSH = 200_000
TERMS_AT_ONCE = 200_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts at the leftmost character of the local part before an
    ``@``, not before the end of the last match; no start further right can
    match if that one doesn't, so each ``@`` is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def identifiers(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every direct identifier, ordered by start, then kind."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 if len(p) < 1000 else not p.strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """Name of an entity, alike for its spellings."""
    s, kind, e = span
    return f"{KINDS[kind]}:{text[s:e].lower() if kind < 2 else NOT_DIGIT.sub('', text[s:e])}"


def free_terms(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Terms that don't touch a direct identifier."""
    k, reach = 0, 0
    for m in TERM.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if m.start() >= reach:
            yield m


SEEN = pa.schema([("name", pa.string()), ("n", pa.int64()), ("mark", pa.binary()),
                  ("entities", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))])
SEEN_SQL = "name string, n bigint, mark binary, entities array<string>, terms array<string>"


def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task from columns ``text`` and ``copied`` (whether other rows
    may have the text too), combined before the shuffle and flushed at a bounded size.

    Texts without identifiers or copies add to the count ``n`` of each term
    ``name``.  Of others the entities and terms are listed, with a hash of the
    text (``mark``) by which copies in other tasks are told."""
    held: Counter = Counter()
    both: dict[bytes, tuple[list[str], list[str]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(name, n, None, None, None) for name, n in held.items()]
        rows += [(None, None, mark, *lists) for mark, lists in both.items()]
        held.clear(), both.clear()
        return record_batch(SEEN, list(zip(*rows)))

    for batch in batches:
        for text, copied in zip(batch.column("text").to_pylist(), batch.column("copied").to_pylist()):
            spans = identifiers(text)
            found = {m[0] for m in free_terms(text, spans)} if spans else set(TERM.findall(text))
            terms = {t.lower() for t in found}
            if spans or copied:
                names = sorted({entity(text, s) for s in spans})
                whole = " ".join([*text.split(), *names]) if spans else text
                mark = hashlib.blake2b(whole.encode(), digest_size=16).digest()
                if mark not in both:
                    both[mark] = (names, sorted(terms))
                    size += len(names) + len(terms)
            else:
                held.update(terms)
            if len(held) + size >= FLUSH:
                yield flush()
                size = 0
    if held or both:
        yield flush()


def with_copied(src: DataFrame) -> tuple[DataFrame, int]:
    """Texts with ``copied``, and the number of different ones.

    Only hashes are counted.  Equal hashes of different texts do no harm: ``copied``
    says which texts to tell apart by their longer hash."""
    src = src.filter(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    more = stored(src.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "pii-copies")
    beyond = more.agg(F.sum(F.col("rows") - 1)).first()[0] or 0
    out = src.join(more.select("h", F.lit(True).alias("copied")), "h", "left")
    return out.select("text", F.coalesce("copied", F.lit(False)).alias("copied")), src.count() - beyond


def entity_groups(texts: DataFrame) -> DataFrame:
    """mark, entity, m, alike: for each different set of texts that some entities stand in, the first of
    these entities in each of the texts, the number of texts and that of the entities.

    Sets are told apart by their size and 128 bits, the parity of their texts' hashes."""
    held = texts.select("mark", F.explode("entities").alias("entity"))
    parity = [F.bit_xor(F.xxhash64("mark", F.lit(seed))).alias(f"p{seed}") for seed in (1, 2)]
    sets = held.groupBy("entity").agg(F.count(F.lit(1)).alias("m"), *parity)
    first = sets.groupBy("m", "p1", "p2").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("alike"))
    return held.join(first.select("entity", "m", "alike"), "entity")


def disclosing_terms(docs: DataFrame, text: str = "text", min_posterior: float = 0.5, min_bits: float = 4.0) -> DataFrame:
    """term, entity, posterior, bits and alike (how many entities that stand in the same texts it discloses
    likewise; ``entity`` is the first of them) of every disclosure over the limits."""
    src, total = with_copied(docs.select(F.col(text).cast("string").alias("text")))
    seen = stored(src.mapInArrow(statistics, SEEN_SQL), "pii-seen")
    texts = stored(seen.filter("mark is not null").select("mark", "entities", "terms").dropDuplicates(["mark"]), "pii-texts")
    known = stored(entity_groups(texts), "pii-entities")
    most = known.agg(F.max("m")).first()[0] or 0
    owned = texts.select("mark", (F.size("entities") > 0).cast("long").alias("own"), F.explode("terms").alias("term"))
    counts = seen.filter("name is not null").select(F.col("name").alias("term"), "n", F.lit(0).cast("long").alias("own")) \
        .unionByName(owned.select("term", F.lit(1).cast("long").alias("n"), "own"))
    terms = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("own").alias("own")) \
        .filter(F.least("own", F.lit(most)) / (F.col("n") + 1) >= min_posterior).drop("own")
    pairs = owned.filter("own = 1").select("mark", "term").join(terms, "term").join(known, "mark") \
        .filter(F.col("m") / (F.col("n") + 1) >= min_posterior)
    posterior = F.col("c") / (F.col("n") + 1)
    return (pairs.groupBy("term", "entity", "n", "m", "alike").agg(F.count(F.lit(1)).alias("c"))
            .select("term", "entity", posterior.alias("posterior"),
                    F.log2(posterior * max(total, 1) / F.col("m")).alias("bits"), "alike")
            .filter((F.col("posterior") >= min_posterior) & (F.col("bits") >= min_bits)))


def terms_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each text with each of its different terms."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("term", pa.string())])
    for b in batches:
        rows = [(h1, h2, t) for h1, h2, text in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "text")))
                for t in {t.lower() for t in TERM.findall(text)}]
        yield record_batch(schema, list(zip(*rows)) or [()] * 3)


def with_terms(src: DataFrame, terms: DataFrame) -> DataFrame:
    """``src`` with ``found``: of ``terms``, those that stand in the text; for more terms than a task should hold.

    One join of all texts' terms with ``terms``, gathered by text (two hashes of it); a list has at most the terms of its text."""
    keyed = src.withColumn("h1", F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit(1)))).withColumn("h2", F.xxhash64("text", F.lit(2)))
    each = keyed.filter(F.col("text").isNotNull()).select("h1", "h2", "text").mapInArrow(terms_by_text, "h1 bigint, h2 bigint, term string")
    found = each.join(terms, "term", "left_semi").groupBy("h1", "h2").agg(F.collect_set("term").alias("found"))
    return keyed.join(stored(found, "pii-found"), ["h1", "h2"], "left").drop("h1", "h2")


def added_spans(text: str | None, base: list[tuple[int, int, int]], terms: frozenset) -> list[tuple[int, int]]:
    """Occurrences of disclosing terms that don't touch a direct identifier."""
    if not text or not terms:
        return []
    if terms.isdisjoint(t.lower() for t in set(TERM.findall(text))):
        return []
    return [(m.start(), m.end()) for m in free_terms(text, base) if m[0].lower() in terms]


def sanitise(text: str | None, base: list[tuple[int, int, int]], terms: list[tuple[int, int]]) -> str | None:
    """Direct identifiers become ``[KIND]`` (the first of overlapping ones names
    the stretch), capitalised terms ``[TERM]``, other terms go."""
    if text is None:
        return None
    marks = sorted([(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base]
                   + [(s, e, "[TERM]" if text[s].isupper() else "") for s, e in terms])
    out, at = [], 0
    for s, e, by in marks:
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def listing(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, kind, e in spans)


OUT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_spans string, spans string, n_terms bigint, sanitised string"


def find_and_sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True, **limits: float) -> DataFrame:
    """key, counts of direct identifiers, ``base_spans`` and ``spans`` (kind:start:end
    in code points, end exclusive, by start, then kind as listed, terms last),
    number of added terms and the sanitised text (null unless ``with_text``).

    Up to ``TERMS_AT_ONCE`` terms are sent to every task; more are brought to
    the texts that hold them by a join, however many they are."""
    spark = docs.sparkSession
    terms = stored(disclosing_terms(docs, text, **limits).select("term").distinct(), "pii-terms")
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sent = None
    if terms.count() <= TERMS_AT_ONCE:
        sent = spark.sparkContext.broadcast(frozenset(r.term for r in terms.collect()))
        src = src.withColumn("found", F.lit(None).cast("array<string>"))
    else:
        src = with_terms(src, terms)
    types = pa.schema([("a", pa.int64())] * 4 + [("b", pa.string())] * 2 + [("n", pa.int64()), ("t", pa.string())])
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist()):
                base = identifiers(t)
                more = added_spans(t, base, frozenset(found or ()) if sent is None else sent.value)
                n = Counter(k for _, k, _ in base)
                spans = [(s, KINDS[k], e) for s, k, e in base]
                both = sorted([(s, k, e) for s, k, e in base] + [(s, len(KINDS), e) for s, e in more])
                rows.append((*(n[k] for k in range(4)), listing(spans), listing([(s, (*KINDS, "term")[k], e) for s, k, e in both]),
                             len(more), sanitise(t, base, more) if with_text else None))
            cols = list(zip(*rows)) or [()] * len(names)
            schema = pa.schema([b.schema.field("key"), *(pa.field(c, f.type) for c, f in zip(names, types))])
            yield record_batch(schema, [b.column("key"), *cols])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, {OUT}").withColumnRenamed("key", key)

