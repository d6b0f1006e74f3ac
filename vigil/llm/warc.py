"""WARC archives: write pages as records, read archives back.

Writing needs no code of its own beside the header text: a record is a line of
Spark's text sink whose line separator is the blank line that ends a record.

Reading splits files anywhere.  The magic ``WARC/1.1\\r\\n`` marks candidates; a
payload may hold it too.  Each task lists, for the candidates of its block, the
offset where the record would end, which is where its successor must start,
and follows these offsets up to the first one outside the block.  Pointer
jumping over the few offsets at which blocks are entered then tells which are
reached from the start of the file, and only candidates on the chain from a
reached entry are records.  A magic inside a payload is jumped over.

Defined results
    null html          empty payload
    null url           empty target
    null page_id       an empty record id, read back as null; never the original of a revisit
    repeated rows      one record each; rows with the largest page_id of equal payloads are all responses
    empty table        no files, no rows
    line ends in urls  written as blanks, since they would end the header line
    other columns      are not written
    broken chain       a file that doesn't start with a record, or whose chain ends before its end,
                       gives the records up to there; ``broken_files`` lists it
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import cut_lineage, path_exists

from .common import record_batch, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_SHARED = 1000


def record_ids(pages: DataFrame, page_id: str, url: str, html: str, min_shared: int) -> DataFrame:
    """Each page with payload, digest, type and the page that it revisits.

    Payloads are grouped by digest and length with a partial maximum, so a
    payload that a third of the pages share meets as one row a task; only
    digests of two pages or more are joined back."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    base = base.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    shared = (base.filter(F.col("payload_bytes") >= min_shared).groupBy("digest")
              .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1 and original is not null")
              .select("digest", "original"))
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return base.join(shared, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("original")))


def record_text(page: DataFrame) -> Column:
    """Header and payload of one record, without the blank line at its end."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.translate("url", "\r\n", "  ")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))).otherwise(""),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_shared: int = MIN_SHARED) -> None:
    """One archive file a task.  Of equal payloads of ``min_shared`` bytes or
    more, that of the largest page_id is stored, the others refer to it."""
    rows = record_ids(pages, page_id, url, html, min_shared)
    rows.select(record_text(rows).alias("value")).write.option("lineSep", END).text(path)


CANDIDATE = pa.schema([("file", pa.string()), ("block", pa.int64()), ("file_size", pa.int64()), ("at", pa.int64()), ("size", pa.int64()),
                       ("leaves", pa.int64()), ("block_size", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())),
                       ("body_bytes", pa.int64()), ("body_sha1", pa.string())])
CANDIDATE_SQL = ("file string, block bigint, file_size bigint, at bigint, size bigint, leaves bigint, block_size bigint, "
                 "fields map<string,string>, body_bytes bigint, body_sha1 string")


def header(piece: bytes) -> tuple[dict, int, int] | None:
    """Fields (names lower case), length of header and blank line, declared body length; None if it is no header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    return (fields, end + 4, int(n)) if n.isascii() and n.isdigit() and len(n) < 19 else None


def candidates_of_block(file: str, block: int, file_size: int, pieces: list[tuple], block_size: int) -> pa.RecordBatch:
    """``pieces``: (at, size, fields, body_bytes, body_sha1); ``at`` counts from the block's first piece.

    ``leaves`` is where the chain from a candidate leaves the block (same count)."""
    leaves: dict[int, int] = {}
    for at, size, *_ in reversed(pieces):
        leaves[at] = leaves.get(at + size, at + size)
    rows = [(file, block, file_size, at, size, leaves[at], block_size, list(fields.items()), n, sha)
            for at, size, fields, n, sha in pieces] or [(file, block, file_size, None, None, None, block_size, [], None, None)]
    return record_batch(CANDIDATE, list(zip(*rows)))


def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between magics, in file order within each block, to candidates."""
    magic, now, at, pieces = len(MAGIC), None, 0, []
    for b in it:
        for value, file, block, file_size in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block", "file_size"))):
            if now != (file, block, file_size):
                if now:
                    yield candidates_of_block(*now, pieces, at)
                now, at, pieces = (file, block, file_size), 0, []
            # the first piece of a file is what stands before its first magic
            if (at or block) and (found := header(value)):
                fields, start, n = found
                whole = len(value) >= start + n
                pieces.append((at - magic, magic + start + n + 4, fields, n,
                               hashlib.sha1(memoryview(value)[start:start + n]).hexdigest() if whole else None))
            at += len(value) + magic
    if now:
        yield candidates_of_block(*now, pieces, at)


def raw_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at every magic; any split of the files gives the same pieces, as bytes."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size"))


def with_offsets(rows: DataFrame) -> DataFrame:
    """Adds ``base``, the offset in the file of the block's first piece: block
    sizes are summed over the blocks of each file, one row a block."""
    blocks = rows.select("file", "block", "block_size").distinct()
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("block_size").over(w), F.lit(0)).alias("base"))
    return rows.join(blocks, ["file", "block"])


def reached_entries(cands: DataFrame) -> DataFrame:
    """(file, start) of the block entries that the chain from the file's start
    reaches, by pointer jumping: in round k everything within 2**k block hops
    is known, and the jumps double."""
    begin = cands.select("file").distinct().withColumn("start", F.lit(0).cast("long"))
    starts = cands.select("file", (F.col("base") + F.col("at")).alias("start"), (F.col("base") + F.col("leaves")).alias("to")).filter("start is not null")
    entries = begin.unionByName(starts.select("file", F.col("to").alias("start"))).distinct()
    jump = cut_lineage(starts.join(entries, ["file", "start"], "left_semi"))
    reached = cut_lineage(begin.join(jump.select("file", "start"), ["file", "start"], "left_semi"))
    known = reached.count()
    while True:
        step = reached.join(jump, ["file", "start"]).select("file", F.col("to").alias("start"))
        step = step.join(jump.select("file", "start"), ["file", "start"], "left_semi")
        reached = cut_lineage(reached.unionByName(step).distinct())
        n = reached.count()
        if n == known:
            return reached
        known = n
        onward = jump.select("file", F.col("start").alias("to"), F.col("to").alias("next"))
        jump = cut_lineage(jump.join(onward, ["file", "to"], "left")
                           .select("file", "start", F.coalesce("next", "to").alias("to")))


def chain(at: list[int], size: list[int], entry: int) -> set[int]:
    """Positions reached from ``entry`` within one block."""
    after, out = dict(zip(at, size)), set()
    while entry in after:
        out.add(entry)
        entry += after[entry]
    return out


def on_chain(cands: DataFrame, entries: DataFrame) -> DataFrame:
    """The candidates that the chain from their block's entry passes.  A block
    has one entry at most, and is no larger than a split of the file."""
    entered = entries.select("file", "start", F.lit(True).alias("entered"))
    marked = cands.withColumn("start", F.col("base") + F.col("at")).join(entered, ["file", "start"], "left") \
        .select("file", "block", "at", "size", "base", "entered")

    def walk(t):
        first = t.loc[t["entered"].notna(), "at"]
        hit = chain(t["at"].tolist(), t["size"].tolist(), int(first.iloc[0])) if len(first) else set()
        t = t[t["at"].isin(hit)]
        return t.assign(start=t["base"] + t["at"])[["file", "start"]]

    return marked.groupBy("file", "block").applyInPandas(walk, "file string, start bigint")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The verified records below ``path``: file, start, size, ``fields`` (header
    names in lower case), body_bytes and body_sha1 of the body as it stands in the file."""
    cands = stored(with_offsets(stored(raw_pieces(spark, path).mapInArrow(scan, CANDIDATE_SQL), "warc-scan")), "warc-candidates")
    real = cands.filter("at is not null")
    records = stored(real.withColumn("start", F.col("base") + F.col("at"))
                     .join(on_chain(real, reached_entries(cands)), ["file", "start"])
                     .filter(F.col("start") + F.col("size") <= F.col("file_size"))
                     .select("file", "start", "size", "fields", "body_bytes", "body_sha1"), "warc-records")
    if records.filter("body_sha1 is null").isEmpty():
        return records
    return records.filter("body_sha1 is not null").unionByName(rejoined(spark, path, cands, records.filter("body_sha1 is null")))


def rejoined(spark: SparkSession, path: str, cands: DataFrame, records: DataFrame) -> DataFrame:
    """Records whose body holds a magic: their pieces, in order, give the body.
    A group is one record."""
    bases = cands.select("file", "block", "base").distinct()
    sizes = raw_pieces(spark, path).mapInArrow(placed, "file string, block bigint, at bigint, value binary").join(bases, ["file", "block"])
    pieces = sizes.select("file", (F.col("base") + F.col("at")).alias("piece"), "value")
    # records do not overlap: a piece can only belong to records of its file that start in its stretch of 1 MiB or before
    wide = records.withColumn("stretch", F.explode(F.sequence((F.col("start") / (1 << 20)).cast("long"), ((F.col("start") + F.col("size")) / (1 << 20)).cast("long"))))
    inside = pieces.withColumn("stretch", (F.col("piece") / (1 << 20)).cast("long")).join(wide, ["file", "stretch"]) \
        .filter((F.col("piece") >= F.col("start")) & (F.col("piece") < F.col("start") + F.col("size")))
    whole = inside.groupBy("file", "start", "size", "body_bytes").agg(F.sort_array(F.collect_list(F.struct("piece", "value"))).alias("p"))

    def body(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sha = []
            for parts, n in zip(b.column("p").to_pylist(), b.column("body_bytes").to_pylist()):
                data = MAGIC.encode().join(x["value"] for x in parts)
                at = data.find(b"\r\n\r\n") + 4
                sha.append(hashlib.sha1(data[at:at + n]).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("start"), pa.array(sha, pa.string())], ["file", "start", "sha"])

    found = whole.mapInArrow(body, "file string, start bigint, sha string")
    return records.join(found, ["file", "start"]).select("file", "start", "size", "fields", "body_bytes", F.col("sha").alias("body_sha1"))


PLACED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("value", pa.binary())])


def placed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece with the place of its magic, counted from the block's first piece."""
    magic, now, at = len(MAGIC), None, 0
    for b in it:
        places = []
        for value, *here in zip(*(b.column(c).to_pylist() for c in ("value", "file", "block"))):
            if now != here:
                now, at = here, 0
            places.append(at - magic)
            at += len(value) + magic
        yield record_batch(PLACED, [b.column("file"), b.column("block"), places, b.column("value")])


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose chain of records does not end at the end of the file."""
    files = raw_pieces(spark, path).select("file", "file_size").distinct()
    ends = read_archives(spark, path).groupBy("file").agg(F.max(F.col("start") + F.col("size")).alias("upto"))
    return files.join(ends, "file", "left").filter(~F.col("upto").eqNullSafe(F.col("file_size"))).select("file", "upto", "file_size")


def page_records(records: DataFrame) -> DataFrame:
    """Pages as the archive holds them.  The digest of a response is that of the
    body read; a revisit has no body, so length and digest are its header's."""
    field = lambda n: F.element_at("fields", n)
    urn = lambda n: F.regexp_extract(field(n), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    revisit = field("warc-type") == "revisit"
    declared = F.regexp_replace(field("warc-payload-digest"), "^sha1:", "")
    return records.select(
        urn("warc-record-id").alias("page_id"), F.when(revisit, field("x-payload-length").cast("long")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("body_sha1")).alias("payload_digest"), field("warc-type").alias("record_type"),
        F.when(revisit, urn("warc-refers-to")).alias("refers_to"), (revisit | (declared == F.col("body_sha1"))).alias("intact"))


def through_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages below ``path``, read them back."""
    spark = pages.sparkSession
    write_archives(pages, path)
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return page_records(read_archives(spark, path))
