"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hostrules, importance, langid, linededup, merkle, mixing, parity, pii, rpforest, spm, subword, warc
from .common import drop_path, fold, read, ready, scratch, stored


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from text and lang of documents outside fold 0."""
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    net = langid.fit(docs.filter(fold(F.col("doc_id")) != 0))
    return langid.predict(docs, net).withColumn("held_out", fold(F.col("doc_id")) == 0)


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    out = hostrules.host_rules(read(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return out.select("doc_id", *hostrules.COUNTS, "base_failed", "host_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of lines and the numbers (from 0) of those that go."""
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    gone = linededup.removed_lines(docs, "doc_id", "text").groupBy("k").agg(F.sort_array(F.collect_set("l")).alias("gone"))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    own = docs.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(lines).cast("long").alias("n_lines"))
    return own.join(gone, own["doc_id"] == gone["k"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document, each counted for its own source."""
    rows = docs.select("doc_id", mixing.n_words(F.col("text").cast("string")).alias("size"), F.array(mixing.source_name(F.col("source"))).alias("of"))
    out, target, size = mixing.mix(rows, "doc_id", "size", "of")
    by = docs.sparkSession.createDataFrame([(s, size[s], float(target[s])) for s in size], "name string, source_size long, target double")
    return (out.withColumn("name", F.col("of")[0]).join(F.broadcast(by), "name")
            .select("doc_id", "size", "source_size", "target", "taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixed(read(spark, sf_dir, "documents"))


def op5_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 20, candidates all rows."""
    ready(spark)
    rows = read(spark, sf_dir, "embeddings")
    return rpforest.search(rows.filter(F.col("vec_id") % 20 == 0), rows, k=20)


PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    """doc_id, ids of the sampled segmentation, their number, and whether they decode to the text."""
    ready(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode(docs, model, keep_text=False).withColumn("n_pieces", F.size("pieces").cast("long"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    out = pii.find_and_sanitise(read(spark, sf_dir, "documents"), "doc_id", "text", with_text=False)
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"),
                      "spans", "n_terms")


def quality_model(spark: SparkSession, sf_dir: str) -> subword.Model:
    """Fitted on labelled rows outside fold 0 only."""
    labels = read(spark, sf_dir, "labels").filter((fold(F.col("doc_id")) != 0) & F.col("quality").isNotNull())
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return subword.fit(docs.join(labels.select("doc_id", "quality"), "doc_id"), max_rows=3000)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    return (subword.score(docs, quality_model(spark, sf_dir))
            .withColumn("held_out", fold(F.col("doc_id")) == 0)
            .withColumn("predicted", (F.col("score") >= 0.3).cast("int")))


def op9_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    out = parity.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text", k=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    path = scratch(spark, "archives")
    out = stored(warc.through_archives(read(spark, sf_dir, "pages"), path), "warc-pages")
    drop_path(spark, path)
    return out


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering deletes the line ends of texts whose key has an even crc32."""
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    c = F.col
    own = merkle.leaf([c("doc_id"), c("source"), c("lang"), c("n_chars"), c("text")])
    other = merkle.leaf([c("doc_id"), c("source"), c("lang"), c("n_chars"), F.replace(c("text"), F.lit("\n"), F.lit(""))])
    out = merkle.manifest(docs, c("doc_id"), c("source"), own, F.when(F.crc32(c("doc_id").cast("string")) % 2 == 0, other))
    return out.select(c("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"),
                      c("folded").alias("folded_root"), (c("folded") == c("root")).alias("verified"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to."""
    import public_tokenizers
    ready(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False, as_text=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_language": op1_language,
    "op2_host_rules": op2_host_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_mixing": op4_mixing,
    "op5_rp_forest": op5_rp_forest,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_parity_join": op9_parity_join,
    "op10_warc": op10_warc,
    "op11_merkle": op11_merkle,
    "op12_importance": op12_importance,
    "op13_byte_bpe": op13_byte_bpe,
}

#: crc32 of the UTF-8 bytes of column x, with the table of a byte in column z.t
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT)),
                            lambda c, b: xor(c >> 8, z.t[(xor(c, b) & 255) + 1])), 4294967295)"""
CRC_TABLE = """(SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""

ORACLE: dict[str, str] = {
    "op2_host_rules": r"""
        WITH w AS (
            SELECT doc_id, source, coalesce(text, '') AS t,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
              FROM (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: ws[i:i + 7])) AS g FROM w)),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g WHERE c > 1) GROUP BY doc_id),
        c AS (SELECT w.doc_id, w.source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                     len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
                       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
                     coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
        f AS (SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, 100 * n_symbols > 10 * n_words,
                         word_chars < 2 * n_words OR word_chars > 12 * n_words, 100 * n_dup_lines > 30 * n_words] AS fails FROM c),
        h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (fail) AS x
              FROM (SELECT source, unnest(range(5)) AS rule, unnest(fails) AS fail FROM f WHERE source IS NOT NULL) GROUP BY source, rule),
        m AS (SELECT rule, least(greatest(sum(x) / sum(n), 1e-6), 1 - 1e-6) AS p, avg(x / n) AS mean, avg((x / n) * (x / n)) AS square, avg(1 / n) AS inv
              FROM h GROUP BY rule),
        k AS (SELECT rule, p, greatest(square - mean * mean - p * (1 - p) * inv, 0) AS v FROM m),
        q AS (SELECT rule, p, least(greatest(CASE WHEN v > 0 THEN p * (1 - p) / v - 1 ELSE 1000 END, 1), 1000) AS strength FROM k),
        d AS (SELECT source, bool_or((x + p * strength) / (n + strength) > 0.5) AS host_failed FROM h JOIN q ON h.rule = q.rule GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (fails[1] OR fails[2]) AS base_failed, coalesce(host_failed, false) AS host_failed,
               NOT (fails[1] OR fails[2]) AND NOT coalesce(host_failed, false) AS kept
        FROM f LEFT JOIN d ON f.source = d.source""",
    "op3_line_dedup": r"""
        WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS l
                   FROM documents WHERE text IS NOT NULL),
        w AS (SELECT doc_id, l, list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS w FROM a),
        p AS (SELECT doc_id, l, w, dense_rank() OVER (ORDER BY w) AS s, row_number() OVER (PARTITION BY w ORDER BY doc_id, l) AS rn FROM w WHERE len(w) >= 1),
        f AS (SELECT doc_id, l, s, len(w) AS n, w FROM p WHERE rn = 1),
        t AS (SELECT doc_id, l, s, n, unnest(w) AS t FROM f),
        g AS (SELECT DISTINCT x.s FROM (SELECT x.s, y.s AS o, x.n, y.n AS m, count(*) AS c FROM t x JOIN t y
                  ON x.t = y.t AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) AND (y.doc_id, y.l) < (x.doc_id, x.l)
                  GROUP BY x.s, y.s, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))) x),
        r AS (SELECT doc_id, l FROM p WHERE rn > 1 OR s IN (SELECT s FROM g)),
        o AS (SELECT doc_id, count(*) AS n, string_agg(l::VARCHAR, ',' ORDER BY l) AS removed FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
        FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op9_parity_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id, doc_id AS o FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a)
        SELECT s.doc_id, len(s.s) AS n_shingles, min(r.o) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        m AS (SELECT d, max(page_id) AS original FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN original <> page_id THEN original END AS refers_to, true AS intact
        FROM p LEFT JOIN m ON p.d = m.d AND p.n >= 1000""",
    "op11_merkle": rf"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR] AS head, text, doc_id::VARCHAR AS x FROM documents),
        h AS (SELECT d.*, list_reduce(list_transform(head, lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END), lambda a, b: a || b) AS f,
                     {CRC} % 2 = 0 AS tampered FROM d, {CRC_TABLE} z),
        e AS (SELECT doc_id, source, sha256(f || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                     CASE WHEN tampered THEN sha256(f || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) END AS altered
              FROM h),
        p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM e),
        a AS (SELECT coalesce('s' || source, 'n') AS g, 0 AS l, i, n, leaf AS h FROM p
              UNION ALL SELECT g, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY g, l, i // 3, n),
        s AS (SELECT g, max_by(h, l) AS h FROM a GROUP BY g),
        q AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM s),
        b AS (SELECT 0 AS l, i, n, h FROM q UNION ALL
              SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY l, i // 3, n),
        c AS (SELECT p.doc_id, p.leaf, g, p.i, 0 AS l, n, coalesce(altered, leaf) AS h, '' AS proof FROM p JOIN s ON g = coalesce('s' || source, 'n')
              UNION ALL
              SELECT c.doc_id, c.leaf, c.g, c.i // 3, c.l + 1, (c.n + 2) // 3, sha256(string_agg(CASE WHEN a.i = c.i THEN c.h ELSE a.h END, '' ORDER BY a.i)),
                     c.proof || coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (a.i <> c.i), '')
              FROM c JOIN a ON a.g = c.g AND a.l = c.l AND a.i // 3 = c.i // 3 WHERE c.n > 1 GROUP BY c.doc_id, c.leaf, c.g, c.i, c.l, c.n, c.h, c.proof),
        u AS (SELECT c.doc_id, c.leaf, q.h AS subroot, q.i, 0 AS l, q.n, c.h, c.proof FROM c JOIN q ON c.g = q.g WHERE c.n = 1
              UNION ALL
              SELECT u.doc_id, u.leaf, u.subroot, u.i // 3, u.l + 1, (u.n + 2) // 3, sha256(string_agg(CASE WHEN b.i = u.i THEN u.h ELSE b.h END, '' ORDER BY b.i)),
                     u.proof || coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i <> u.i), '')
              FROM u JOIN b ON b.l = u.l AND b.i // 3 = u.i // 3 WHERE u.n > 1 GROUP BY u.doc_id, u.leaf, u.subroot, u.i, u.l, u.n, u.h, u.proof)
        SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, u.h AS folded_root, u.h = b.h AS verified
        FROM u JOIN b ON u.n = 1 AND b.n = 1""",
    "op12_importance": rf"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
            FROM (SELECT doc_id, text FROM documents UNION ALL SELECT NULL, text FROM benchmark WHERE text IS NOT NULL)),
        o AS (SELECT doc_id, unnest(ws) AS x FROM w),
        k AS (SELECT x, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT x FROM o), {CRC_TABLE} z),
        f AS (SELECT o.doc_id, bucket FROM o JOIN k ON o.x = k.x),
        c AS (SELECT r.range AS bucket, count(f.doc_id) AS s, count(f.bucket) - count(f.doc_id) AS t FROM range(10000) r LEFT JOIN f ON f.bucket = r.range GROUP BY r.range),
        g AS (SELECT bucket, floor(1000 * ln(((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000)) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM c),
        m AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN g ON f.bucket = g.bucket WHERE doc_id IS NOT NULL GROUP BY doc_id),
        v AS (SELECT w.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
              FROM w LEFT JOIN m ON w.doc_id = m.doc_id WHERE w.doc_id IS NOT NULL),
        r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS r,
                     count(*) FILTER (n_features >= 20) OVER () AS n FROM v)
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM r""",
}
