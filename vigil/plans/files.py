"""Registered queries that write files and read them back, the evaluation report, inference turns and subword masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chat as CH
from ..functions import subword as SW
from ..functions.text import token_estimate
from ..operators import coding as C
from ..operators import dictionary as D
from ..operators import evaluate as EV
from ..operators import profile as P
from ..schemas import RAW_REPORT
from ..session import read_table
from ..sources import files as SF
from ..sources import reports as RP
from . import bridge, catalog
from .catalog import query, scratch_dir
from .oracle import _CODED, _COUNTERS, CLEAN_CTE, ORACLE, _rates, _with_scored, with_clean_dict

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {CH.IM_START: 50256, CH.IM_END: 50257}  # the vocabulary has no special tokens; these ids are free
HEAD = 100
MAP_KEYS = 1000


def _documents(spark, sf):
    return read_table(spark, sf, "documents", "doc_id", "text", fact=True).where("doc_id is not null and text is not null")


@query("source_chat_jsonl")
def source_chat_jsonl(spark, sf):
    """Chat records as exact JSON lines by split, read back; the narrative pulled from the user turn."""
    path = f"{scratch_dir(spark)}/chat"
    split = F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split")
    records = _documents(spark, sf).select(split, CH.chat_messages("text", F.col("doc_id").cast("string")).alias("messages"))
    SF.write_jsonl(records, path, exact_bytes=True)
    back = SF.read_chat_jsonl(spark, f"{path}/split=*")
    return back.select(CH.first_assistant("messages").cast("bigint").alias("doc_id"), F.size("messages").alias("n_messages"),
                       F.length(F.col("messages")[1]["content"]).alias("user_chars"),
                       F.md5(F.col("messages")[1]["content"].cast("binary")).alias("user_md5"))


@query("source_flat_jsonl")
def source_flat_jsonl(spark, sf):
    """Flat text records as Spark's JSON lines, read back; how often each text is there."""
    path = f"{scratch_dir(spark)}/flat"
    SF.write_jsonl(_documents(spark, sf).select("text"), path, split_col=None)
    return SF.read_flat_jsonl(spark, path).groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("source_text_lines")
def source_text_lines(spark, sf):
    """Texts as plain files, one narrative a line that isn't blank, stripped; how often each is there."""
    path = f"{scratch_dir(spark)}/lines"
    _documents(spark, sf).select("text").write.text(path)
    return SF.read_text_lines(spark, path).groupBy(F.md5(F.col("narrative").cast("binary")).alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("source_sheets")
def source_sheets(spark, sf):
    """The three dictionary sheets as CSV with a header, read back with declared types, and the lookup built from them."""
    path = f"{scratch_dir(spark)}/sheets"
    sheets = dict(zip(("names", "levels", "edges"), catalog.dict_sheets(spark, sf)))
    for kind, df in sheets.items():
        df.select(SF.SHEETS[kind].names).write.option("header", True).csv(f"{path}/{kind}")
    return D.build_lookup(*(SF.read_sheet(spark, f"{path}/{kind}", kind) for kind in sheets))


@query("source_json_map")
def source_json_map(spark, sf):
    """Lookup files, each a JSON object of at most ``MAP_KEYS`` parts, read back as rows."""
    path = f"{scratch_dir(spark)}/maps"
    parts = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_size")
    entry = F.struct(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("size")))
    maps = parts.groupBy(F.floor(F.col("p_partkey") / MAP_KEYS).alias("at")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    maps.repartition("at").write.partitionBy("at").text(path)
    return SF.read_json_map(spark, f"{path}/at=*", "struct<name:string,type:string,size:int>", "part")


@query("source_report_array")
def source_report_array(spark, sf):
    """Files that each hold one JSON array of the raw reports of ``MAP_KEYS`` keys, read back."""
    path = f"{scratch_dir(spark)}/arrays"
    raw = bridge.raw_reports_nested(spark, sf).withColumn("at", F.floor(F.col("safetyreportid").cast("long") / MAP_KEYS))
    arrays = raw.groupBy("at").agg(F.to_json(F.collect_list(F.struct(*RAW_REPORT.names))).alias("value"))
    arrays.write.partitionBy("at").text(path, compression="gzip")  # a row a file
    back = RP.read_report_array(spark, f"{path}/at=*")
    return back.select(F.col("safetyreportid").alias("id"), "serious", F.size("patient.reaction").alias("n_reactions"), F.size("patient.drug").alias("n_drugs"))


@query("optional_counts")
def optional_counts(spark, sf):
    """Value counts of the columns that documents have, of three asked for."""
    return P.optional_counts(read_table(spark, sf, "documents"), ["lang", "source", "label_source"])


@query("document_length_over")
def document_length_over(spark, sf):
    """Documents over 2,048 and 1,024 estimated tokens, with shares."""
    docs = read_table(spark, sf, "documents", "text")
    return P.over_limits(docs.select(token_estimate("text").alias("n_tokens")), "n_tokens", [2048, 1024])


@query("code_unmatched_sample")
def code_unmatched_sample(spark, sf):
    """A10: the first fifteen terms that no code matches exactly (the limit is the feature)."""
    return C.unmatched_sample(C.code_exact(catalog.clean_reports(spark, sf), catalog.lookup_table(spark, sf)))


@query("eval_head")
def eval_head(spark, sf):
    """V5: counters over the first ``HEAD`` records (the limit is the feature)."""
    return EV.counters(EV.score_pairs(catalog.eval_pairs(spark, sf, limit=HEAD)))


@query("eval_report")
def eval_report(spark, sf):
    """The report of an evaluation, line by line."""
    return SF.evaluation_report(EV.counters(catalog.scored(spark, sf)), "Base model")


@query("infer_turns")
def infer_turns(spark, sf):
    """User turns of the three prompt variants."""
    docs = _documents(spark, sf)
    one = lambda v: F.md5(CH.infer_prompt("text", v).cast("binary")).alias(f"{v}_md5")
    return docs.select("doc_id", one("eval"), one("infer"), one("demo"))


@query("mask_subword")
def mask_subword(spark, sf):
    """T12, T13 with subword ids: whole length, cut rows marked, labels up to the last assistant turn masked.  No SQL: tested against a library."""
    import public_tokenizers
    flat = catalog.chat_flat_text(spark, sf)
    encode = SW.tokenizer(SW.read_ranks(spark, "file://" + public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN, SPECIAL, by_line=True)
    template = encode([CH.RESPONSE_TEMPLATE])[0]
    tok = CH.tokenize(flat, "text", tokenizer=encode, response_template=template, count_col="n_tokens")
    lab = CH.with_response_mask(tok, "input_ids", template, "labels", until_col="mask_until")
    return lab.select("id", "n_tokens", (F.col("n_tokens") > CH.MAX_SEQ_LENGTH).alias("cut"), F.size("input_ids").alias("n_ids"),
                      (F.size("labels") - F.size(F.array_remove("labels", CH.IGNORE_INDEX))).alias("n_masked"),
                      F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"))


_HAVE = "FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL"
_INSTRUCTION, _INFER = (s.replace("'", "''").replace("\n", "' || chr(10) || '") for s in (CH.INSTRUCTION, CH.INFER_INSTRUCTION))
_TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

ORACLE["source_chat_jsonl"] = f"""WITH u AS (SELECT doc_id, '{_INSTRUCTION}' || chr(10) || chr(10) || 'Narrative:' || chr(10) || text AS c {_HAVE})
SELECT doc_id, 3 AS n_messages, length(c) AS user_chars, md5(c) AS user_md5 FROM u"""
ORACLE["source_flat_jsonl"] = f"SELECT md5(text) AS text_md5, count(*) AS n {_HAVE} GROUP BY 1"
ORACLE["source_text_lines"] = rf"""WITH l AS (SELECT regexp_replace(unnest(regexp_split_to_array(text, '[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')),
  '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g') AS t {_HAVE})
SELECT md5(t) AS line_md5, count(*) AS n FROM l WHERE t <> '' GROUP BY 1"""
ORACLE["infer_turns"] = f"""SELECT doc_id, md5('{_INFER}' || chr(10) || 'Narrative: ' || {_TRIMMED} || chr(10) || chr(10) || 'Output:') AS eval_md5,
  md5('{_INFER}' || chr(10) || chr(10) || 'Narrative: ' || {_TRIMMED} || chr(10) || chr(10) || 'Output:') AS infer_md5, infer_md5 AS demo_md5 {_HAVE}"""
ORACLE["source_sheets"] = ORACLE["dict_lookup"]
ORACLE["source_report_array"] = "WITH " + CLEAN_CTE.split("lnr AS")[0].rstrip().rstrip(",") + """
SELECT h.safetyreportid AS id, h.serious, CAST(n AS INTEGER) AS n_reactions, CAST(n AS INTEGER) AS n_drugs
FROM hdr h LEFT JOIN (SELECT report_key, count(*) AS n FROM ln GROUP BY 1) l ON l.report_key = h.report_key"""  # reports without a patient stay
ORACLE["source_json_map"] = "SELECT CAST(p_partkey AS VARCHAR) AS part, p_name AS name, p_type AS type, CAST(p_size AS INTEGER) AS size FROM part"
ORACLE["optional_counts"] = """SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source"""
ORACLE["document_length_over"] = """SELECT count(t) AS n, count_if(t > 2048) AS over_2048, count_if(t > 2048) / nullif(count(t), 0) AS share_2048,
  count_if(t > 1024) AS over_1024, count_if(t > 1024) / nullif(count(t), 0) AS share_1024 FROM (SELECT length(text) // 4 AS t FROM documents)"""
ORACLE["code_unmatched_sample"] = with_clean_dict(
    _CODED + "\nSELECT reaction_pt AS term, count(*) AS n FROM coded WHERE meddra_pt IS NULL GROUP BY 1 ORDER BY 1 LIMIT 15")
ORACLE["eval_head"] = "WITH " + _with_scored("base") + f"""
SELECT {_COUNTERS} FROM s WHERE "index" IN (SELECT doc_id FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT {HEAD})"""

_BAR = "repeat('=', 60)"
_ACC = [("    Seriousness       : ", "seriousness_acc"), ("    MedDRA PT         : ", "meddra_pt_acc"), ("    MedDRA SOC        : ", "meddra_soc_acc"),
        ("    Labelling status  : ", "labelling_acc"), ("    All fields correct: ", "all_fields_acc")]
_LINES = [_BAR, "'EVALUATION RESULTS — Base model'", _BAR, "'  Records evaluated  : ' || total",
          "'  JSON parse rate    : ' || printf('%.1f', parse_rate) || '%  (' || json_parse_ok || '/' || total || ')'", "''",
          "'  Field accuracy (on ' || json_parse_ok || ' parsed records):'",
          *(f"'{a}' || printf('%.1f', {c}) || '%'" for a, c in _ACC), _BAR]
ORACLE["eval_report"] = "WITH " + _with_scored("base") + f", c AS (SELECT {_COUNTERS} FROM s), r AS ({_rates('c')})\n" + " UNION ALL ".join(
    f"SELECT {i} AS pos, {e} AS line FROM r" for i, e in enumerate(_LINES))
