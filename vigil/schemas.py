"""Declared schemas (never inferred).  Names follow the data model in SURVEY §1."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, IntegerType,
                               LongType, StringType, StructField, StructType)

S = StringType()


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, S, True) for n in names]


# D1 raw report: every leaf is a string (codes compare as strings).
REACTION = StructType(_strings("reactionmeddrapt", "reactionoutcome"))
DRUG = StructType(_strings("medicinalproduct", "drugcharacterization", "drugadditional",
                           "drugrecurrence", "drugdosagetext", "drugindication"))
PATIENT = StructType(_strings("patientonsetage", "patientsex") + [
    StructField("reaction", ArrayType(REACTION, True), True),
    StructField("drug", ArrayType(DRUG, True), True),
])
RAW_REPORT = StructType(_strings(
    "safetyreportid", "serious",
    "seriousnessdeath", "seriousnesslifethreatening", "seriousnesshospitalization",
    "seriousnessdisabling", "seriousnesscongeni", "seriousnessother",
    "narrativeincludeclinical") + [StructField("patient", PATIENT, True)])

# Landed page file: {"results": [report, ...]}
RAW_PAGE = StructType([StructField("results", ArrayType(RAW_REPORT, True), True)])

# D2 clean report (16 columns).
CLEAN_REPORT = StructType(
    _strings("id", "drug_name", "drug_dose", "drug_indication", "reaction_pt", "reaction_outcome")
    + [StructField("serious", BooleanType(), False),
       StructField("seriousness_criteria", ArrayType(S, False), False)]
    + _strings("patient_age", "patient_sex", "narrative")
    + [StructField("has_narrative", BooleanType(), False)]
    + _strings("drug_additional", "drug_recurrence")
    + [StructField("concomitant_drugs", IntegerType(), False)]
    + _strings("who_umc_preliminary"))

# D3-D5 dictionary sheets, one table each, with the sheet row position.
TERM_NAMES = StructType([StructField("term_id", LongType()), StructField("name", S),
                         StructField("pos", LongType())])
TERM_LEVELS = StructType([StructField("term_id", LongType()), StructField("level", S),
                          StructField("pos", LongType())])
TERM_EDGES = StructType([StructField("child_id", LongType()), StructField("parent_id", LongType()),
                         StructField("pos", LongType())])

# D7 term lookup keyed by lower(name).
TERM_LOOKUP = StructType([
    StructField("pt_key", S), StructField("meddra_pt", S), StructField("meddra_pt_code", LongType()),
    StructField("meddra_llt", S), StructField("meddra_llt_code", LongType()),
    StructField("meddra_soc", S), StructField("meddra_soc_code", LongType())])

# F6 product-label rows (one row per label document and search key).
LABEL_ROWS = StructType([
    StructField("key_type", S), StructField("key", S),
    StructField("adverse_reactions", ArrayType(S)), StructField("warnings_and_cautions", ArrayType(S)),
    StructField("warnings", ArrayType(S)), StructField("pos", LongType())])

# D9 generated case record.
CASE_RECORD = StructType(
    _strings("id", "narrative", "narrative_source", "seriousness")
    + [StructField("seriousness_criteria", ArrayType(S))]
    + [StructField("meddra_llt", S), StructField("meddra_llt_code", LongType()),
       StructField("meddra_pt", S), StructField("meddra_pt_code", LongType()),
       StructField("meddra_soc", S), StructField("meddra_soc_code", LongType())]
    + _strings("labelling_status", "labelling_evidence", "label_source", "who_umc_category"))

# D10 chat record.
MESSAGE = StructType(_strings("role", "content"))
CHAT_RECORD = StructType([StructField("messages", ArrayType(MESSAGE))])

# D11 flat text record.
FLAT_RECORD = StructType(_strings("text"))

# D12 target object, 9 keys in fixed order.
TARGET = StructType(
    _strings("seriousness") + [StructField("seriousness_criteria", ArrayType(S))]
    + [StructField("meddra_pt", S), StructField("meddra_pt_code", LongType()),
       StructField("meddra_soc", S), StructField("meddra_soc_code", LongType())]
    + _strings("labelling_status", "labelling_evidence", "who_umc_category"))

# Four scored fields of an evaluation pair.
SCORED = StructType(_strings("seriousness", "labelling_status", "meddra_pt", "meddra_soc"))

# D13 eval row.
_PGM = StructType(_strings("pred", "gold") + [StructField("match", BooleanType())])
EVAL_ROW = StructType([
    StructField("index", LongType()), StructField("parse_ok", BooleanType()),
    StructField("narrative", S),
    StructField("seriousness", _PGM), StructField("labelling", _PGM),
    StructField("meddra_pt", _PGM), StructField("meddra_soc", _PGM)])

# D14 inference row (error nullable) and its metadata.
META = StructType([StructField("inference_time_s", DoubleType()), StructField("raw_tokens", IntegerType())])

# D15 token sequences.
TOKENS = StructType([StructField("input_ids", ArrayType(IntegerType())),
                     StructField("attention_mask", ArrayType(IntegerType()))])
