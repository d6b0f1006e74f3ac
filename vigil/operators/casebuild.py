"""Case build: clean report + codes + label assessment -> generated case record.

Field formatting and prompt rendering are native ``concat`` expressions.
Text generation is pluggable: the built-in writer is a deterministic
template (native, testable offline); any other generator runs through
``mapInPandas`` with one error column instead of a swallowed exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_map, strip_echo, utrim

# ---- fixed values (must equal the reference's) ----------------------------------
# Action taken with the drug, by dechallenge code; '' = omitted.
ACTION_TAKEN = {"1": "The drug was discontinued.", "2": "The drug dose was reduced.",
                "3": "The drug was continued without change.", "4": "", "": ""}
NOT_REPORTED = "Not reported"
UNKNOWN_INDICATION = "unknown indication"

NARRATIVE_EXAMPLE = (
    "### Example\n"
    "Input:\n"
    "Drug: Atorvastatin 40 mg once daily | Adverse event: Myopathy | "
    "Indication: Hypercholesterolaemia | Patient: 58-year-old male | "
    "Outcome: Recovered/Resolved | Serious: Non-serious | Action: Drug withdrawn\n"
    "\n"
    "Narrative:\n"
    "A 58-year-old male patient with hypercholesterolaemia was prescribed atorvastatin "
    "40 mg once daily. After approximately three months of treatment, he developed "
    "bilateral proximal muscle weakness and myalgia. Creatine kinase levels were "
    "elevated on laboratory testing. Atorvastatin was discontinued and his symptoms "
    "resolved gradually over four weeks.")

NARRATIVE_PROMPT = (
    "You are a pharmacovigilance medical writer. "
    "Write a concise clinical safety narrative (3-5 sentences) in ICH E2D format.\n"
    "\n"
    "{example}\n"
    "\n"
    "### Now write a narrative for:\n"
    "Input:\n"
    "Drug: {drug_name}{dose_info} | Adverse event: {reaction_pt} | "
    "Indication: {indication} | Patient: {age_sex} | "
    "Outcome: {outcome} | Serious: {serious} | Action: {action_taken}\n"
    "\n"
    "Rules:\n"
    "- Third person, past tense\n"
    "- Mention temporal relationship (e.g. \"after X weeks of treatment\")\n"
    "- Include the action taken with respect to the drug\n"
    "- State the outcome\n"
    "- Return ONLY the narrative text, no labels or JSON\n"
    "\n"
    "Narrative:")

LABELLING_PROMPT_WITH_LABEL = (
    "You are a senior pharmacovigilance specialist assessing labelling status.\n"
    "\n"
    "Drug: {drug_name}\n"
    "Adverse Event (MedDRA PT): {reaction_pt}\n"
    "\n"
    "Adverse Reactions section from the official FDA prescribing information:\n"
    "---\n"
    "{label_excerpt}\n"
    "---\n"
    "\n"
    "Is \"{reaction_pt}\" an Expected or Unexpected adverse reaction based on this label?\n"
    "- Expected: this reaction (or a closely related term) is mentioned in the adverse reactions section\n"
    "- Unexpected: this reaction is not listed in the label\n"
    "\n"
    "Return ONLY valid JSON with exactly these two keys:\n"
    "{{\n"
    "  \"labelling_status\": \"Expected\" or \"Unexpected\",\n"
    "  \"labelling_evidence\": \"<one sentence citing specific label text or explaining why it is not listed>\"\n"
    "}}")

LABELLING_PROMPT_NO_LABEL = (
    "You are a senior pharmacovigilance specialist assessing labelling status.\n"
    "\n"
    "Drug: {drug_name}\n"
    "Adverse Event (MedDRA PT): {reaction_pt}\n"
    "Indication: {indication}\n"
    "\n"
    "Based on your medical knowledge of {drug_name} and its drug class, is \"{reaction_pt}\" "
    "a known adverse reaction typically listed in the prescribing information?\n"
    "- Expected: the reaction is commonly associated with this drug or its class\n"
    "- Unexpected: the reaction is not typically associated with this drug or its class\n"
    "\n"
    "Return ONLY valid JSON with exactly these two keys:\n"
    "{{\n"
    "  \"labelling_status\": \"Expected\" or \"Unexpected\",\n"
    "  \"labelling_evidence\": \"<one sentence explaining the pharmacological basis>\"\n"
    "}}")
# Generation parameters per call: (max_tokens, temperature).
NARRATIVE_CALL = (250, 0.5)
LABELLING_CALL = (200, 0.1)
# ---------------------------------------------------------------------------------


def action_text(c="drug_additional") -> Column:
    """Action sentence from the dechallenge code; unknown -> 'Not reported'."""
    a = code_map(F.col(c) if isinstance(c, str) else c, ACTION_TAKEN, "")
    return F.when(a == "", F.lit(NOT_REPORTED)).otherwise(a)


def seriousness_label(c="serious") -> Column:
    """L6."""
    return F.when(F.col(c), "Serious").otherwise("Non-serious")


def prompt_fields(df: DataFrame) -> DataFrame:
    """Formatted fields the prompts use."""
    dose = F.coalesce(F.col("drug_dose"), F.lit(""))
    age = F.coalesce(F.col("patient_age"), F.lit(""))
    sex = F.coalesce(F.col("patient_sex"), F.lit("unknown"))
    ind = F.coalesce(F.col("drug_indication"), F.lit(""))
    return (df.withColumn("dose_info", F.when(dose != "", F.concat(F.lit(" "), dose)).otherwise(""))
              .withColumn("age_sex", F.when(age != "", F.concat(age, F.lit("-year-old "), sex)).otherwise(sex))
              .withColumn("indication", F.when(ind != "", ind).otherwise(UNKNOWN_INDICATION))
              .withColumn("seriousness", seriousness_label())
              .withColumn("action_taken", action_text()))


def render(template: str, **cols: Column) -> Column:
    """``str.format`` over columns: literal pieces and column values joined
    by one ``concat`` (``{{``/``}}`` are literal braces)."""
    import string
    parts = []
    for lit, field, _spec, _conv in string.Formatter().parse(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            parts.append(cols[field])
    return F.concat(*parts)


def narrative_prompt(df: DataFrame) -> Column:
    """The narrative prompt of one row (one-shot example inserted)."""
    return render(NARRATIVE_PROMPT, example=F.lit(NARRATIVE_EXAMPLE), drug_name=F.col("drug_name"),
                  dose_info=F.col("dose_info"), reaction_pt=F.col("reaction_pt"),
                  indication=F.col("indication"), age_sex=F.col("age_sex"),
                  outcome=F.col("reaction_outcome"), serious=F.col("seriousness"),
                  action_taken=F.col("action_taken"))


def labelling_prompt() -> Column:
    """Labelling prompt, with or without label text."""
    with_label = render(LABELLING_PROMPT_WITH_LABEL, drug_name=F.col("drug_name"),
                        reaction_pt=F.col("reaction_pt"), label_excerpt=F.col("label_excerpt"))
    no_label = render(LABELLING_PROMPT_NO_LABEL, drug_name=F.col("drug_name"),
                      reaction_pt=F.col("reaction_pt"), indication=F.col("indication"))
    return F.when(F.col("label_text") != "", with_label).otherwise(no_label)


def template_narrative() -> Column:
    """Built-in deterministic writer (default generator): third person, past
    tense, onset, action taken, outcome.  Pure function of the row, so a
    re-run task writes identical text."""
    onset = ((F.length("id") + F.length("reaction_pt")) % 12 + 1).cast("string")
    crit = F.array_join(F.coalesce(F.col("seriousness_criteria"), F.array().cast("array<string>")), ", ")
    return F.concat(
        F.lit("A "), F.col("age_sex"), F.lit(" patient with "), F.col("indication"),
        F.lit(" received "), F.col("drug_name"), F.col("dose_info"),
        F.lit(". After "), onset, F.lit(" weeks of treatment, the patient developed "),
        F.lower(F.col("reaction_pt")), F.lit(". "),
        F.when(F.col("action_taken") == NOT_REPORTED, F.lit("No action with the drug was reported."))
         .otherwise(F.col("action_taken")),
        F.lit(" The event was assessed as "), F.lower(F.col("seriousness")),
        F.lit(" and the outcome was "), F.lower(F.col("reaction_outcome")), F.lit("."),
        F.when(crit != "", F.concat(F.lit(" The event led to "), F.lower(crit), F.lit(".")))
         .otherwise(F.lit("")))


Generator = Callable[[pd.Series, int, float], pd.Series]


def generate_with(df: DataFrame, prompt_col: str, out_col: str, generator: Generator,
                  max_tokens: int, temperature: float, parallelism: int | None = None) -> DataFrame:
    """Run a pluggable text generator over a table in Arrow batches.
    ``generator(prompts, max_tokens, temperature) -> texts``; a failing batch
    is tried again record by record; records that fail have ``<out_col>_error``.  Parallelism =
    number of partitions (``repartition`` sets the in-flight request count)."""
    if parallelism:
        df = df.repartition(parallelism)
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out_col, StringType()),
                                                  StructField(out_col + "_error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                pdf[out_col] = generator(pdf[prompt_col], max_tokens, temperature).astype(object)
                pdf[out_col + "_error"] = None
            except Exception:  # noqa: BLE001 - one bad record must not take its batch along
                one = [alone(pdf[prompt_col].iloc[i:i + 1]) for i in range(len(pdf))]
                pdf[out_col] = pd.Series([t for t, _ in one], index=pdf.index, dtype=object)
                pdf[out_col + "_error"] = pd.Series([e for _, e in one], index=pdf.index, dtype=object)
            yield pdf

    def alone(prompt: pd.Series) -> tuple[str | None, str | None]:
        try:
            return generator(prompt, max_tokens, temperature).iloc[0], None
        except Exception as e:  # noqa: BLE001
            return None, f"{type(e).__name__}: {e}"

    return df.mapInPandas(run, schema)


CASE_COLUMNS = ["id", "narrative", "narrative_source", "seriousness", "seriousness_criteria",
                "meddra_llt", "meddra_llt_code", "meddra_pt", "meddra_pt_code", "meddra_soc",
                "meddra_soc_code", "labelling_status", "labelling_evidence", "label_source",
                "who_umc_category"]


def assemble_cases(df: DataFrame, narrative_col: str = "narrative_raw") -> DataFrame:
    """L10 + L11: strip an echoed label, then the 15-column case record
    (LLT defaults to PT; causality defaults to 'Unassessable')."""
    return df.select(
        "id",
        strip_echo(F.col(narrative_col)).alias("narrative"),
        F.lit("generated").alias("narrative_source"),
        "seriousness",
        F.coalesce(F.col("seriousness_criteria"), F.array().cast("array<string>")).alias("seriousness_criteria"),
        F.coalesce(F.col("meddra_llt"), F.col("meddra_pt")).alias("meddra_llt"),
        "meddra_llt_code", "meddra_pt", "meddra_pt_code",
        F.coalesce(F.col("meddra_soc"), F.lit("")).alias("meddra_soc"), "meddra_soc_code",
        "labelling_status", F.coalesce(F.col("labelling_evidence"), F.lit("")).alias("labelling_evidence"),
        "label_source",
        F.coalesce(F.col("who_umc_preliminary"), F.lit("Unassessable")).alias("who_umc_category"))


def pending(todo: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows not yet processed (resume)."""
    return todo.join(done.select(key), key, "left_anti")


# Fixed value: the message for a narrative under the limit.
SHORT_NARRATIVE = ("Narrative is too short. Please provide a complete clinical case description "
                   "(patient demographics, drug, adverse event, outcome).")


def short_input_gate(c, min_chars: int = 60) -> Column:
    """Reason a narrative is refused before scoring (null = accepted)."""
    t = utrim(c)
    return (F.when(t == "", "Please enter a clinical narrative.")
            .when(F.length(t) < min_chars, SHORT_NARRATIVE))


# Seriousness from narrative text (keyword rules, criteria in fixed order)
SERIOUS_RULES = [
    ("Death", r"(?i)\b(died|death|fatal)\b"),
    ("Life-threatening", r"(?i)life[- ]threatening"),
    ("Hospitalization", r"(?i)\b(hospitali[sz]\w*|admitted)\b"),
    ("Disability/Incapacity", r"(?i)\b(permanent disability|disabilit\w*|incapacit\w*)\b"),
    ("Congenital Anomaly", r"(?i)\b(congenital|birth defect)\b"),
    ("Medically Significant", r"(?i)\bmedically significant\b"),
]


def seriousness_from_text(c) -> tuple[Column, Column]:
    """(label, criteria array) from keyword rules over the text."""
    x = F.col(c) if isinstance(c, str) else c
    crit = F.array_compact(F.array(*[F.when(x.rlike(rx), F.lit(lbl)) for lbl, rx in SERIOUS_RULES]))
    label = F.when(F.size(crit) > 0, "Serious").otherwise("Non-serious")
    return label, crit


def display_fields(df: DataFrame) -> DataFrame:
    """Criteria joined ', ' or 'None'; 'name [code]'; em dash for missing."""
    dash = F.lit("—")
    crit = F.array_join(F.coalesce(F.col("seriousness_criteria"), F.array().cast("array<string>")), ", ")
    return df.select(
        "*",
        F.when(crit != "", crit).otherwise("None").alias("criteria_display"),
        F.concat(F.coalesce(F.col("meddra_pt"), dash), F.lit(" ["),
                 F.coalesce(F.col("meddra_pt_code").cast("string"), dash), F.lit("]")).alias("pt_display"),
        F.concat(F.coalesce(F.col("meddra_soc"), dash), F.lit(" ["),
                 F.coalesce(F.col("meddra_soc_code").cast("string"), dash), F.lit("]")).alias("soc_display"))


def run_metadata(seconds: Column, n_tokens: Column) -> Column:
    """The metadata struct added on scoring (seconds rounded to 2)."""
    return F.struct(F.round(seconds, 2).alias("inference_time_s"), n_tokens.cast("int").alias("raw_tokens"))


# ---- L14: batch scoring of narratives (inference rows, D14) ----------------
INFER_CALL = (600, 0.1)          # max new tokens, temperature (fixed values)
PARSE_FAILED = "JSON parse failed"


def batch_score(narratives: DataFrame, generator: Generator, lookup: DataFrame,
                key: str = "line_id", text_col: str = "narrative") -> DataFrame:
    """L14 + L16 + J4: narrative rows -> inference prompt (T17) -> generator
    (Arrow batches) -> robust JSON extraction with end-marker strip (T2-T4)
    -> dictionary codes attached (J4).  One row per narrative: the parsed
    fields, codes, ``_narrative`` and metadata, or ``error`` +
    ``raw_output`` when the output holds no JSON object."""
    from ..functions import chat as CH
    from ..functions import jsonx as JX
    from .coding import attach_codes
    x = narratives.select(key, F.col(text_col).alias("_narrative"), CH.infer_prompt(text_col).alias("prompt"))
    g = generate_with(x, "prompt", "raw_output", generator, *INFER_CALL)
    g = JX.with_json_robust(g, "raw_output", "parsed", strip_marker=True)
    v = F.col("parsed")
    rows = g.select(
        key, "_narrative", "raw_output", F.col("raw_output_error").alias("generator_error"),
        v.isNotNull().alias("parse_ok"),
        JX.field(v, "seriousness").alias("seriousness"),
        JX.field(v, "seriousness_criteria", "array<string>").alias("seriousness_criteria"),
        JX.field(v, "meddra_pt").alias("meddra_pt"), JX.field(v, "meddra_soc").alias("meddra_soc"),
        JX.field(v, "labelling_status").alias("labelling_status"),
        JX.field(v, "labelling_evidence").alias("labelling_evidence"),
        JX.field(v, "who_umc_category").alias("who_umc_category"),
        run_metadata(F.lit(0.0), F.size(F.split("raw_output", r"\s+"))).alias("_meta"))
    coded = attach_codes(rows, lookup)
    return coded.select(
        "*", F.when(~F.col("parse_ok"), F.lit(PARSE_FAILED)).alias("error"))
