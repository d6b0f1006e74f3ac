"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame
over the driver tables (or data Spark derives from them).

Output columns are aliased to the names the DuckDB oracle uses; array
columns are rendered with ``array_join(.., '|')`` for an engine-neutral
value hash (the operators themselves return arrays)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import profile as P
from . import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --------------------------------------------------------------- reports ----
def clean_reports(spark: SparkSession, sf: str) -> DataFrame:
    lines = bridge.report_lines(spark, sf)
    return N.normalize_relational(bridge.report_headers(spark, sf), lines, lines)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("seriousness_criteria", F.array_join("seriousness_criteria", "|"))


@query("report_normalize")
def report_normalize(spark, sf):
    return _flat(clean_reports(spark, sf))


@query("report_rejects")
def report_rejects(spark, sf):
    lines = bridge.report_lines(spark, sf)
    return N.rejects_relational(bridge.report_headers(spark, sf), lines, lines)


@query("causality_by_category")
def causality_by_category(spark, sf):
    return P.value_counts(clean_reports(spark, sf), "who_umc_preliminary", "category")


@query("causality_distribution")
def causality_distribution(spark, sf):
    return P.distribution(clean_reports(spark, sf), "who_umc_preliminary", "category")


@query("suspect_drug_pick")
def suspect_drug_pick(spark, sf):
    return clean_reports(spark, sf).select("id", "drug_name", "drug_dose", "drug_indication",
                                           "drug_additional", "drug_recurrence")


@query("criteria_counts")
def criteria_counts(spark, sf):
    return P.unnest_counts(clean_reports(spark, sf), "seriousness_criteria", "criterion")


@query("concomitant_count")
def concomitant_count(spark, sf):
    return P.value_counts(clean_reports(spark, sf), "concomitant_drugs")


@query("outcome_sex_decode")
def outcome_sex_decode(spark, sf):
    return clean_reports(spark, sf).groupBy("reaction_outcome", "patient_sex").agg(
        F.count(F.lit(1)).alias("n"))


@query("schema_backfill")
def schema_backfill(spark, sf):
    """Rows of even report id arrive in the old 12-column layout (the
    causality inputs are missing), the rest in the new one; P14 re-derives."""
    clean = clean_reports(spark, sf)
    is_old = F.col("id").cast("long") % 2 == 0
    old = clean.where(is_old).drop("drug_additional", "drug_recurrence", "concomitant_drugs",
                                   "who_umc_preliminary")
    new = clean.where(~is_old)
    return _flat(N.union_layouts(old, new)).select(
        "id", "drug_additional", "drug_recurrence", "concomitant_drugs", "who_umc_preliminary")


@query("report_profile")
def report_profile(spark, sf):
    c = clean_reports(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("n_reports"),
                 F.count_if("has_narrative").alias("n_with_narrative"),
                 F.avg(F.col("has_narrative").cast("int")).alias("share_with_narrative"),
                 F.count_if("serious").alias("n_serious"),
                 F.avg(F.col("serious").cast("int")).alias("share_serious"))


@query("top_reactions")
def top_reactions(spark, sf):
    return P.top_k(clean_reports(spark, sf), "reaction_pt", 10)


@query("top_drugs")
def top_drugs(spark, sf):
    return P.top_k(clean_reports(spark, sf), "drug_name", 10)


# ------------------------------------------------------------ dictionary ----
from ..operators import coding as C  # noqa: E402
from ..operators import dictionary as D  # noqa: E402
from ..session import cut_lineage, read_table, staged  # noqa: E402


def dict_sheets(spark, sf):
    return bridge.dictionary_tables(spark, sf)


def lookup_table(spark, sf) -> DataFrame:
    """Built once per job and checkpointed to the shared checkpoint folder,
    so its size check and the joins that use it read the materialised rows."""
    return cut_lineage(D.build_lookup(*dict_sheets(spark, sf)))


@query("dict_names")
def dict_names(spark, sf):
    names, _, _ = dict_sheets(spark, sf)
    return D.term_names(names)


@query("dict_first_soc")
def dict_first_soc(spark, sf):
    names, levels, edges = dict_sheets(spark, sf)
    return D.first_soc(edges, levels, names)


@query("dict_lookup")
def dict_lookup(spark, sf):
    return D.build_lookup(*dict_sheets(spark, sf))


@query("dict_soc_coverage")
def dict_soc_coverage(spark, sf):
    return D.coverage(*dict_sheets(spark, sf))


@query("dict_level_counts")
def dict_level_counts(spark, sf):
    _, levels, _ = dict_sheets(spark, sf)
    return D.level_counts(levels)


@query("dict_adjacency")
def dict_adjacency(spark, sf):
    _, _, edges = dict_sheets(spark, sf)
    return D.parent_summary(edges)


@query("dict_children")
def dict_children(spark, sf):
    _, _, edges = dict_sheets(spark, sf)
    return D.child_summary(edges)


# ---------------------------------------------------------------- coding ----
_CODE_OUT = ["id", "reaction_pt", "meddra_pt", "meddra_pt_code", "meddra_soc", "meddra_soc_code"]


@query("code_exact")
def code_exact(spark, sf):
    return C.code_exact(clean_reports(spark, sf), lookup_table(spark, sf)).select(*_CODE_OUT)


@query("code_drop_unmatched")
def code_drop_unmatched(spark, sf):
    coded = C.code_terms(clean_reports(spark, sf), lookup_table(spark, sf), scorer="levenshtein")
    return C.drop_unmatched(coded).select(*_CODE_OUT, "match_type")


@query("code_fuzzy_lev")
def code_fuzzy_lev(spark, sf):
    """Best dictionary key (edit-distance score) for each distinct exact miss; null if none is similar enough."""
    clean = clean_reports(spark, sf)
    lk = lookup_table(spark, sf)
    miss = cut_lineage(C.code_exact(clean, lk).where(F.col("meddra_pt").isNull()).select(C.exact_key("reaction_pt").alias("term")).distinct())
    best = C.fuzzy_best(miss, lk, "levenshtein")
    return miss.join(best, "term", "left").select("term", "pt_key", "score", F.col("score").isNotNull().alias("accepted"))


@query("code_fuzzy_weighted")
def code_fuzzy_weighted(spark, sf):
    clean = staged(clean_reports(spark, sf).select("id", "reaction_pt"), "clean")  # read for the terms and for the rows
    lk = lookup_table(spark, sf)
    return C.code_terms(clean, lk, scorer="weighted").select(*_CODE_OUT, "match_type", "match_score")


@query("code_coverage")
def code_coverage(spark, sf):
    terms = clean_reports(spark, sf).select("reaction_pt").distinct()
    coded = C.code_terms(terms, lookup_table(spark, sf), scorer="levenshtein")
    return C.coverage(terms, coded)


def predictions_from_lines(spark, sf) -> DataFrame:
    """A predictions table: every order line's raw reaction text as the
    predicted PT (untrimmed, mixed case) and a predicted SOC name."""
    lines = bridge.report_lines(spark, sf)
    return lines.select(
        "report_key", F.col("reactionmeddrapt").alias("meddra_pt"),
        F.when(F.col("report_key") % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("predicted "), F.col("drugindication"))).alias("meddra_soc"))


@query("code_attach_predictions")
def code_attach_predictions(spark, sf):
    return C.attach_codes(predictions_from_lines(spark, sf), lookup_table(spark, sf)).select(
        "report_key", "meddra_pt", "meddra_pt_code", "meddra_soc", "meddra_soc_code")


# ---------------------------------------------------------------- labels ----
from ..operators import labels as L  # noqa: E402


def label_cache(spark, sf, clean: DataFrame | None = None) -> DataFrame:
    """One row per distinct drug; materialised so that what joins it reads it once."""
    return staged(L.label_cascade(clean_reports(spark, sf) if clean is None else clean, bridge.label_rows(spark, sf)), "labels")


def labelled_reports(spark, sf) -> DataFrame:
    clean = staged(clean_reports(spark, sf).select("id", "drug_name", "reaction_pt"), "reports")
    return L.assess(clean, label_cache(spark, sf, clean))


@query("label_cascade")
def label_cascade(spark, sf):
    return label_cache(spark, sf)


@query("label_expectedness")
def label_expectedness(spark, sf):
    return labelled_reports(spark, sf).select("id", "drug_name", "reaction_pt", "label_source",
                                              "labelling_status", "needs_review")


@query("label_evidence")
def label_evidence(spark, sf):
    return labelled_reports(spark, sf).where(F.col("label_source") == L.LABEL_SOURCE_LABEL) \
        .select("id", "labelling_evidence")


@query("label_coverage")
def label_coverage(spark, sf):
    return L.coverage(label_cache(spark, sf), labelled_reports(spark, sf))


# ------------------------------------------------------------ case build ----
from ..operators import casebuild as CB  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from ..functions import chat as CH  # noqa: E402
from ..functions import jsonx as JX  # noqa: E402


def case_inputs(spark, sf) -> DataFrame:
    """clean -> codes (exact, then edit-distance fuzzy; unmatched dropped)
    -> expectedness by label, else by class -> formatted prompt fields.

    The clean table feeds three branches (exact hits, fuzzy misses, the
    label cache), so it is materialised once (Parquet in the shared folder)
    instead of re-reading and re-aggregating the source tables per branch."""
    return CB.prompt_fields(L.class_rule(assessed_cases(spark, sf)))


def assessed_cases(spark, sf) -> DataFrame:
    """Coded reports with the label's verdict and the counts of the organ class."""
    clean = staged(clean_reports(spark, sf), "clean")
    coded = staged(C.drop_unmatched(C.code_terms(clean, lookup_table(spark, sf), scorer="levenshtein")), "coded")
    return L.class_evidence(L.assess(coded, label_cache(spark, sf, clean)))


def generated_cases(spark, sf) -> DataFrame:
    return CB.assemble_cases(case_inputs(spark, sf).withColumn("narrative_raw", CB.template_narrative()))


@query("action_text")
def action_text(spark, sf):
    return clean_reports(spark, sf).select("id", "drug_additional", CB.action_text().alias("action_taken"))


@query("prompt_render")
def prompt_render(spark, sf):
    x = CB.prompt_fields(clean_reports(spark, sf))
    return x.select("id", CB.narrative_prompt(x).alias("prompt"))


@query("labelling_prompt_render")
def labelling_prompt_render(spark, sf):
    x = CB.prompt_fields(L.join_labels(clean_reports(spark, sf), label_cache(spark, sf)))
    return x.select("id", CB.labelling_prompt().alias("prompt"))


@query("narrative_template")
def narrative_template(spark, sf):
    return generated_cases(spark, sf).select("id", "narrative")


@query("case_records")
def case_records(spark, sf):
    return _flat(generated_cases(spark, sf))


@query("strip_echo")
def strip_echo_q(spark, sf):
    """An echoed 'Narrative:' label (three casings) is removed again."""
    g = generated_cases(spark, sf)
    k = F.col("id").cast("long") % 3
    echoed = (F.when(k == 0, F.concat(F.lit("Narrative: "), "narrative"))
              .when(k == 1, F.concat(F.lit("NARRATIVE:\n  "), "narrative")).otherwise(F.col("narrative")))
    from ..functions.text import strip_echo
    return g.select("id", strip_echo(echoed).alias("narrative"))


@query("resume_anti_join")
def resume_anti_join(spark, sf):
    """Serious reports were generated in an earlier run; the rest is to do."""
    clean = clean_reports(spark, sf)
    done = clean.where(F.col("serious")).select("id")
    return CB.pending(clean, done).select("id")


@query("seriousness_rules")
def seriousness_rules(spark, sf):
    label, crit = CB.seriousness_from_text("narrative")
    return generated_cases(spark, sf).select("id", label.alias("pred_seriousness"),
                                             F.array_join(crit, "|").alias("pred_criteria"))


@query("short_input_gate")
def short_input_gate(spark, sf):
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return conv.where(F.col("role") == "user").select(
        "conv_id", "turn", CB.short_input_gate("text").alias("reject_reason"))


#: Fixture: what breaks some of the cases, so that every rule of the validation has rows.
DEFECTS = {
    "narrative": "CASE WHEN CAST(id AS BIGINT) % 41 = 0 THEN substr(narrative, 1, 99) ELSE narrative END",
    "meddra_pt": "CASE WHEN CAST(id AS BIGINT) % 43 = 1 THEN '' WHEN CAST(id AS BIGINT) % 43 = 2 THEN NULL ELSE meddra_pt END",
    "seriousness": "CASE WHEN CAST(id AS BIGINT) % 47 = 3 THEN 'Maybe' WHEN CAST(id AS BIGINT) % 47 = 4 THEN NULL ELSE seriousness END",
    "who_umc_category": "CASE WHEN CAST(id AS BIGINT) % 53 = 5 THEN 'Likely' ELSE who_umc_category END",
    "labelling_status": "CASE WHEN CAST(id AS BIGINT) % 59 = 6 THEN 'Unknown' ELSE labelling_status END",
}


@query("validate_reasons")
def validate_reasons(spark, sf):
    """V1 + V2 over cases of which some were given defects of every kind."""
    cases = generated_cases(spark, sf)
    return Q.reason_counts(cases.select(*[F.expr(DEFECTS[c]).alias(c) if c in DEFECTS else F.col(c) for c in cases.columns]))


def valid_cases(spark, sf) -> DataFrame:
    return Q.valid_only(generated_cases(spark, sf))


def chat_records(spark, sf) -> DataFrame:
    # the validated dataset is a stage output (materialised once): the JSON
    # rendering reads it in two branches (native ASCII rows, Arrow for the rest)
    cases = valid_cases(spark, sf).select("id", "narrative", *JX.TARGET_KEYS)
    v = JX.with_target_json(staged(cases, "valid"), "assistant_json")
    return v.select("id", "narrative", "seriousness", "labelling_status",
                    CH.chat_messages("narrative", "assistant_json").alias("messages"))


@query("chat_messages")
def chat_messages(spark, sf):
    c = chat_records(spark, sf)
    return c.select("id", F.array_join(F.transform("messages", lambda m: m["role"]), "|").alias("roles"),
                    F.col("messages")[1]["content"].alias("user_content"),
                    F.col("messages")[2]["content"].alias("assistant_content"))


@query("chat_flat_text")
def chat_flat_text(spark, sf):
    return chat_records(spark, sf).select("id", CH.flat_text("messages").alias("text"))


@query("narrative_roundtrip")
def narrative_roundtrip(spark, sf):
    """T5 + T6 over the chat records: narrative and gold fields come back."""
    c = chat_records(spark, sf).withColumn("_gold_text", CH.first_assistant("messages"))
    c = JX.with_json_robust(c, "_gold_text", "_gold")
    gold = F.col("_gold")
    return c.select("id", CH.narrative_from_messages("messages").alias("narrative"),
                    JX.field(gold, "seriousness").alias("gold_seriousness"),
                    JX.field(gold, "meddra_pt").alias("gold_meddra_pt"),
                    JX.field(gold, "meddra_soc_code", "bigint").alias("gold_meddra_soc_code"),
                    JX.field(gold, "labelling_status").alias("gold_labelling_status"))


@query("narrative_pull")
def narrative_pull(spark, sf):
    """T5 relational form over the conversations table: first user turn that
    holds a marker, per conversation ('' when none)."""
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    hit = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", CH.narrative_after_marker("text").alias("n"))
    first = hit.where(F.col("n").isNotNull()).groupBy("conv_id").agg(F.min_by("n", "turn").alias("n"))
    ids = conv.select("conv_id").distinct()
    return ids.join(first, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit("")).alias("narrative"))


@query("token_estimate")
def token_estimate(spark, sf):
    from ..functions.text import token_estimate as te
    return chat_flat_text(spark, sf).select("id", te("text").alias("n_tokens"))


@query("length_describe")
def length_describe(spark, sf):
    from ..functions.text import token_estimate as te
    t = staged(chat_flat_text(spark, sf).select(te("text").alias("n_tokens")), "lengths")  # read by the profile and the limits
    d = P.describe_exact(t, "n_tokens")
    over = t.agg(F.count_if(F.col("n_tokens") > 2048).alias("over_2048"),
                 F.count_if(F.col("n_tokens") > 1024).alias("over_1024"))
    return d.select("*", over.select("over_2048").scalar().alias("over_2048"),
                    over.select("over_1024").scalar().alias("over_1024"))


@query("document_length_describe")
def document_length_describe(spark, sf):
    docs = read_table(spark, sf, "documents", "text", fact=True)
    return P.describe_exact(docs.select(F.length("text").alias("n_chars")), "n_chars")


def split_input(spark, sf) -> DataFrame:
    """The split reads its input three times (bucket counts, settled rows,
    the cut bucket), so what it and the balance need of the valid cases is
    materialised first: a stage output, like the reference's validated dataset file."""
    return staged(valid_cases(spark, sf).select("id", "seriousness", "labelling_status"), "valid")


@query("split_exact")
def split_exact(spark, sf):
    return Q.exact_split(split_input(spark, sf)).select("id", "split")


@query("split_balance")
def split_balance(spark, sf):
    return Q.split_balance(Q.exact_split(split_input(spark, sf)))


@query("case_profile")
def case_profile(spark, sf):
    """A3 over several columns at once: (column, value) value counts."""
    g = generated_cases(spark, sf)
    cols = ["seriousness", "labelling_status", "label_source", "who_umc_category", "narrative_source"]
    long = g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                                 F.coalesce(F.col(c), F.lit("None")).alias("value"))
                                        for c in cols])).alias("kv")).select("kv.*")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@query("top_socs")
def top_socs(spark, sf):
    return P.top_k(generated_cases(spark, sf), "meddra_soc", 5)


# ------------------------------------------------------- JSON extraction ----
from ..functions.text import strip_think, utrim  # noqa: E402

# model-output forms derived from events: plain, fenced, think-block with a
# decoy, prose with two objects, unbalanced, brace inside a string
OUTPUT_OBJECT = ("'{\"event\": \"' || event_type || '\", \"props\": ' || props || ', \"user\": ' "
                 "|| CAST(user_id AS STRING) || '}'")
OUTPUT_FORMS = (
    "CASE event_id % 6 "
    "WHEN 0 THEN obj "
    "WHEN 1 THEN 'Assessment:' || chr(10) || '```json' || chr(10) || obj || chr(10) || '```' || chr(10) || 'End.' "
    "WHEN 2 THEN '<think>maybe {\"event\": \"none\"}</think>' || chr(10) || obj "
    "WHEN 3 THEN 'Result: ' || obj || ' Alternative: {\"event\": \"other\"}' "
    "WHEN 4 THEN 'Result: ' || substr(obj, 1, length(obj) - 1) "
    "ELSE '{\"event\": \"' || event_type || '}\", \"user\": 1}' END")


def model_outputs(spark, sf) -> DataFrame:
    ev = read_table(spark, sf, "events", "event_id", "event_type", "user_id", "props", fact=True)
    return ev.withColumn("obj", F.expr(OUTPUT_OBJECT)).select("event_id", F.expr(OUTPUT_FORMS).alias("raw"))


def _json_fields(v):
    return [JX.field(v, "event").alias("event"), JX.field(v, "user", "bigint").alias("user"),
            JX.field(v, "props.k", "bigint").alias("k")]


@query("json_fenced")
def json_fenced(spark, sf):
    """Three-tier extraction (whole text, fenced block, greedy span)."""
    m = JX.with_json_tiers(model_outputs(spark, sf), "raw", "v")
    return m.select("event_id", F.col("v").isNotNull().alias("parse_ok"), *_json_fields(F.col("v")))


@query("json_depth_scan")
def json_depth_scan(spark, sf):
    """Think-strip, fenced block, else first balanced block (must parse)."""
    m = JX.with_json_robust(model_outputs(spark, sf), "raw", "v")
    return m.select("event_id", F.col("v").isNotNull().alias("parse_ok"), *_json_fields(F.col("v")))


@query("think_strip")
def think_strip(spark, sf):
    """T3 + T4: think blocks and the end marker removed."""
    from ..functions.text import strip_end_marker
    m = model_outputs(spark, sf).withColumn("raw", F.concat("raw", F.lit("<|im_end|>")))
    return m.select("event_id", utrim(strip_end_marker(strip_think(F.col("raw")))).alias("text"))



# ------------------------------------------------------------- evaluation ----
from ..operators import evaluate as EV  # noqa: E402

PRED_RULES = {
    "base": {
        "seriousness": "CASE WHEN n_chars > 5000 THEN 'Serious' ELSE 'Non-serious' END",
        "labelling_status": "CASE WHEN doc_id % 3 = 0 THEN 'Expected' ELSE 'Unexpected' END",
        "meddra_pt": "CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END",
        "meddra_soc": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END",
    },
    "tuned": {
        "seriousness": "CASE WHEN n_chars > 2000 THEN 'Serious' ELSE 'Non-serious' END",
        "labelling_status": "CASE WHEN length(text) % 2 = 0 THEN 'Expected' ELSE 'Unexpected' END",
        "meddra_pt": "lang",
        "meddra_soc": "source",
    },
}
GOLD_RULES = {
    "seriousness": "CASE WHEN quality = 1 THEN 'Serious' ELSE 'Non-serious' END",
    "labelling_status": "CASE WHEN toxic = 1 THEN 'Expected' ELSE 'Unexpected' END",
    "meddra_pt": "lang",
    "meddra_soc": "source",
}
PRED_FORMS = (
    "CASE doc_id % 5 WHEN 0 THEN obj "
    "WHEN 1 THEN 'Here is the review:' || chr(10) || '```json' || chr(10) || obj || chr(10) || '```' "
    "WHEN 2 THEN '<think>checking</think>' || obj "
    "WHEN 3 THEN substr(obj, 1, length(obj) - 1) "
    "ELSE 'Assessment follows. ' || obj || ' Hope this helps.' END")


def _jv(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'null' ELSE '\"' || {c} || '\"' END"


def eval_pairs(spark, sf, mode: str = "base", limit: int = 0) -> DataFrame:
    """Predictions (model-output text rendered from rules over `documents`)
    paired by index with gold (from `labels`); records without gold or
    narrative are skipped before scoring."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    gold = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    x = docs.join(gold, "doc_id", "inner")
    if limit:                       # V5: the first `limit` records by index (0 = all), cut before any is skipped
        x = x.orderBy("doc_id").limit(limit)
    x = x.where(utrim(F.col("text")) != "")
    pr = PRED_RULES[mode]
    for k, e in pr.items():
        x = x.withColumn(f"_p_{k}", F.expr(e))
    obj = ("'{\"seriousness\": ' || " + _jv("_p_seriousness") + " || ', \"meddra_pt\": ' || "
           + _jv("_p_meddra_pt") + " || ', \"meddra_soc\": ' || " + _jv("_p_meddra_soc")
           + " || ', \"labelling_status\": ' || " + _jv("_p_labelling_status") + " || '}'")
    x = x.withColumn("obj", F.expr(obj)).withColumn("raw_output", F.expr(PRED_FORMS))
    x = JX.with_json_robust(x, "raw_output", "_pv")
    v = F.col("_pv")
    cols = [F.col("doc_id").alias("index"), v.isNotNull().alias("parse_ok"), F.col("text").alias("narrative"),
            F.col("raw_output")]
    for k in GOLD_RULES:
        cols.append(F.when(v.isNotNull(), JX.field(v, k)).alias(f"pred_{k}"))
        cols.append(F.expr(GOLD_RULES[k]).alias(f"gold_{k}"))
    return x.select(*cols)


def scored(spark, sf, mode="base") -> DataFrame:
    return EV.score_pairs(eval_pairs(spark, sf, mode))


@query("eval_scored")
def eval_scored(spark, sf):
    s = scored(spark, sf)
    out = [F.col("index"), F.col("parse_ok"), F.col("narrative")]
    for name, _k, _h in EV.FIELDS:
        out += [F.col(f"{name}.pred").alias(f"{name}_pred"), F.col(f"{name}.gold").alias(f"{name}_gold"),
                F.col(f"{name}.match").alias(f"{name}_match")]
    return s.select(*out, "all_match")


@query("eval_counters")
def eval_counters(spark, sf):
    return EV.counters(scored(spark, sf))


@query("eval_rates")
def eval_rates(spark, sf):
    return EV.rates(EV.counters(scored(spark, sf)))


@query("eval_running")
def eval_running(spark, sf):
    return EV.running_log(scored(spark, sf))


@query("eval_compare")
def eval_compare(spark, sf):
    both = scored(spark, sf, "base").withColumn("mode", F.lit("base")).unionByName(
        scored(spark, sf, "tuned").withColumn("mode", F.lit("tuned")))
    return EV.compare_modes(EV.rates(EV.counters(both, "mode")))


@query("eval_samples")
def eval_samples(spark, sf):
    """The first five raw outputs (a sample report: the limit is the feature)."""
    return eval_pairs(spark, sf).orderBy("index").limit(5).select("index", "raw_output")


# -------------------------------------------------------------- streaming ----
import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..streaming import ingest as W  # noqa: E402



def scratch_dir(spark) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vigil-{uuid.uuid4().hex}"


@query("stream_ingest_dedup")
def stream_ingest_dedup(spark, sf, n_slices: int = 8, overlap_share: float = 0.05):
    """Events land as ``n_slices`` overlapping slices (each slice
    re-delivers the first rows of the next one, like a resumed fetch); the
    file stream ingests them two files per micro-batch, unique by event_id."""
    base = scratch_dir(spark)
    ev = read_table(spark, sf, "events", fact=True)
    span = ev.agg(F.max("event_id") + 1).scalar()
    slice_rows = F.greatest(F.ceil(span / n_slices), F.lit(1))
    s = F.floor(F.col("event_id") / slice_rows)
    in_overlap = (F.col("event_id") % slice_rows) < F.ceil(slice_rows * overlap_share)
    landed = ev.withColumn("slice", F.explode(F.when(in_overlap & (s > 0), F.array(s, s - 1))
                                              .otherwise(F.array(s))))
    (landed.repartition("slice").write.mode("overwrite").partitionBy("slice")
     .options(**W.JSON_TIME_OPTIONS).json(f"{base}/landing"))
    W.ingest_files(spark, f"{base}/landing", landed.schema,
                   f"{base}/out", f"{base}/checkpoint", "event_id", "json",
                   max_files_per_trigger=2, multiline=False, options=W.JSON_TIME_OPTIONS)
    return W.read_output(spark, f"{base}/out").drop("slice")


# ------------------------------------------------------------ tokenising ----
@query("mask_labels")
def mask_labels(spark, sf):
    """T12 + T13 over the flat chat texts: byte-level ids truncated to 2,048,
    labels masked up to the last assistant-template occurrence."""
    flat = chat_flat_text(spark, sf)
    tpl = CH.byte_tokenizer([CH.RESPONSE_TEMPLATE])[0]
    tok = CH.tokenize(flat, "text", response_template=tpl)
    lab = CH.with_response_mask(tok, "input_ids", tpl, "labels", until_col="mask_until")
    return lab.select("id", F.size("input_ids").alias("n_ids"),
                      (F.size("labels") - F.size(F.array_remove("labels", CH.IGNORE_INDEX))).alias("n_masked"),
                      F.size("labels").alias("n_labels"))


@query("narrative_qc")
def narrative_qc(spark, sf):
    """V8: narrative length, temporal markers and evidence presence."""
    return Q.narrative_qc(generated_cases(spark, sf))
