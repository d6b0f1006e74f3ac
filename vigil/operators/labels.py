"""Product labels: label-text cascade per drug, label join, expectedness.

The reference searches a label service three ways per drug; here the label
documents are a table (one row per document and search key) and the
cascade is a join plus two partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import field, with_json_tiers
from ..session import staged
from .joins import checked_broadcast, salted_join

# ---- fixed values ------------------------------------------------------------
SEARCH_ORDER = {"brand": 0, "generic": 1, "substance": 2}   # tried in this order
ADR_CHARS = 2500          # adverse-reactions excerpt length
WARN_CHARS = 1500         # warnings excerpt length
LABEL_SOURCE_LABEL = "fda_label"
LABEL_SOURCE_NONE = "llm_knowledge"
# -------------------------------------------------------------------------------


def _first_doc_per_key(labels: DataFrame) -> DataFrame:
    """Only the first document of a search is considered (``limit 1``)."""
    doc = F.struct("adverse_reactions", "warnings_and_cautions", "warnings")
    return labels.groupBy("key_type", "key").agg(F.min_by(doc, "pos").alias("doc"))


def _section() -> tuple[Column, Column, Column]:
    """The whole section text, its excerpt for prompts, and which section it is."""
    adr = F.col("doc.adverse_reactions")
    # `warnings` is read only when `warnings_and_cautions` is absent (null)
    warn = F.coalesce(F.col("doc.warnings_and_cautions"), F.col("doc.warnings"))
    adr_n = F.coalesce(F.size(adr), F.lit(0))
    warn_n = F.coalesce(F.size(warn), F.lit(0))
    text = F.when(adr_n > 0, F.get(adr, 0)).when(warn_n > 0, F.get(warn, 0))
    excerpt = F.when(adr_n > 0, F.substring(F.get(adr, 0), 1, ADR_CHARS)).when(warn_n > 0, F.substring(F.get(warn, 0), 1, WARN_CHARS))
    section = F.when(adr_n > 0, "adverse_reactions").when(warn_n > 0, "warnings")
    return text, excerpt, section


def label_cascade(drugs: DataFrame, labels: DataFrame, drug_col: str = "drug_name") -> DataFrame:
    """J6 + J7: one row per distinct drug with the label text of the first
    search (brand, generic, substance) whose first document has adverse
    reactions or warnings; '' when none does.  ``label_text`` is the whole
    section; ``label_excerpt`` is its beginning, for prompts only."""
    d = drugs.select(F.col(drug_col).alias("drug_name")).distinct()
    first = _first_doc_per_key(labels.where(F.col("key_type").isin(*SEARCH_ORDER)))
    text, excerpt, section = _section()
    prio = F.coalesce(*[F.when(F.col("key_type") == k, F.lit(v)) for k, v in SEARCH_ORDER.items()])
    hits = (first.select(F.col("key").alias("drug_name"), prio.alias("prio"),
                         text.alias("label_text"), excerpt.alias("label_excerpt"), section.alias("label_section"), "key_type")
            .where(F.col("label_text").isNotNull()))
    best = hits.groupBy("drug_name").agg(
        F.min_by(F.struct("label_text", "label_excerpt", "label_section", "key_type"), "prio").alias("b"))
    return (d.join(best, "drug_name", "left")
             .select("drug_name",
                     F.coalesce(F.col("b.label_text"), F.lit("")).alias("label_text"),
                     F.coalesce(F.col("b.label_excerpt"), F.lit("")).alias("label_excerpt"),
                     F.col("b.label_section").alias("label_section"),
                     F.col("b.key_type").alias("label_key_type")))


def join_labels(reports: DataFrame, label_cache: DataFrame, drug_col: str = "drug_name") -> DataFrame:
    """J5 + L1: exact drug-name key (no case folding); '' on a miss.  The
    cache has one row per distinct drug; it is broadcast when its measured
    size allows, so a drug named in a third of all reports is no hot key."""
    lc = checked_broadcast(label_cache.select(F.col("drug_name").alias(drug_col), "label_text", "label_excerpt"))
    j = reports.join(lc, drug_col, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("label_text", "label_excerpt")})
    return j.withColumn("label_source", F.when(F.col("label_text") != "", LABEL_SOURCE_LABEL)
                        .otherwise(LABEL_SOURCE_NONE))


def sentences(c) -> Column:
    """Split text after '.', '!' or '?' followed by whitespace; line breaks inside a sentence are blanks."""
    return F.split(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"([.!?]) ", "$1\n"), "\n")


def mention_pattern(term: Column) -> Column:
    """Regex: the lower-cased term as a whole phrase (not inside a longer word, in any script)."""
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return F.concat(F.lit(rf"(^|{edge})\Q"), F.lower(term), F.lit(rf"\E($|{edge})"))


def expectedness(df: DataFrame, pt_col: str = "reaction_pt", label_col: str = "label_text") -> DataFrame:
    """L2 + L3: Expected when the label text mentions the term as a whole
    phrase (case-insensitive); evidence = the first sentence that mentions it.  Without
    label text there is no evidence: status null and ``needs_review`` set
    (never a silent "Unexpected")."""
    pattern = mention_pattern(F.col(pt_col))
    label = F.col(label_col)
    has_label = F.coalesce(label, F.lit("")) != ""
    found = has_label & F.regexp_like(F.lower(F.regexp_replace(label, r"\s+", " ")), pattern)
    evidence_sentence = F.get(F.filter(sentences(label), lambda s: F.regexp_like(F.lower(s), pattern)), 0)
    status = F.when(found, "Expected").when(has_label, "Unexpected")
    evidence = (F.when(found, evidence_sentence)
                .when(has_label, F.concat(F.lit("'"), F.col(pt_col),
                                          F.lit("' is not mentioned in the label text.")))
                .otherwise(F.lit("")))
    return (df.withColumn("labelling_status", status)
              .withColumn("labelling_evidence", evidence)
              .withColumn("needs_review", ~has_label))


def assess(reports: DataFrame, label_cache: DataFrame, key: str = "id", drug_col: str = "drug_name", pt_col: str = "reaction_pt") -> DataFrame:
    """``expectedness`` and L1 for any number of reports: each different (drug, term) is decided once.

    The terms' words are equi-joined with the labels' n-grams; only pairs that meet there are compared by
    the phrase as written.  The reports get the verdict by a salted join, so a drug or term in a third of them is no hot key."""
    from .mentions import mention_table, phrase

    texts = label_cache.where(F.col("label_text") != "").select(F.col("drug_name").alias(drug_col), "label_text")
    flags = texts.select(drug_col, F.lit(True).alias("has_label"))
    pairs = staged(reports.select(drug_col, F.lower(pt_col).alias("_term")).distinct().join(flags, drug_col), "pairs")
    wanted = pairs.select(phrase(F.col("_term")).alias("phrase"), F.col("_term")).distinct()
    near = mention_table(texts, wanted, drug_col).select(drug_col, "_term").join(pairs, [drug_col, "_term"], "left_semi")
    told = expectedness(near.join(texts, drug_col), "_term").where(F.col("labelling_status") == "Expected")
    verdict = pairs.join(told.select(drug_col, "_term", F.col("labelling_evidence").alias("_evidence"), F.lit(True).alias("_found")),
                         [drug_col, "_term"], "left")
    out = salted_join(reports.withColumn("_term", F.lower(pt_col)), staged(verdict, "verdicts"), [drug_col, "_term"], key)
    has, found = F.coalesce("has_label", F.lit(False)), F.coalesce("_found", F.lit(False))
    missing = F.concat(F.lit("'"), F.col(pt_col), F.lit("' is not mentioned in the label text."))
    return out.withColumns({
        "label_source": F.when(has, LABEL_SOURCE_LABEL).otherwise(LABEL_SOURCE_NONE),
        "labelling_status": F.when(found, "Expected").when(has, "Unexpected"),
        "labelling_evidence": F.when(found, F.col("_evidence")).when(has, missing).otherwise(F.lit("")),
        "needs_review": ~has}).drop("_term", "has_label", "_evidence", "_found")


def related_status(coded: DataFrame, labels: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """L2 with related terms over coded reports: ``found`` are ``mentions.related_findings`` of ``labels`` (drug_name, label_text)."""
    flags = labels.where(F.coalesce("label_text", F.lit("")) != "").select("drug_name", F.lit(True).alias("_label"))
    flags = staged(flags, "flags")
    hits = found.select("drug_name", F.col("pt_code").alias("meddra_pt_code"), F.col("kind").alias("_kind"), F.col("phrase").alias("matched_phrase"),
                        F.col("evidence").alias("_evidence"))
    out = salted_join(salted_join(coded, flags, ["drug_name"], key), staged(hits, "hits"), ["drug_name", "meddra_pt_code"], key)
    hit, has = F.col("matched_phrase").isNotNull(), F.coalesce("_label", F.lit(False))
    missing = F.concat(F.lit("'"), F.col("reaction_pt"), F.lit("' is not mentioned in the label text."))
    return out.withColumns({
        "labelling_status": F.when(hit, "Expected").when(has, "Unexpected"),
        "match_kind": F.when(hit, F.when(F.col("_kind") == "pt", "direct").otherwise("related")),
        "labelling_evidence": F.when(hit, F.col("_evidence")).when(has, missing).otherwise(F.lit("")),
        "needs_review": ~hit & ~has}).drop("_label", "_kind", "_evidence")


MIN_OTHERS = 3       # other reports of the drug that class evidence needs
MIN_SHARE_PCT = 20   # share of them in the organ class that makes a reaction expected


def class_evidence(coded: DataFrame, key: str = "id", drug_col: str = "drug_name", soc_col: str = "meddra_soc") -> DataFrame:
    """Adds ``n_others``, the drug's other reports, and ``n_same``, those of them in the report's organ class.

    Counts are partial aggregates; the reports get theirs by a salted join.  Without a class or drug both are null."""
    known = coded.where((F.coalesce(soc_col, F.lit("")) != "") & F.col(drug_col).isNotNull())
    by_class = known.groupBy(drug_col, soc_col).agg(F.count(F.lit(1)).alias("n_class"))
    by_drug = by_class.groupBy(drug_col).agg(F.sum("n_class").alias("n_drug"))
    both = staged(by_class.join(by_drug, drug_col), "class-counts")
    out = salted_join(coded, both, [drug_col, soc_col], key)
    return out.withColumns({"n_same": F.col("n_class") - 1, "n_others": F.col("n_drug") - 1}).drop("n_class", "n_drug")


def class_rule(assessed: DataFrame, min_others: int = MIN_OTHERS, min_share_pct: int = MIN_SHARE_PCT, drug_col: str = "drug_name",
               soc_col: str = "meddra_soc") -> DataFrame:
    """L3: where a drug has no label text, the organ class decides, the report itself left out: expected if
    ``min_share_pct`` % or more of the drug's other reports are in the class.  With fewer than ``min_others`` of them
    the status stays null and ``needs_review`` set.  Rows come from ``class_evidence``."""
    enough = F.col("needs_review") & (F.coalesce("n_others", F.lit(0)) >= min_others)
    often = F.col("n_same") * 100 >= F.col("n_others") * min_share_pct
    told = F.concat(F.col("n_same").cast("string"), F.lit(" of "), F.col("n_others").cast("string"), F.lit(" other reports of "), F.col(drug_col),
                    F.lit(" concern "), F.col(soc_col), F.lit("."))
    return assessed.withColumns({
        "labelling_status": F.when(enough, F.when(often, "Expected").otherwise("Unexpected")).otherwise(F.col("labelling_status")),
        "labelling_evidence": F.when(enough, told).otherwise(F.col("labelling_evidence")),
        "needs_review": F.col("needs_review") & ~enough})


def accepted(answers: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """L4 over raw labelling answers: adds ``parse_ok``, ``labelling_status`` and ``labelling_evidence`` as answered, and ``reject_reason``:
    ``unparsed`` (no JSON object in the answer), ``bad_status`` (status not in the domain), null = accepted."""
    out = with_json_tiers(answers, raw_col, "_answer")
    v = F.col("_answer")
    out = out.withColumns({"parse_ok": v.isNotNull(), "labelling_status": field(v, "labelling_status"), "labelling_evidence": field(v, "labelling_evidence")})
    domain = F.coalesce(F.col("labelling_status").isin("Expected", "Unexpected"), F.lit(False))
    return out.withColumn("reject_reason", F.when(~F.col("parse_ok"), "unparsed").when(~domain, "bad_status")).drop("_answer")


def coverage(label_cache: DataFrame, labelled_reports: DataFrame) -> DataFrame:
    """Drugs with label text / all drugs; share of reports with text."""
    d = label_cache.agg(F.count(F.lit(1)).alias("n_drugs"),
                        F.count_if(F.col("label_text") != "").alias("n_drugs_with_text"))
    r = labelled_reports.agg(F.avg((F.col("label_source") == LABEL_SOURCE_LABEL).cast("int"))
                             .alias("share_reports_with_text"))
    return d.select("n_drugs", "n_drugs_with_text",
                    (F.col("n_drugs_with_text").cast("double") / F.col("n_drugs").cast("double"))
                    .alias("share_drugs_with_text"),
                    r.select("share_reports_with_text").scalar().alias("share_reports_with_text"))
