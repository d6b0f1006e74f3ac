"""Report normalisation: nested raw reports -> one flat clean row per report.

All steps are native expressions over the two nested arrays (higher-order
``filter`` / ``get``), so the whole projection is one narrow stage that
stays inside whole-stage codegen; the only shuffle is the optional id
de-duplication.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_empty, code_map, utrim

# ---- fixed values (must equal the reference's for identical results) --------
# Seriousness flags and their labels, in this order.
CRITERIA_FLAGS = [
    ("seriousnessdeath", "Death"),
    ("seriousnesslifethreatening", "Life-threatening"),
    ("seriousnesshospitalization", "Hospitalization"),
    ("seriousnessdisabling", "Disability/Incapacity"),
    ("seriousnesscongeni", "Congenital Anomaly"),
    ("seriousnessother", "Medically Significant"),
]
# Reaction outcome codes as the reference decodes them (default "Unknown").
OUTCOME_PARITY = {"1": "Recovered/Resolved", "2": "Recovering/Resolving",
                  "3": "Not Recovered", "4": "Fatal", "5": "Unknown", "6": "Unknown"}
# Public code list for the same field (4 = resolved with sequelae, 5 = fatal);
# offered as a parameter, not the default.
OUTCOME_CORRECTED = {"1": "Recovered/Resolved", "2": "Recovering/Resolving",
                     "3": "Not Recovered", "4": "Recovered/Resolved", "5": "Fatal", "6": "Unknown"}
SEX_CODES = {"1": "male", "2": "female"}          # default "unknown"
CAUSALITY_CATEGORIES = ["Certain", "Probable/Likely", "Possible", "Unlikely",
                        "Conditional/Unclassified", "Unassessable"]
# -----------------------------------------------------------------------------

CLEAN_COLUMNS = ["id", "drug_name", "drug_dose", "drug_indication", "reaction_pt",
                 "reaction_outcome", "serious", "seriousness_criteria", "patient_age",
                 "patient_sex", "narrative", "has_narrative", "drug_additional",
                 "drug_recurrence", "concomitant_drugs", "who_umc_preliminary"]


def who_umc(outcome, serious, drug_additional, drug_recurrence) -> Column:
    """Ordered causality rules (first match wins).  Five categories are
    reachable; Conditional/Unclassified is valid but never produced."""
    o, s = F.col(outcome) if isinstance(outcome, str) else outcome, \
        F.col(serious) if isinstance(serious, str) else serious
    da = blank_to_empty(drug_additional)
    dr = blank_to_empty(drug_recurrence)
    rechallenge = dr == "1"
    dechallenge = da.isin("1", "2")
    resolved = o.isin("Recovered/Resolved", "Recovering/Resolving")
    s = F.coalesce(s, F.lit(False))
    return (F.when(rechallenge & dechallenge, "Certain")
            .when(dechallenge & resolved, "Probable/Likely")
            .when(resolved & s, "Probable/Likely")
            .when(resolved, "Possible")
            .when(o == "Fatal", "Possible")
            .when(o == "Not Recovered", "Unlikely")
            .otherwise("Unassessable"))


def _staged(raw: DataFrame) -> DataFrame:
    """Pick first reaction and suspect drug once; everything else reads them."""
    reactions = F.coalesce(F.col("patient.reaction"), F.array())
    drugs = F.coalesce(F.col("patient.drug"), F.array())
    suspect = F.coalesce(
        F.get(F.filter(drugs, lambda d: d["drugcharacterization"] == "1"), 0),
        F.get(drugs, 0))
    return raw.select(
        "*",
        F.size(reactions).alias("_n_reactions"),
        F.size(drugs).alias("_n_drugs"),
        F.get(reactions, 0).alias("_reaction"),
        suspect.alias("_suspect"),
        F.size(F.filter(drugs, lambda d: d["drugcharacterization"] == "2")).alias("_n_concomitant"),
    ).select(
        "*",
        utrim(blank_to_empty("_reaction.reactionmeddrapt")).alias("_pt"),
        utrim(blank_to_empty("_suspect.medicinalproduct")).alias("_drug"),
    )


def reject_reason() -> Column:
    """Required-field rules in the reference's order; null = kept."""
    return (F.when(F.col("_n_reactions") == 0, "no_reaction")
            .when(F.col("_n_drugs") == 0, "no_drug")
            .when(F.col("_pt") == "", "blank_pt")
            .when(F.col("_drug") == "", "blank_drug"))


def _project(st: DataFrame, outcome_map: dict) -> DataFrame:
    serious = F.coalesce(F.col("serious"), F.lit("2")) == "1"
    criteria = F.array_compact(F.array(*[
        F.when(F.col(flag) == "1", F.lit(label)) for flag, label in CRITERIA_FLAGS]))
    outcome = code_map(F.col("_reaction.reactionoutcome"), outcome_map, "Unknown")
    narrative = utrim(blank_to_empty("narrativeincludeclinical"))
    return st.select(
        blank_to_empty("safetyreportid").alias("id"),
        F.col("_drug").alias("drug_name"),
        blank_to_empty("_suspect.drugdosagetext").alias("drug_dose"),
        blank_to_empty("_suspect.drugindication").alias("drug_indication"),
        F.col("_pt").alias("reaction_pt"),
        outcome.alias("reaction_outcome"),
        serious.alias("serious"),
        criteria.alias("seriousness_criteria"),
        blank_to_empty("patient.patientonsetage").alias("patient_age"),
        code_map(F.col("patient.patientsex"), SEX_CODES, "unknown").alias("patient_sex"),
        narrative.alias("narrative"),
        (narrative != "").alias("has_narrative"),
        blank_to_empty("_suspect.drugadditional").alias("drug_additional"),
        blank_to_empty("_suspect.drugrecurrence").alias("drug_recurrence"),
        F.col("_n_concomitant").cast("int").alias("concomitant_drugs"),
    ).withColumn("who_umc_preliminary",
                 who_umc("reaction_outcome", "serious", "drug_additional", "drug_recurrence"))


def normalize_reports(raw: DataFrame, outcome_map: dict = OUTCOME_PARITY,
                      dedup: bool = True) -> DataFrame:
    """Keep reports passing the required-field rules and project the
    16 clean columns.  ``dedup`` keeps one row per report id (re-read pages
    deliver the same report twice; the reference never de-duplicates)."""
    st = _staged(raw)
    clean = _project(st.where(reject_reason().isNull()), outcome_map)
    return clean.dropDuplicates(["id"]) if dedup else clean


def report_rejects(raw: DataFrame) -> DataFrame:
    """Rows dropped by P1 with the rule that dropped them."""
    st = _staged(raw)
    return (st.select(blank_to_empty("safetyreportid").alias("id"),
                      reject_reason().alias("reject_reason"))
            .where(F.col("reject_reason").isNotNull()))


def backfill_clean(df: DataFrame) -> DataFrame:
    """Bring rows of the old 12-column layout up to the 16-column one.
    Missing causality inputs default to '' / 0 and the category is
    recomputed per row (the reference only tests row 0)."""
    for name, default in (("drug_additional", F.lit("")), ("drug_recurrence", F.lit("")),
                          ("concomitant_drugs", F.lit(0)),
                          ("who_umc_preliminary", F.lit(None).cast("string"))):
        if name not in df.columns:
            df = df.withColumn(name, default)
    out = (df.withColumn("drug_additional", blank_to_empty("drug_additional"))
             .withColumn("drug_recurrence", blank_to_empty("drug_recurrence"))
             .withColumn("concomitant_drugs", F.coalesce(F.col("concomitant_drugs").cast("int"), F.lit(0)))
             .withColumn("who_umc_preliminary",
                         who_umc(F.coalesce(F.col("reaction_outcome"), F.lit("Unknown")),
                                 F.coalesce(F.col("serious"), F.lit(False)),
                                 "drug_additional", "drug_recurrence")))
    return out.select(*CLEAN_COLUMNS)


def union_layouts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old- and new-layout rows in one table, then back-filled."""
    return backfill_clean(new.unionByName(old, allowMissingColumns=True))


# ---- relational twin: flat child tables instead of nested arrays -----------
REACTION_FIELDS = ["reactionmeddrapt", "reactionoutcome"]
DRUG_FIELDS = ["medicinalproduct", "drugcharacterization", "drugadditional",
               "drugrecurrence", "drugdosagetext", "drugindication"]


def stage_relational(headers: DataFrame, reactions: DataFrame, drugs: DataFrame,
                     key: str = "report_key") -> DataFrame:
    """First reaction and suspect drug per report from flat child tables.

    ``min_by`` is partially aggregated map-side, so each shuffle carries at
    most one row per (task, report): a report with millions of lines costs
    no more shuffle than a report with one.  ``pos`` orders entries within a
    report (the array position of the nested form)."""
    r_aggs = [F.count(F.lit(1)).alias("_n_reactions"),
              F.min_by(F.struct(*REACTION_FIELDS), F.col("pos")).alias("_reaction")]
    # suspect = first drug with characterization '1', else the first drug
    not_suspect = F.coalesce(F.col("drugcharacterization"), F.lit("")) != "1"
    d_aggs = [F.count(F.lit(1)).alias("_n_drugs"),
              F.min_by(F.struct(*DRUG_FIELDS),
                       F.struct(not_suspect.alias("ns"), F.col("pos").alias("p"))).alias("_suspect"),
              F.count_if(F.col("drugcharacterization") == "2").alias("_n_concomitant")]
    if drugs is reactions:
        # one source table carries both entries: one scan, one shuffle
        st = headers.join(reactions.groupBy(key).agg(*r_aggs, *d_aggs), key, "left")
    else:
        st = (headers.join(reactions.groupBy(key).agg(*r_aggs), key, "left")
                     .join(drugs.groupBy(key).agg(*d_aggs), key, "left"))
    st = (st.withColumn("_n_reactions", F.coalesce("_n_reactions", F.lit(0)))
            .withColumn("_n_drugs", F.coalesce("_n_drugs", F.lit(0)))
            .withColumn("_n_concomitant", F.coalesce("_n_concomitant", F.lit(0)))
            .withColumn("patient", F.struct(F.col("patientonsetage"), F.col("patientsex"))))
    return st.select("*",
                     utrim(blank_to_empty("_reaction.reactionmeddrapt")).alias("_pt"),
                     utrim(blank_to_empty("_suspect.medicinalproduct")).alias("_drug"))


def normalize_relational(headers: DataFrame, reactions: DataFrame, drugs: DataFrame,
                         outcome_map: dict = OUTCOME_PARITY, key: str = "report_key",
                         dedup: bool = False) -> DataFrame:
    """P1-P13 over flat tables; same output as ``normalize_reports``.
    Report ids are unique per header row here, so no de-duplication shuffle
    unless asked for."""
    st = stage_relational(headers, reactions, drugs, key)
    clean = _project(st.where(reject_reason().isNull()), outcome_map)
    return clean.dropDuplicates(["id"]) if dedup else clean


def rejects_relational(headers: DataFrame, reactions: DataFrame, drugs: DataFrame,
                       key: str = "report_key") -> DataFrame:
    st = stage_relational(headers, reactions, drugs, key)
    return (st.select(blank_to_empty("safetyreportid").alias("id"), reject_reason().alias("reject_reason"))
            .where(F.col("reject_reason").isNotNull()))
