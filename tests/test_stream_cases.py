"""Incremental case build: batches add up to one batch build, and a crash between outputs shows nothing."""
import pytest
from pyspark.sql import functions as F

from vigil.operators import labels as L
from vigil.streaming import cases as SC

LOOKUP = "pt_key string, key_pos long, meddra_pt string, meddra_pt_code long, meddra_llt string, meddra_llt_code long, meddra_soc string, meddra_soc_code long"


@pytest.fixture(scope="module")
def refs(spark):
    terms = [("rash", 1, "Rash", 1, "Rash", 1, "skin", 9), ("nausea", 2, "Nausea", 2, "Nausea", 2, "gut", 8)]
    labels = [("A", "Nausea was seen. More.", "", "adverse_reactions", "brand"), ("B", "", "", None, None)]
    return SC.References(spark.createDataFrame(terms, LOOKUP),
                         spark.createDataFrame(labels, "drug_name string, label_text string, label_excerpt string, label_section string, label_key_type string"))


def raw(spark, rows):
    """(id, drug, reaction) as raw reports."""
    flat = spark.createDataFrame(rows, "i string, d string, r string")
    return flat.select(
        F.col("i").alias("safetyreportid"), F.lit("1").alias("serious"), *[F.lit(None).cast("string").alias(c) for c in (
            "seriousnessdeath", "seriousnesslifethreatening", "seriousnesshospitalization", "seriousnessdisabling", "seriousnesscongeni",
            "seriousnessother", "narrativeincludeclinical")],
        F.struct(F.lit("50").alias("patientonsetage"), F.lit("2").alias("patientsex"),
                 F.array(F.struct(F.col("r").alias("reactionmeddrapt"), F.lit("1").alias("reactionoutcome"))).alias("reaction"),
                 F.array(F.struct(F.col("d").alias("medicinalproduct"), *[F.lit("1").alias(c) for c in ("drugcharacterization", "drugadditional", "drugrecurrence")],
                                  F.lit("5 mg").alias("drugdosagetext"), F.lit("pain").alias("drugindication"))).alias("drug")).alias("patient"))


FIRST = [("1", "A", "Nausea"), ("2", "A", "Rash"), ("3", "B", "Rash"), ("4", "A", "zzzzqqq"), ("5", "", "Rash"), ("1", "A", "Nausea")]
SECOND = [("2", "A", "Rash"), ("6", "A", "Nausee"), ("4", "A", "Rash")]


def state(spark, out):
    cases = {r.id: (r.meddra_pt, r.labelling_status) for r in SC.committed(spark, out, "cases").collect()}
    rejects = {r.id: (r.step, r.reason) for r in SC.committed(spark, out, "rejects").collect()}
    return cases, rejects


def test_batches_and_crash(spark, refs, tmp_path):
    out = str(tmp_path / "out")
    assert SC.ledger(spark, out).count() == 0
    SC.commit_batch(raw(spark, FIRST), 0, out, "r", refs)
    cases, rejects = state(spark, out)
    assert cases == {"1": ("Nausea", "Expected"), "2": ("Rash", "Unexpected")}
    assert rejects == {"3": ("validate", "Invalid labelling_status: None"), "4": ("code", "no dictionary term"), "5": ("normalise", "blank_drug")}

    def crash():
        raise RuntimeError("lost driver")

    with pytest.raises(RuntimeError):
        SC.commit_batch(raw(spark, SECOND), 1, out, "r", refs, crash)
    assert state(spark, out) == (cases, rejects)  # written, but not committed
    SC.commit_batch(raw(spark, SECOND), 1, out, "r", refs)
    SC.commit_batch(raw(spark, SECOND), 1, out, "r", refs)  # a replay
    again, rejects2 = state(spark, out)
    assert again == cases | {"6": ("Nausea", "Unexpected")} and rejects2 == rejects  # 2 and 4 were taken before
    assert SC.committed(spark, out, "cases").count() == 3
    assert sorted((r.epoch, r.n_cases, r.n_rejects) for r in SC.ledger(spark, out).collect()) == [(0, 2, 3), (1, 1, 0)]


def test_assess_equals_the_row_form(spark):
    """Distinct pairs and n-grams give what a pattern for each report gives."""
    cache = spark.createDataFrame([("A", "Common: Head  pain,\nand rash! Head-pain (severe). St. John's reaction."), ("B", ""), ("C", "No events. Élan vital")],
                                  "drug_name string, label_text string")
    terms = ["head pain", "Head-pain", "RASH", "ras", "head", "John's reaction", "élan vital", "events", "pain, and rash", "---", "no"]
    rows = [(f"{d}{i}", d, t) for d in "ABCD" for i, t in enumerate(terms)] * 2
    reports = spark.createDataFrame(rows, "id string, drug_name string, reaction_pt string")
    cols = ["id", "labelling_status", "labelling_evidence", "needs_review"]
    got = sorted(map(tuple, L.assess(reports, cache).select(*cols).collect()), key=str)
    whole = reports.join(cache, "drug_name", "left").withColumn("label_text", F.coalesce("label_text", F.lit("")))
    assert got == sorted(map(tuple, L.expectedness(whole).select(*cols).collect()), key=str)
    assert L.assess(reports.limit(0), cache).count() == 0


def test_class_rule(spark):
    rows = [(f"a{i}", "A", "skin" if i < 3 else "gut") for i in range(10)] + [("b1", "B", "skin"), ("b2", "B", "skin"), ("c", "C", ""), ("d", "A", None)]
    df = spark.createDataFrame(rows, "id string, drug_name string, meddra_soc string") \
        .selectExpr("*", "cast(null as string) labelling_status", "'' labelling_evidence", "drug_name <> 'Z' needs_review")
    got = {r.id: r for r in L.class_rule(L.class_evidence(df), min_others=3, min_share_pct=30).collect()}
    assert (got["a0"].n_same, got["a0"].n_others, got["a0"].labelling_status) == (2, 9, "Unexpected")  # 2 of 9 others
    assert (got["a9"].n_same, got["a9"].labelling_status) == (6, "Expected") and got["a9"].labelling_evidence == "6 of 9 other reports of A concern gut."
    assert got["b1"].labelling_status is None and got["b1"].needs_review  # one other report
    assert got["c"].needs_review and got["d"].needs_review and len(got) == len(rows)


def test_acceptance(spark):
    rows = [("1", '{"labelling_status": "Expected", "labelling_evidence": "x"}'), ("2", '```json\n{"labelling_status": "Maybe"}\n```'),
            ("3", "no json"), ("4", None), ("5", 'So: {"labelling_status": "Unexpected", "labelling_evidence": null} .')]
    got = {r.id: (r.parse_ok, r.labelling_status, r.reject_reason) for r in L.accepted(spark.createDataFrame(rows, "id string, raw_output string")).collect()}
    assert got == {"1": (True, "Expected", None), "2": (True, "Maybe", "bad_status"), "3": (False, None, "unparsed"), "4": (False, None, "unparsed"),
                   "5": (True, "Unexpected", None)}
