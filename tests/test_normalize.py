"""Report normalisation (FIXTURES F1-F3)."""
import itertools

from pyspark.sql import Row
from pyspark.sql import functions as F

from vigil.operators import normalize as N
from vigil.schemas import RAW_REPORT


def rep(rid, reactions=None, drugs=None, serious="1", flags=(), narrative=None, age="40", sex="1", missing=False):
    f = {k: ("1" if k in flags else None) for k, _ in N.CRITERIA_FLAGS}
    patient = Row(patientonsetage=age, patientsex=sex, reaction=None if missing else reactions, drug=drugs)
    return Row(safetyreportid=rid, serious=serious, **f, narrativeincludeclinical=narrative, patient=patient)


def rx(pt, outcome="1"):
    return Row(reactionmeddrapt=pt, reactionoutcome=outcome)


def dr(name, char="1", add="", rec="", dose="5 mg", ind="pain"):
    return Row(medicinalproduct=name, drugcharacterization=char, drugadditional=add, drugrecurrence=rec,
               drugdosagetext=dose, drugindication=ind)


def fixture_rows():
    return [
        rep("R1", [rx("Nausea")], [dr("Other", "2"), dr("Suspect", "1")]),
        rep("R2", [rx("Headache")], [dr("First", "3"), dr("Second", "2")]),
        rep("R3a", [], [dr("X")]), rep("R3b", None, [dr("X")]), rep("R3c", [rx("x")], [dr("X")], missing=True),
        rep("R4", [rx("Rash")], []),
        rep("R5", [rx(" \t ")], [dr("X")]),
        rep("R6", [rx("Rash")], [dr("", "1"), dr("Named", "2")]),
        rep("R7", [rx("Rash")], [dr("X")], serious=None, flags=("seriousnessdeath",)),
        rep("R8", [rx("Rash")], [dr("X")], flags=tuple(k for k, _ in N.CRITERIA_FLAGS)),
        rep("R9", [rx("Rash", "9")], [dr("X")], sex="0"),
        rep("R10", [rx("Rash")], [dr("X")]), rep("R10", [rx("Rash")], [dr("X")]),
        rep("R11", [rx(" Fatigue ")], [dr(" Drug ")], narrative="  text  "),
    ]


def test_fixture_reports(spark):
    raw = spark.createDataFrame(fixture_rows(), RAW_REPORT)
    clean = {r.id: r for r in N.normalize_reports(raw).collect()}
    rej = {r.id: r.reject_reason for r in N.report_rejects(raw).collect()}
    assert clean["R1"].drug_name == "Suspect" and clean["R1"].concomitant_drugs == 1
    assert clean["R2"].drug_name == "First" and clean["R2"].concomitant_drugs == 1
    assert rej["R3a"] == rej["R3b"] == rej["R3c"] == "no_reaction"
    assert rej["R4"] == "no_drug" and rej["R5"] == "blank_pt" and rej["R6"] == "blank_drug"
    assert clean["R7"].serious is False and clean["R7"].seriousness_criteria == ["Death"]
    assert clean["R8"].seriousness_criteria == [lbl for _, lbl in N.CRITERIA_FLAGS]
    assert clean["R9"].reaction_outcome == "Unknown" and clean["R9"].patient_sex == "unknown"
    assert sum(1 for r in N.normalize_reports(raw).collect() if r.id == "R10") == 1
    assert clean["R11"].reaction_pt == "Fatigue" and clean["R11"].drug_name == "Drug"
    assert clean["R11"].narrative == "text" and clean["R11"].has_narrative
    assert set(N.CLEAN_COLUMNS) == set(N.normalize_reports(raw).columns)


def test_relational_twin_matches_nested(spark):
    raw = spark.createDataFrame(fixture_rows(), RAW_REPORT)
    nested = N.normalize_reports(raw, dedup=True)
    # explode the same reports into flat child tables
    h = raw.dropDuplicates(["safetyreportid"]).select(
        F.col("safetyreportid").alias("report_key"), "*", "patient.patientonsetage", "patient.patientsex")
    rxs = raw.dropDuplicates(["safetyreportid"]).select(
        F.col("safetyreportid").alias("report_key"), F.posexplode("patient.reaction").alias("pos", "r")
    ).select("report_key", "pos", "r.*")
    drs = raw.dropDuplicates(["safetyreportid"]).select(
        F.col("safetyreportid").alias("report_key"), F.posexplode("patient.drug").alias("pos", "d")
    ).select("report_key", "pos", "d.*")
    rel = N.normalize_relational(h.drop("patient"), rxs, drs)
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*N.CLEAN_COLUMNS).collect())
    assert key(rel) == key(nested)


TRUTH = [
    ("Fatal", True, "1", "1", "Certain"),
    ("Recovered/Resolved", False, "2", "", "Probable/Likely"),
    ("Recovering/Resolving", True, "3", "2", "Probable/Likely"),
    ("Recovered/Resolved", False, "3", "1", "Possible"),
    ("Fatal", True, "1", "2", "Possible"),
    ("Not Recovered", True, "1", "2", "Unlikely"),
    ("Unknown", True, "", "", "Unassessable"),
]


def _py_who_umc(o, s, a, r):
    rech, dech = r == "1", a in ("1", "2")
    res = o in ("Recovered/Resolved", "Recovering/Resolving")
    if rech and dech:
        return "Certain"
    if dech and res or res and s:
        return "Probable/Likely"
    if res or o == "Fatal":
        return "Possible"
    return "Unlikely" if o == "Not Recovered" else "Unassessable"


def test_causality_truth_table_and_grid(spark):
    outcomes = ["Recovered/Resolved", "Recovering/Resolving", "Not Recovered", "Fatal", "Unknown"]
    grid = list(itertools.product(outcomes, [True, False], ["1", "2", "3", "4", ""], ["1", "2", ""]))
    assert len(grid) == 150
    rows = [(o, s, a, r, e) for o, s, a, r, e in TRUTH] + [(o, s, a, r, _py_who_umc(o, s, a, r)) for o, s, a, r in grid]
    df = spark.createDataFrame(rows, "outcome string, serious boolean, da string, dr string, expected string")
    got = df.select("expected", N.who_umc("outcome", "serious", "da", "dr").alias("got")).collect()
    assert all(r.expected == r.got for r in got)
    cats = {r.got for r in got}
    assert len(cats) == 5 and "Conditional/Unclassified" not in cats


def test_backfill_old_layout(spark):
    raw = spark.createDataFrame(fixture_rows(), RAW_REPORT)
    clean = N.normalize_reports(raw)
    old = clean.drop("drug_additional", "drug_recurrence", "concomitant_drugs", "who_umc_preliminary")
    out = N.union_layouts(old, clean.limit(0))
    r = out.where("id = 'R1'").first()
    assert r.drug_additional == "" and r.concomitant_drugs == 0 and r.who_umc_preliminary == "Probable/Likely"
