"""Labels (F6), case build and validation."""
from pyspark.sql import functions as F

from vigil.operators import casebuild as CB
from vigil.operators import labels as L
from vigil.operators import quality as Q

LBL = "key_type string, key string, adverse_reactions array<string>, warnings_and_cautions array<string>, warnings array<string>, pos long"


def test_label_cascade(spark):
    rows = [
        ("brand", "A", ["x" * 3000], None, None, 1),
        ("brand", "B", [], ["warn B"], None, 2), ("generic", "B", ["adr B"], None, None, 3),
        ("brand", "C", [], [], None, 4), ("generic", "C", ["adr C"], None, None, 5),
        ("brand", "D", [], [], ["old warnings"], 6), ("generic", "D", ["adr D"], None, None, 7),
        ("brand", "F", ["first"], None, None, 8), ("brand", "F", ["second"], None, None, 9),
        ("brand", "G", None, None, ["w" * 2000], 10),
    ]
    labels = spark.createDataFrame(rows, LBL)
    drugs = spark.createDataFrame([(d,) for d in "ABCDEFG"], "drug_name string")
    got = {r.drug_name: r for r in L.label_cascade(drugs, labels).collect()}
    assert len(got["A"].label_text) == 3000 and len(got["A"].label_excerpt) == 2500
    assert got["B"].label_text == "warn B" and got["B"].label_key_type == "brand"
    assert got["C"].label_text == "adr C"
    assert got["D"].label_text == "adr D"     # warnings_and_cautions present but empty: next search
    assert got["E"].label_text == "" and got["E"].label_section is None
    assert got["F"].label_text == "first"
    assert len(got["G"].label_text) == 2000 and len(got["G"].label_excerpt) == 1500
    rep = spark.createDataFrame([("1", "A", "pain"), ("2", "E", "rash")], "id string, drug_name string, reaction_pt string")
    j = {r.id: r for r in L.join_labels(rep, L.label_cascade(drugs, labels)).collect()}
    assert j["1"].label_source == "fda_label" and j["2"].label_source == "llm_knowledge"


def test_expectedness(spark):
    df = spark.createDataFrame([
        ("1", "Nausea", "Common: headache. Nausea was reported often! Other."),
        ("2", "old gear", "Reports of cold gear were seen."),
        ("3", "Rash", ""),
    ], "id string, reaction_pt string, label_text string")
    got = {r.id: r for r in L.expectedness(df).collect()}
    assert got["1"].labelling_status == "Expected" and got["1"].labelling_evidence == "Nausea was reported often!"
    assert got["2"].labelling_status == "Unexpected"          # whole phrase only
    assert got["3"].labelling_status is None and got["3"].needs_review


def test_formatting_and_action(spark):
    df = spark.createDataFrame([
        ("1", "", "", "", "male", "4", True),
        ("2", "5 mg", "pain", "40", "female", "1", False),
        ("3", "", "", "", "unknown", "", False),
    ], "id string, drug_dose string, drug_indication string, patient_age string, patient_sex string, drug_additional string, serious boolean")
    got = {r.id: r for r in CB.prompt_fields(df).collect()}
    assert got["1"].dose_info == "" and got["1"].age_sex == "male" and got["1"].indication == "unknown indication"
    assert got["1"].action_taken == "Not reported" and got["3"].action_taken == "Not reported"
    assert got["2"].dose_info == " 5 mg" and got["2"].age_sex == "40-year-old female"
    assert got["2"].action_taken == "The drug was discontinued." and got["2"].seriousness == "Non-serious"


def test_prompt_render_matches_str_format(spark):
    df = spark.createDataFrame([("D", " 5 mg", "Rash", "pain", "40-year-old male", "Fatal", "Serious", "Not reported")],
                               "drug_name string, dose_info string, reaction_pt string, indication string, age_sex string, reaction_outcome string, seriousness string, action_taken string")
    got = df.select(CB.narrative_prompt(df).alias("p")).first().p
    want = CB.NARRATIVE_PROMPT.format(example=CB.NARRATIVE_EXAMPLE, drug_name="D", dose_info=" 5 mg", reaction_pt="Rash",
                                      indication="pain", age_sex="40-year-old male", outcome="Fatal", serious="Serious",
                                      action_taken="Not reported")
    assert got == want


def test_strip_echo_and_short_gate(spark):
    df = spark.createDataFrame([("narrative:  Text here ",), ("Plain",)], "t string")
    from vigil.functions.text import strip_echo
    assert [r.s for r in df.select(strip_echo("t").alias("s")).collect()] == ["Text here", "Plain"]
    g = spark.createDataFrame([("   ",), ("short",), ("x" * 60,)], "t string").select(CB.short_input_gate("t").alias("r"))
    assert [r.r for r in g.collect()] == ["Please enter a clinical narrative.", CB.SHORT_NARRATIVE, None]


def test_validation_first_rule_wins(spark):
    base = dict(meddra_pt="Rash", seriousness="Serious", who_umc_category="Possible", labelling_status="Expected")
    rows = [dict(base, id="99", narrative="x" * 99), dict(base, id="100", narrative="x" * 100),
            dict(base, id="pt", narrative="x" * 120, meddra_pt=""),
            dict(base, id="case", narrative="x" * 120, seriousness="serious"),
            dict(base, id="cond", narrative="x" * 120, who_umc_category="Conditional/Unclassified"),
            dict(base, id="lab", narrative="x" * 120, labelling_status=None),
            dict(base, id="two", narrative="x" * 10, meddra_pt="")]
    df = spark.createDataFrame(rows, "id string, narrative string, meddra_pt string, seriousness string, who_umc_category string, labelling_status string")
    got = {r.id: r.reject_reason for r in Q.validate(df).collect()}
    assert got["99"] == "Narrative too short (99 chars)" and got["100"] is None
    assert got["pt"] == "Missing meddra_pt" and got["case"] == "Invalid seriousness: serious"
    assert got["cond"] is None and got["lab"] == "Invalid labelling_status: None"
    assert got["two"] == "Narrative too short (10 chars)"


def test_generator_isolates_failures(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string").repartition(2)

    def flaky(prompts, max_tokens, temperature):
        if (prompts == "b").any():
            raise RuntimeError("server down")
        return prompts.str.upper()

    out = {r.prompt: r for r in CB.generate_with(df, "prompt", "text", flaky, 10, 0.1).collect()}
    assert out["a"].text == "A" and out["a"].text_error is None
    assert out["b"].text is None and "server down" in out["b"].text_error


def test_generator_keeps_good_records_of_a_failing_batch(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string").coalesce(1)

    def flaky(prompts, max_tokens, temperature):
        if (prompts == "p7").any():
            raise RuntimeError("server down")
        return prompts.str.upper()

    out = {r.prompt: r for r in CB.generate_with(df, "prompt", "text", flaky, 10, 0.1).collect()}
    assert sum(r.text is None for r in out.values()) == 1 and "server down" in out["p7"].text_error and out["p8"].text == "P8"


def test_expectedness_reads_the_whole_label(spark):
    rows = [("nausea", "x " * 1400 + "Nausea was seen."), ("me", "Un problème grave."), ("vomiting", "Patients had severe\nnausea and\nvomiting. Rest."), ("rash", "")]
    got = {r.reaction_pt: r for r in L.expectedness(spark.createDataFrame(rows, "reaction_pt string, label_text string")).collect()}
    assert got["nausea"].labelling_status == "Expected" and got["me"].labelling_status == "Unexpected"
    assert got["vomiting"].labelling_evidence == "Patients had severe nausea and vomiting."
    assert got["rash"].labelling_status is None and got["rash"].needs_review


def test_seriousness_rules(spark):
    df = spark.createDataFrame([("The patient died after being hospitalised.",), ("Mild rash.",)], "t string")
    lbl, crit = CB.seriousness_from_text("t")
    got = df.select(lbl.alias("l"), crit.alias("c")).collect()
    assert got[0].l == "Serious" and got[0].c == ["Death", "Hospitalization"]
    assert got[1].l == "Non-serious" and got[1].c == []


def test_batch_score_rows_and_errors(spark):
    lookup = spark.createDataFrame([("nausea", 1, "Nausea", 10, "Nausea", 10, "GI", 20)],
                                   "pt_key string, key_pos long, meddra_pt string, meddra_pt_code long, meddra_llt string, meddra_llt_code long, meddra_soc string, meddra_soc_code long")

    def model(prompts, max_tokens, temperature):
        return prompts.map(lambda p: "sorry" if "bad" in p else
                           '<think>x</think>```json\n{"meddra_pt": "Nausea", "meddra_soc": "", "seriousness": "Serious"}\n```<|im_end|>')

    nar = spark.createDataFrame([("a", "Patient had nausea and was hospitalised."), ("b", "bad case")],
                                "line_id string, narrative string")
    got = {r.line_id: r for r in CB.batch_score(nar, model, lookup).collect()}
    assert got["a"].parse_ok and got["a"].meddra_pt_code == 10 and got["a"].meddra_soc == "GI"
    assert got["a"]._narrative.startswith("Patient") and got["a"].error is None
    assert not got["b"].parse_ok and got["b"].error == "JSON parse failed" and got["b"].raw_output == "sorry"


def test_display_fields(spark):
    df = spark.createDataFrame([(["Death", "Hospitalization"], "Rash", 1, None, None), ([], None, None, "Skin", 2)],
                               "seriousness_criteria array<string>, meddra_pt string, meddra_pt_code long, meddra_soc string, meddra_soc_code long")
    got = CB.display_fields(df).collect()
    assert got[0].criteria_display == "Death, Hospitalization" and got[0].pt_display == "Rash [1]"
    assert got[0].soc_display == "— [—]"
    assert got[1].criteria_display == "None" and got[1].pt_display == "— [—]" and got[1].soc_display == "Skin [2]"
