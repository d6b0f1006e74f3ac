"""Chat records (F8), model-output parsing (F9), JSON bytes."""
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vigil.functions import chat as CH
from vigil.functions import jsonx as JX

MSG = "array<struct<role:string,content:string>>"


def test_narrative_and_gold_pull(spark):
    rows = [
        ([("system", "s"), ("user", "Intro\n\nNarrative:\n  Body one  "), ("assistant", '{"a": 1}')],),
        ([("user", "Narrative: Body two"), ("assistant", "x")],),
        ([("user", "Narrative: first Narrative:\nsecond")],),
        ([("user", "no marker"), ("user", "Narrative: later")],),
        ([("user", "nothing")],),
        ([("assistant", "bad"), ("assistant", '{"a": 2}')],),
    ]
    df = spark.createDataFrame(rows, f"messages {MSG}")
    got = df.select(CH.narrative_from_messages("messages").alias("n"),
                    CH.first_assistant("messages").alias("a")).collect()
    assert [r.n for r in got] == ["Body one", "Body two", "second", "later", "", ""]
    assert got[4].a is None and got[5].a == "bad"


def test_flat_text_layout(spark):
    df = spark.createDataFrame([("N", '{\n  "a": 1\n}')], "n string, j string")
    r = df.select(CH.flat_text(CH.chat_messages("n", "j")).alias("t")).first().t
    assert r == (f"<|im_start|>system\n{CH.SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\n{CH.INSTRUCTION}\n\n"
                 "Narrative:\nN<|im_end|>\n<|im_start|>assistant\n{\n  \"a\": 1\n}<|im_end|>")


CASES = [  # raw, robust (T2) object or None, three-tier (T1) object or None
    ('{"a": 1, "b": [1, 2]}', {"a": 1, "b": [1, 2]}, {"a": 1, "b": [1, 2]}),
    ('Sure:\n```json\n{"a": {"b": 2}}\n```\nbye', {"a": {"b": 2}}, {"a": {"b": 2}}),
    ('<think>{"x":1}</think>{"a":1}', {"a": 1}, None),
    ('first {"a":1} then {"b":2}', {"a": 1}, None),
    ('{bad} {"a":1}', None, None),
    ('{"a":1', None, None),
    ('{"a":"}"}', None, {"a": "}"}),
    ('[1,2]', None, None),
    ('{"a": 1} trailing', {"a": 1}, {"a": 1}),
    ('{"a": 1} {"b": 2}', {"a": 1}, None),
]


def test_parsers(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "raw string")
    r = JX.with_json_tiers(JX.with_json_robust(df, "raw", "rob"), "raw", "tier")
    got = r.select(F.to_json("rob").alias("rob"), F.to_json("tier").alias("tier")).collect()
    for (raw, want_r, want_t), g in zip(CASES, got):
        assert (json.loads(g.rob) if g.rob else None) == want_r, raw
        assert (json.loads(g.tier) if g.tier else None) == want_t, raw
    # column forms agree with the staged forms
    cols = df.select(F.to_json(JX.extract_json_robust("raw")).alias("r"),
                     F.to_json(JX.extract_json_tiers("raw")).alias("t")).collect()
    assert [c.r for c in cols] == [g.rob for g in got] and [c.t for c in cols] == [g.tier for g in got]


def test_nan_and_duplicate_keys_are_rejected(spark):
    df = spark.createDataFrame([('{"a": NaN}',), ('{"a": 1, "a": 2}',)], "raw string")
    assert [r.v for r in JX.with_json_robust(df, "raw", "v").select(F.col("v").isNull().alias("v")).collect()] == [True, True]


TARGET_DDL = ("seriousness string, seriousness_criteria array<string>, meddra_pt string, meddra_pt_code long, "
              "meddra_soc string, meddra_soc_code long, labelling_status string, labelling_evidence string, "
              "who_umc_category string")


def test_target_json_bytes(spark):
    rows = [
        ("Serious", [], "Rash", None, "", None, "Expected", 'He said "ok" \\ done\nnext', "Possible"),
        ("Non-serious", ["Death", "Hospitalization"], "Dyspnoea ≥ 2", 10013968, "Resp", 10038738,
         "Unexpected", "emoji 😀", "Certain"),
    ]
    df = spark.createDataFrame(rows, TARGET_DDL)
    got = [r.j for r in df.select(JX.target_json(JX.target_struct()).alias("j")).collect()]
    keys = [f.split()[0] for f in TARGET_DDL.split(", ")]
    assert got == [json.dumps(dict(zip(keys, [list(v) if isinstance(v, list) else v for v in row])), indent=2)
                   for row in rows]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=20), st.lists(st.sampled_from(["Death", "Hospitalization"]), max_size=2))
def test_extract_of_format_is_identity(spark, ev, crit):
    row = ("Serious", crit, "PT", 1, "SOC", 2, "Expected", ev, "Possible")
    df = spark.createDataFrame([row], TARGET_DDL)
    j = df.select(JX.target_json(JX.target_struct()).alias("j"))
    back = JX.with_json_robust(j, "j", "v").select(JX.field(F.col("v"), "labelling_evidence").alias("e"),
                                                   JX.field(F.col("v"), "seriousness_criteria", "array<string>").alias("c")).first()
    if "{" not in ev and "}" not in ev:      # the reference's scan counts braces inside strings
        assert back.e == ev and back.c == crit


def test_native_json_bytes_match_python(spark):
    rows = [
        ("Serious", [], "Rash", None, "", None, "Expected", 'He said "ok" \\ done', "Possible"),
        ("Non-serious", ["Death", "Hospitalization"], "Pain", 1, "Soc", 2, "Unexpected", "plain", "Certain"),
        ("Serious", ["Death"], "Dyspnoea ≥ 2", 3, "Resp", 4, None, "tab\there", "Unlikely"),
    ]
    df = spark.createDataFrame(rows, TARGET_DDL)
    got = {r.meddra_pt: r.j for r in JX.with_target_json(df, "j").collect()}
    keys = [f.split()[0] for f in TARGET_DDL.split(", ")]
    for row in rows:
        want = json.dumps(dict(zip(keys, [list(v) if isinstance(v, list) else v for v in row])), indent=2)
        assert got[row[2]] == want
