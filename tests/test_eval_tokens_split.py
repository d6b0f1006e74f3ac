"""Evaluation (F10), token masks (F11), split."""
from pyspark.sql import functions as F

from vigil.functions import chat as CH
from vigil.operators import evaluate as EV
from vigil.operators import quality as Q

PAIRS = ("index long, parse_ok boolean, narrative string, pred_seriousness string, gold_seriousness string, "
         "pred_labelling_status string, gold_labelling_status string, pred_meddra_pt string, gold_meddra_pt string, "
         "pred_meddra_soc string, gold_meddra_soc string")


def test_scoring_and_rates(spark):
    rows = [
        (0, True, "n", "Serious", "Serious", "Expected", "Expected", "Rash", "Rash", "Skin", "Skin"),
        (1, True, "n", "Serious", "Serious", "Expected", "Expected", "RASH", "rash", None, None),
        (2, True, "n", "Serious", "Non-serious", None, None, "x", "y", "a", "A"),
        (3, False, "broken output narrative", None, "Serious", None, "Expected", None, "Rash", None, "Skin"),
    ]
    s = EV.score_pairs(spark.createDataFrame(rows, PAIRS))
    c = EV.counters(s).first()
    assert (c.total, c.json_parse_ok, c.seriousness_match, c.labelling_match, c.meddra_pt_match,
            c.meddra_soc_match, c.all_fields_match) == (4, 3, 2, 3, 2, 3, 2)
    r = EV.rates(EV.counters(s)).first()
    assert r.parse_rate == 75.0 and abs(r.all_fields_acc - 200 / 3) < 1e-9
    failed = s.where("index = 3").first()
    assert failed.narrative == "broken output narrative" and failed.seriousness is None
    empty = EV.rates(EV.counters(s.limit(0))).first()
    assert empty.total == 0 and empty.parse_rate is None


def test_running_totals_blocks(spark):
    df = spark.range(0, 95).select(F.col("id").alias("i"), F.lit(1).alias("v"))
    r = EV.running_totals(df, "i", ["v"], block=7).orderBy("i").collect()
    assert [x.cum_v for x in r] == list(range(1, 96))


def test_compare_modes(spark):
    rows = [("base", 10, 10, 100.0, 80.0, 50.0, 40.0, 60.0, 20.0), ("tuned", 10, 10, 100.0, 90.0, 90.0, 95.0, 90.0, 80.0)]
    df = spark.createDataFrame(rows, "mode string, total long, json_parse_ok long, parse_rate double, seriousness_acc double, meddra_pt_acc double, meddra_soc_acc double, labelling_acc double, all_fields_acc double")
    got = {r.metric: r for r in EV.compare_modes(df).collect()}
    assert got["all_fields_acc"].delta_pts == 60.0 and got["mean_field_acc"].base == 57.5


def test_response_mask_cases(spark):
    tpl = [1, 2]
    rows = [([5, 1, 2, 7, 8],), ([1, 2, 9, 1, 2, 3],), ([5, 6, 7],), ([1],), ([9, 1],)]
    df = spark.createDataFrame(rows, "ids array<int>")
    staged = CH.with_response_mask(df, "ids", tpl, "lab").collect()
    col = df.select(CH.response_mask("ids", tpl).alias("lab")).collect()
    want = [[-100, -100, -100, 7, 8], [-100] * 5 + [3], [-100] * 3, [-100], [-100, -100]]
    assert [r.lab for r in staged] == want and [r.lab for r in col] == want
    pad = spark.createDataFrame([([5, 1, 2, 7, 0], [1, 1, 1, 1, 0])], "ids array<int>, am array<int>")
    assert CH.with_response_mask(pad, "ids", tpl, "lab", "am").first().lab == [-100, -100, -100, 7, -100]


def test_tokenize_truncates(spark):
    df = spark.createDataFrame([("a", "hé" * 2000), ("b", "")], "id string, text string")
    got = {r.id: r for r in CH.tokenize(df, "text").collect()}
    assert len(got["a"].input_ids) == 2048 and got["a"].attention_mask == [1] * 2048
    assert got["b"].input_ids == [] and "text" not in CH.tokenize(df, "text").columns


def test_exact_split_sizes(spark):
    for n in (0, 1, 9, 10, 11, 999):
        df = spark.range(1, n + 1).select(F.col("id").cast("string").alias("id"))
        a = Q.exact_split(df)
        b = Q.exact_split(df.repartition(7).orderBy(F.rand(3)))
        ra = {r.id: r.split for r in a.collect()}
        rb = {r.id: r.split for r in b.collect()}
        assert len(ra) == n and ra == rb
        assert sum(1 for v in ra.values() if v == "train") == (n * 9) // 10


def test_split_balance(spark):
    df = spark.createDataFrame([("1", "Serious", "Expected", "train"), ("2", "Non-serious", "Expected", "train"),
                                ("3", "Serious", "Unexpected", "val")],
                               "id string, seriousness string, labelling_status string, split string")
    got = {r.split: r for r in Q.split_balance(df).collect()}
    assert got["train"].share_serious == 0.5 and got["val"].share_expected == 0.0


def test_tokenize_plugged_tokenizer(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", "")], "id string, text string")
    tok = lambda texts: [[len(w) for w in t.split()] for t in texts]
    got = {r.id: r for r in CH.tokenize(df, "text", tokenizer=tok, max_len=2).collect()}
    assert got["a"].input_ids == [1, 1] and got["a"].attention_mask == [1, 1] and got["b"].input_ids == []


def test_mask_boundary_in_batch_equals_jvm_search(spark):
    seqs = {"a": [5, 1, 2, 7, 8], "b": [1, 2, 9, 1, 2, 3], "c": [5, 6, 7], "d": [1], "e": [9, 1],
            "f": [300, 1, 2, 300], "g": []}
    df = spark.createDataFrame([(k,) for k in seqs], "id string")
    tok = lambda ids: [seqs[i] for i in ids]
    t = CH.tokenize(df.withColumn("text", df.id), "text", tokenizer=tok, keep=["id"], response_template=[1, 2])
    fast = {r.id: r.labels for r in CH.with_response_mask(t, "input_ids", [1, 2], "labels", until_col="mask_until").collect()}
    slow = {r.id: r.labels for r in CH.with_response_mask(t, "input_ids", [1, 2], "labels").collect()}
    assert fast == slow
    assert fast["a"] == [-100, -100, -100, 7, 8] and fast["f"] == [-100, -100, -100, 300] and fast["g"] == []
    bt = CH.tokenize(spark.createDataFrame([("x", "ab<|im_start|>assistant\nOK")], "id string, text string"),
                     "text", response_template=CH.byte_tokenizer([CH.RESPONSE_TEMPLATE])[0])
    r = CH.with_response_mask(bt, "input_ids", [], "labels", until_col="mask_until").first()
    assert r.labels[-2:] == [ord("O"), ord("K")] and r.labels[:-2] == [-100] * (len(r.labels) - 2)


def test_hash_split_is_per_row_and_stable(spark):
    df = spark.range(0, 2000).select(F.col("id").cast("string").alias("id"))
    a = {r.id: r.split for r in Q.hash_split(df).collect()}
    b = {r.id: r.split for r in Q.hash_split(df.repartition(5)).collect()}
    assert a == b and 0.85 < sum(v == "train" for v in a.values()) / 2000 < 0.95
