"""Subword ids against a library, cut rows, head of an evaluation, report lines."""
import base64

import pytest
from pyspark.sql import functions as F

from vigil.functions import chat as CH
from vigil.functions import subword as SW
from vigil.operators import coding as C
from vigil.operators import evaluate as EV
from vigil.operators import profile as P
from vigil.sources import files as SF

ODD = ["", "a", "Hello  world!\n\n end ", "naïve café — 東京 \U0001f600", "x" * 3000, "<|im_start|>assistant\nok<|im_end|>", "á\x00\t", " 12345 it's"]


def test_merges_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    ranks = SW.read_ranks(spark, "file://" + P.path("byte_bpe_50k.tiktoken"))
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    assert ranks == known
    special = {CH.IM_START: 50256, CH.IM_END: 50257}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    encode = SW.tokenizer(ranks, P.PATTERN, special)
    assert encode(ODD + ODD) == [lib.encode(t, allowed_special="all") for t in ODD + ODD]
    assert encode([None]) == [[]]


def test_long_piece_merges():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258}
    assert SW.merged(b"ababa", ranks) == [257, 97]
    assert SW.merged(b"bab", ranks) == [98, 256]
    assert len(SW.merged(b"ab" * 50_000, ranks)) == 25_000


def test_cut_rows_are_counted(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "ab"), (3, None)], "id int, text string")
    for tok in (CH.byte_tokenizer, lambda ts: [list((t or "").encode()) for t in ts]):
        rows = CH.tokenize(df, "text", tokenizer=tok, max_len=4, count_col="n").select("id", "n", F.size("input_ids").alias("k")).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [(1, 6, 4), (2, 2, 2), (3, 0, 0)]


def test_report_lines(spark):
    c = spark.createDataFrame([(16, 8, 1, 2, 3, 4, 0)], "total long, json_parse_ok long, seriousness_match long, labelling_match long, "
                              "meddra_pt_match long, meddra_soc_match long, all_fields_match long")
    lines = [r.line for r in SF.evaluation_report(c, "Fine-tuned").orderBy("pos").collect()]
    assert lines == ["=" * 60, "EVALUATION RESULTS — Fine-tuned", "=" * 60, "  Records evaluated  : 16", "  JSON parse rate    : 50.0%  (8/16)", "",
                     "  Field accuracy (on 8 parsed records):", "    Seriousness       : 12.5%", "    MedDRA PT         : 37.5%",
                     "    MedDRA SOC        : 50.0%", "    Labelling status  : 25.0%", "    All fields correct: 0.0%", "=" * 60]
    none = SF.evaluation_report(c.withColumns({x: F.lit(0).cast("long") for x in c.columns}), "x").collect()
    assert [r.line for r in none] == ["No records evaluated."]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert CH.tokenize(df, "text", count_col="n").count() == 0
    assert EV.counters(spark.createDataFrame([], "parse_ok boolean, all_match boolean, seriousness struct<match:boolean>, labelling struct<match:boolean>, "
                                             "meddra_pt struct<match:boolean>, meddra_soc struct<match:boolean>")).first().total == 0


def test_optional_columns_and_limits(spark):
    df = spark.createDataFrame([("a", 10), ("a", 30), (None, None)], "lang string, n int")
    assert sorted(map(tuple, P.optional_counts(df, ["lang", "missing"]).collect()), key=str) == [("lang", "a", 2), ("lang", None, 1)]
    assert P.optional_counts(df, ["missing"]).count() == 0
    assert tuple(P.over_limits(df, "n", [20, 5]).first()) == (2, 1, 0.5, 2, 1.0)
    assert tuple(P.over_limits(df.limit(0), "n", [20]).first()) == (0, 0, None)


def test_unmatched_sample(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("c", "C")], "reaction_pt string, meddra_pt string")
    assert [tuple(r) for r in C.unmatched_sample(df, n=2).collect()] == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in C.unmatched_sample(df, n=1).collect()] == [("a", 1)]


def test_words_and_packed_ids_are_those_of_the_whole_text(spark):
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes([i]): i for i in range(256)} | {b" a": 256, b"it": 257, b"th": 258, b" th": 259, b"\n\n": 260, b"  ": 261}
    plain, by_line = (SW.tokenizer(ranks, pattern, {"<x>": 300}, **o) for o in ({}, {"by_line": True}))
    long = "it's the a, that \u00e9t\u00e9 isn't 12.5 % of them. " * 8
    texts = [long, "\n" + long, long.strip(), "\n" + long.strip(), long.replace(". ", ".  "), long.replace(", ", ",\t"), long.replace(". ", ".\u00a0"),
             "\n\n " + long.strip() + "\n \n" + long, long.replace(" ", "\x1c"), "<x>" + long.strip() + "<x>\n" + long, "", None, " ", "\n", *ODD]
    assert by_line(texts) == by_line(texts) == plain(texts)
    assert SW.words("\na b") == ["\na", " b"] and SW.words("a  b") is SW.words(" a") is SW.words("a\tb") is SW.words("a ") is None
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    listed = lambda ts: plain(ts)  # noqa: E731 - without ``packed``
    got, want = ([r.asDict() for r in CH.tokenize(df, "text", tokenizer=tok, max_len=50, response_template=plain(["the"])[0], count_col="n").orderBy("i").collect()]
                 for tok in (by_line, listed))
    assert got == want and any(r["n"] > 50 for r in got) and any(r["mask_until"] < len(r["input_ids"]) for r in got)
