"""What kept some queries from growing with their input: costs of a step, not results."""

import os
import re

import pyarrow as pa
from pyspark.sql import functions as F

from vigil.functions import chat as CH
from vigil.functions import jsonx as JX
from vigil.functions import subword as SW
from vigil.functions.text import utrim
from vigil.operators import joins as J
from vigil.operators import signals as SG
from vigil.sources import paged
from vigil.streaming import clocks as CK


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trim_reads_the_ends_only(spark):
    texts = [chr(c) + "a " + chr(c) + "\n" for c in (0x1F, 0x20, 0x85, 0xA0, 0x2003, 0x3000, 0x41)] + ["", " \t ", "x"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", utrim("t").alias("u"))
    assert "regexp" not in plan(df).lower()
    assert all(r.u == (None if r.t is None else r.t.strip()) for r in df.collect())


def test_lines_keep_their_ids():
    pattern = r"'s| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"\n\n": 257, b" ab": 258}
    texts = ["ab ab\nab", "ab \n\n ab.\n.\n", "\n\nab\n", " \n\x1f\nab　\nab", "", None, "<x>ab\n<x>"]
    plain, by_line = (SW.tokenizer(ranks, pattern, {"<x>": 300}, **o) for o in ({}, {"by_line": True}))
    assert by_line(texts) == plain(texts)
    assert SW.lines("a\nb \nc") == ["a", "\nb \nc"]


def test_cases_of_a_bucket_keep_their_clocks(spark, tmp_path):
    day = lambda n: f"timestamp'2020-01-01' + interval {n} days"
    rows = spark.sql(f"""SELECT * FROM VALUES (1L, 10L, {day(0)}, true), (1L, 11L, {day(3)}, false), (2L, 20L, {day(0)}, true),
        (3L, null, {day(1)}, true), (3L, 31L, {day(2)}, false), (4L, 40L, {day(60)}, false) AS t(case_id, report_id, received, opens)""")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = (CK.expedited(stream, buckets=1).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(CK.OUT).parquet(f"{tmp_path}/out").select("case_id", "opened_by", "closed_by", "status").collect()
    assert sorted(map(tuple, out), key=lambda r: r[0]) == [(1, 10, 11, "met"), (2, 20, None, "overdue"), (3, None, 31, "met")]


def test_pages_are_landed_compressed_and_read_back(spark, tmp_path):
    raw = spark.createDataFrame([], paged.RAW_REPORT)
    raw = raw.unionByName(spark.range(3).select(*[F.col("id").cast("string").alias(f.name) if f.name == "safetyreportid" else F.lit(None).cast(f.dataType).alias(f.name)
                                                  for f in paged.RAW_REPORT.fields]))
    paged.land_pages(raw.withColumn("at", F.lit(0)), "at", f"{tmp_path}/pages")
    names = [n for n in os.listdir(f"{tmp_path}/pages/page=0") if n.startswith("part-")]
    assert len(names) == 1 and names[0].endswith(".gz")
    assert sorted(r["safetyreportid"] for r in paged.PageStore(f"file://{tmp_path}/pages").load(0, "")) == ["0", "1", "2"]


def test_page_batch_turns_values_into_text():
    batch = paged.page_batch(7, [{"safetyreportid": 5, "patient": {"reaction": [{"reactionoutcome": 1}]}}, {"safetyreportid": "6", "patient": None}])
    assert isinstance(batch, pa.RecordBatch) and batch.schema.names[:2] == ["page_skip", "page_error"]
    rows = batch.to_pylist()
    assert [r["safetyreportid"] for r in rows] == ["5", "6"] and rows[0]["patient"]["reaction"][0]["reactionoutcome"] == "1"
    assert rows[1]["patient"] is not None and rows[1]["patient"]["drug"] is None


def test_pair_counts_shuffle_rows_once(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "b", "x"), (None, "a", "x"), (3, "", "x")], "r long, d string, e string")
    n = SG.counts(rows, "r", "d", "e")
    assert "Expand" not in plan(n)
    assert sorted(map(tuple, n.collect()), key=str) == sorted([("a", "x", 1), ("a", "y", 1), ("b", "x", 1), ("a", None, 1), ("b", None, 1), (None, "x", 2),
                                                              (None, "y", 1), (None, None, 2)], key=str)


def test_json_strings_without_patterns(spark):
    df = spark.createDataFrame([('a"b\\c',), (None,)], "t string").select(JX._jstr(F.col("t")).alias("j"))
    assert "regexp" not in plan(df).lower()
    assert [r.j for r in df.collect()] == ['"a\\"b\\\\c"', "null"]


def test_ids_leave_python_once(spark):
    texts = ["", "a<b>c<b>dé", "é" * 9, None, "<b>", "x" * 12, "<b>" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    tok = CH.tokenize(df, "text", max_len=10, response_template=list(b"<b>"), count_col="whole")
    assert "attention_mask" not in re.search(r"MapInArrow .*", plan(tok)).group(0)
    want = []
    for i, t in enumerate(texts):
        ids = (t or "").encode()
        cut = ids[:10]
        until = cut.rfind(b"<b>") + 3 if b"<b>" in cut else len(cut)
        want.append((i, list(cut), [1] * len(cut), until, len(ids)))
    assert sorted(map(tuple, tok.collect())) == want


def test_small_tables_move_no_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id long, k string")
    table = spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    out = J.salted_join(rows, table, ["k"], "id")
    assert "SortMergeJoin" not in plan(out) and "_salt" not in plan(out)
    want = [("a", 1, 1), ("a", 4, 1), ("b", 2, None), (None, 3, None)]
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_large_tables_are_salted(spark, monkeypatch):
    monkeypatch.setattr(J, "DEFAULT_MAX_BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)] + [(99, None)], "id long, k string")
    out = J.salted_join(rows, spark.createDataFrame([("a", 1)], "k string, v int"), ["k"], "id")
    assert out.columns == ["k", "id", "v"] and "_salt" in plan(out)
    assert sorted((r.id, r.v) for r in out.collect()) == [(i, None if i % 2 else 1) for i in range(40)] + [(99, None)]
