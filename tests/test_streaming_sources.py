"""Streaming ingest (W1-W3) equals batch; file sources."""
import json
import os
import tempfile

import pytest

from vigil.operators import normalize as N
from vigil.sources import files as SF
from vigil.sources import reports as SR
from vigil.streaming import ingest as W


def _page(reports):
    return {"results": reports}


def _report(i, pt="Rash"):
    return {"safetyreportid": str(i), "serious": "1", "patient": {
        "patientonsetage": "50", "patientsex": "2",
        "reaction": [{"reactionmeddrapt": pt, "reactionoutcome": "1"}],
        "drug": [{"medicinalproduct": f"D{i % 3}", "drugcharacterization": "1", "drugadditional": "1"}]}}


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="vigil-test-")
    land = os.path.join(base, "landing")
    os.makedirs(land)
    # three pages; page 2 re-delivers two reports of page 1 (a resumed fetch)
    pages = [[_report(i) for i in range(0, 5)], [_report(i) for i in range(3, 8)], [_report(i) for i in range(8, 10)]]
    for k, p in enumerate(pages):
        with open(os.path.join(land, f"page-{k * 100:09d}.json"), "w") as f:
            json.dump(_page(p), f)
    W.ingest_report_pages(spark, land, os.path.join(base, "out"), os.path.join(base, "ckpt"), max_files_per_trigger=1)
    streamed = W.read_output(spark, os.path.join(base, "out"))
    batch = N.normalize_reports(SR.read_pages(spark, land).drop("_page", "_pos"))
    assert streamed.count() == 10
    key = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*N.CLEAN_COLUMNS).collect())
    assert key(streamed) == key(batch)
    # re-running the stream (same checkpoint) adds nothing
    W.ingest_report_pages(spark, land, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    assert W.read_output(spark, os.path.join(base, "out")).count() == 10
    # a new checkpoint over the old output starts at epoch 0 again, and loses and doubles nothing
    with open(os.path.join(land, "page-000000900.json"), "w") as f:
        json.dump(_page([_report(i) for i in (9, 77, 78)]), f)
    W.ingest_report_pages(spark, land, os.path.join(base, "out"), os.path.join(base, "ckpt2"))
    assert W.read_output(spark, os.path.join(base, "out")).count() == 12
    os.remove(os.path.join(land, "page-000000900.json"))
    # the paged data source reads the same reports
    SR.register(spark)
    ds = spark.read.format("report_pages").option("dir", land).option("total", 300).option("limit", 100).load()
    assert ds.count() == 12 and N.normalize_reports(ds).count() == 10
    # a missing page, or one without reports, is an error and not a loss
    with pytest.raises(Exception, match="page-000000300"):
        spark.read.format("report_pages").option("dir", land).option("total", 400).option("limit", 100).load().count()
    with open(os.path.join(land, "page-000000300.json"), "w") as f:
        f.write('{"error": "server"}')
    with pytest.raises(Exception, match="no report array"):
        SR.read_pages(spark, land).count()


def test_text_lines_and_json_map(spark):
    base = tempfile.mkdtemp(prefix="vigil-test-")
    p = os.path.join(base, "n.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("  first narrative \n\n   \nsecond\x0bthird\n")
    assert [r.narrative for r in SF.read_text_lines(spark, p).collect()] == ["first narrative", "second", "third"]
    m = os.path.join(base, "lookup.json")
    with open(m, "w") as f:
        json.dump({"nausea": {"meddra_pt": "Nausea", "meddra_pt_code": 1}}, f)
    r = SF.read_json_map(spark, m, "struct<meddra_pt:string,meddra_pt_code:bigint>", "pt_key").first()
    assert r.pt_key == "nausea" and r.meddra_pt_code == 1


def test_sinks(spark):
    import glob
    from pyspark.sql import functions as F
    base = tempfile.mkdtemp(prefix="vigil-test-")
    df = spark.createDataFrame([("a", ["x", "≥"], "train"), ("b", [], "val")], "id string, c array<string>, split string")
    SF.write_jsonl(df, os.path.join(base, "exact"), exact_bytes=True)
    lines = sorted(open(f, encoding="utf-8").read().strip() for f in glob.glob(os.path.join(base, "exact", "split=*", "part-*")))
    assert lines == [json.dumps({"id": "a", "c": ["x", "≥"]}), json.dumps({"id": "b", "c": []})]
    SF.write_jsonl(df, os.path.join(base, "spark"))
    back = spark.read.json(os.path.join(base, "spark"))
    assert back.count() == 2 and set(back.columns) == {"id", "c", "split"}
    m = spark.createDataFrame([(10, 9.5)], "total long, parse_rate double")
    txt = SF.summary_text(m, "Base model").first().value
    assert "EVALUATION RESULTS — Base model" in txt and "parse_rate" in txt and "9.5" in txt
    both = SF.comparison_report(m, m)
    assert sorted(r.mode for r in both.collect()) == ["base", "tuned"]


def test_watermark_dedup_stream(spark):
    """W3 with a received-time column: duplicates re-delivered in later files
    are dropped within the watermark (bounded state)."""
    base = tempfile.mkdtemp(prefix="vigil-test-")
    land = os.path.join(base, "landing")
    os.makedirs(land)
    rows = [{"event_id": i, "ts": f"2024-01-01T00:{i:02d}:00.000000", "props": "{}"} for i in range(12)]
    chunks = [rows[0:6], rows[4:10], rows[8:12] + rows[0:1]]
    for k, c in enumerate(chunks):
        with open(os.path.join(land, f"part-{k}.json"), "w") as f:
            f.write("\n".join(json.dumps(r) for r in c))
    schema = spark.createDataFrame([], "event_id long, ts timestamp_ntz, props string").schema
    W.ingest_files(spark, land, schema, os.path.join(base, "out"), os.path.join(base, "ckpt"), "event_id",
                   "json", max_files_per_trigger=1, received_col="ts", watermark="1 hour", multiline=False,
                   options=W.JSON_TIME_OPTIONS)
    out = spark.read.parquet(os.path.join(base, "out"))
    assert out.count() == 12 and out.select("event_id").distinct().count() == 12
