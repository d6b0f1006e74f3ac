"""Paged source: end of data, failed pages, push-down, resume, stop after failures in a row."""
import json
import os

import pytest

from vigil.sources import paged
from vigil.streaming import ingest as W


def report(i, **patient):
    return {"safetyreportid": str(i), "serious": "1", "patient": {
        "reaction": [{"reactionmeddrapt": "Rash"}], "drug": [{"medicinalproduct": "D"}], **patient}}


def land(path, skip, reports):
    with open(os.path.join(path, f"page-{skip:09d}.json"), "w") as f:
        f.write("not json" if reports is None else json.dumps({"results": reports}))


@pytest.fixture
def pages(tmp_path):
    d = tmp_path / "pages"
    d.mkdir()
    for k in range(9):
        land(d, 10 * k, None if k in (3, 7) else [report(10 * k + j) for j in range(10)] + [report(5)])
    land(d, 20, [report(20), report(21, drug=[]), report(22, reaction=None), {"safetyreportid": "23"}])
    return str(d)


def test_end(pages, tmp_path):
    for n in (1, 2, 3, 9):
        d = tmp_path / f"n{n}"
        d.mkdir()
        for k in range(n):
            land(d, k * 10, [])
        assert paged.PageStore(str(d)).end(10) == n * 10
    assert paged.PageStore(f"file:{tmp_path}").end(10) == 0


def test_batch(spark, pages):
    paged.register(spark)
    df = spark.read.format("paged_reports").option("limit", 10).option("pagesPerTask", 2).load(pages)
    rows = df.collect()
    assert sorted({r.page_skip for r in rows if r.page_error}) == [30, 70] and sum(r.page_error is None for r in rows) == 6 * 11 + 4
    some = df.where("patient.reaction is not null and patient.drug is not null")
    assert sorted(r.safetyreportid for r in some.where("page_skip = 20").collect()) == ["20"]
    reader = paged.PagedReader({"path": pages})
    left = list(reader.pushFilters([paged.IsNotNull(("patient", "drug")), paged.IsNotNull(("serious",))]))
    assert reader.search == "_exists_:patient.drug" and len(left) == 2


def out(spark, path):
    return W.read_output(spark, f"{path}/reports")


def test_stream_and_resume(spark, pages, tmp_path):
    to, check = str(tmp_path / "out"), str(tmp_path / "check")
    W.fetch_pages(spark, pages, to, check, limit=10)
    first = {r.safetyreportid for r in out(spark, to).collect()}
    assert len(first) == out(spark, to).count() == 6 * 10 + 1
    W.fetch_pages(spark, pages, to, check, limit=10)
    assert out(spark, to).count() == 61
    land(pages, 90, [report(90), report(5)])
    W.fetch_pages(spark, pages, to, check, limit=10)
    assert {r.safetyreportid for r in out(spark, to).collect()} == first | {"90"} and out(spark, to).count() == 62
    errors = spark.read.parquet(f"{to}/errors")
    assert sorted(r.page_skip for r in errors.collect()) == [30, 70]


def test_stop_after_failures_in_a_row(spark, pages, tmp_path):
    for k in (9, 10, 11, 12, 14):
        land(pages, 10 * k, None)
    land(pages, 80, None)
    land(pages, 130, [report(130)])
    to, check = str(tmp_path / "out"), str(tmp_path / "check")
    with pytest.raises(Exception, match="failed pages in a row"):  # 70, 80, ..., 110
        W.fetch_pages(spark, pages, to, check, limit=10)
    ids = {r.safetyreportid for r in out(spark, to).collect()}
    assert "69" in ids and "130" not in ids
    for k in (8, 9, 10):
        land(pages, 10 * k, [report(10 * k)])
    W.fetch_pages(spark, pages, to, check, limit=10)
    assert {r.safetyreportid for r in out(spark, to).collect()} == ids | {"80", "90", "100", "130"}


def test_files_per_batch(spark, tmp_path):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(8)
    W.idempotent_write(df, str(tmp_path / "o"), "k", "r", 0)
    files = [f for _, _, fs in os.walk(tmp_path / "o") for f in fs if f.startswith("part-")]
    assert len(files) <= W.KEY_BUCKETS and W.read_output(spark, str(tmp_path / "o")).count() == 5000


def test_batches_are_bounded(spark, pages, tmp_path):
    """Some pages at a time, each id once, and a run of failed pages over several batches still stops the fetch."""
    whole, some = (str(tmp_path / x) for x in ("whole", "some"))
    W.fetch_pages(spark, pages, whole, f"{whole}-check", limit=10)
    W.fetch_pages(spark, pages, some, f"{some}-check", limit=10, batch_pages=2)
    rows = lambda path: sorted((r.safetyreportid, r.page_skip) for r in out(spark, path).where("safetyreportid <> '5'").collect())
    assert rows(some) == rows(whole) and out(spark, some).count() == 61
    assert len({r.epoch for r in spark.read.parquet(f"{some}/errors").select("epoch").collect()} | {0}) > 1
    assert W.reached(spark, f"{some}-check") == 90
    for k in range(9, 15):
        land(pages, 10 * k, None)
    with pytest.raises(Exception, match="5 failed pages in a row, the last one at 130"):
        W.fetch_pages(spark, pages, some, f"{some}-check", limit=10, batch_pages=2)


def test_pages_land_in_parts(spark, tmp_path, monkeypatch):
    """The same pages whether they land at once or in parts; each line moves once on its way to its page."""
    from pyspark.sql import functions as F
    from vigil.plans import bridge, streams
    from vigil.session import partitions_kept
    orders = [(i * 37 if i else None, 1, "O", "1-URGENT") for i in range(200)]
    lines = [(i * 37, i % 5, 1, n, 1.0, 2.0, "A", None) for i in range(1, 200) for n in range(1 + i % 4)]
    sf = str(tmp_path)
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{sf}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, "
                          "l_shipdate timestamp").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(1, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{sf}/customer.parquet")
    spark.createDataFrame([(i, f"new {i}", "Brand#1", "T") for i in range(5)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{sf}/part.parquet")

    def landed(failing):
        found = spark.read.text(streams.landed_pages(spark, sf, failing), wholetext=True).select("page", F.get_json_object("value", "$.results").alias("r"))
        return {r.page: r.r and sorted(json.dumps(x, sort_keys=True) for x in json.loads(r.r)) for r in found.collect()}

    whole = [landed(True), landed(False)]
    assert None in whole[1] and None not in whole[0] and sum(len(r) for r in whole[1].values()) == 200 and None in whole[0].values()
    monkeypatch.setattr(streams, "LANDED_AT_ONCE", 70)
    assert [landed(True), landed(False)] == whole
    at = F.floor(F.col("report_key") / 1000) * 1000
    with partitions_kept(spark):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = bridge.raw_reports_nested(spark, sf, at, F.lit(True)).groupBy("at").agg(F.count_if(F.size("patient.drug") > 1))._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(at#") == 2 and "hashpartitioning(report_key#" not in plan
