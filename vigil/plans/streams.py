"""Registered queries over landed pages and event-time streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from ..session import free_shuffles, partitions_kept, read_table, staged
from ..sources import paged
from ..streaming import cases as SC
from ..streaming import clocks as CK
from ..streaming import drift as DR
from ..streaming import ingest as W
from . import bridge, catalog
from .catalog import query, scratch_dir
from .oracle import CASES_CTE, CLEAN_CTE, DICT_CTE, LABEL_CTE, LABELLED_CTE, ORACLE

PAGE = 1000
LANDED_AT_ONCE = 8_000_000  # reports


def landed_pages(spark, sf, failing: bool) -> str:
    """Raw nested reports landed as pages by report key, ``PAGE`` keys each; every seventh page has failed if ``failing``.

    Pages land some at a time, about ``LANDED_AT_ONCE`` reports, so that the rows on their way take a bounded part of the disk."""
    path = f"{scratch_dir(spark)}/pages"
    free_shuffles(spark)
    at = F.floor(F.col("report_key") / PAGE) * PAGE
    bad = (F.col("at") / PAGE % 7 == 3) & F.lit(failing)
    parts = max(1, -(-read_table(spark, sf, "orders", "o_orderkey").count() // LANDED_AT_ONCE))
    for k in range(parts):
        # pages of null keys are in the first part
        part = F.coalesce(F.pmod(F.floor(F.col("at") / PAGE), F.lit(parts)), F.lit(0)) == k if parts > 1 else F.lit(True)
        with partitions_kept(spark):
            paged.land_pages(bridge.raw_reports_nested(spark, sf, at, ~bad & part), "at", path, mode="append")
    keys = read_table(spark, sf, "orders", "o_orderkey").withColumnRenamed("o_orderkey", "report_key")
    lost = keys.withColumn("at", at).where(bad).select(F.col("at").alias("page"), F.lit('{"error": "server"}').alias("value")).distinct()
    lost.write.mode("append").partitionBy("page").text(path)
    return path


@query("source_pages")
def source_pages(spark, sf):
    """Landed pages read as a stream by the paged source: reports with reactions and drugs, by id, with their page."""
    base, pages = scratch_dir(spark), landed_pages(spark, sf, True)
    W.fetch_pages(spark, pages, f"{base}/out", f"{base}/checkpoint", limit=PAGE)
    out = W.read_output(spark, f"{base}/out/reports")
    return out.select(F.col("safetyreportid").alias("id"), "page_skip", "serious", F.size("patient.reaction").alias("n_reactions"),
                      F.size("patient.drug").alias("n_drugs"))


@query("source_page_errors")
def source_page_errors(spark, sf):
    """Pages that failed, read as a batch."""
    paged.register(spark)
    df = spark.read.format("paged_reports").option("limit", PAGE).load(landed_pages(spark, sf, True))
    return df.where(F.col("page_error").isNotNull()).select("page_skip", "page_error")


_HDR_LN = "WITH " + CLEAN_CTE.split("lnr AS")[0].rstrip().rstrip(",")
ORACLE["source_pages"] = _HDR_LN + f"""
SELECT h.safetyreportid AS id, h.report_key // {PAGE} * {PAGE} AS page_skip, h.serious, CAST(n AS INTEGER) AS n_reactions, CAST(n AS INTEGER) AS n_drugs
FROM hdr h JOIN (SELECT report_key, count(*) AS n FROM ln GROUP BY 1) l ON l.report_key = h.report_key WHERE h.report_key // {PAGE} % 7 <> 3"""
ORACLE["source_page_errors"] = f"""SELECT DISTINCT o_orderkey // {PAGE} * {PAGE} AS page_skip,
  'ValueError: no report array in page ' || (o_orderkey // {PAGE} * {PAGE}) AS page_error FROM orders WHERE o_orderkey // {PAGE} % 7 = 3"""


@query("stream_cases")
def stream_cases(spark, sf, batches: int = 3):
    """Landed pages through coding, labels and validation in micro-batches; cases and rejects under one ledger."""
    base, pages = scratch_dir(spark), landed_pages(spark, sf, False)
    refs = SC.References(catalog.lookup_table(spark, sf), catalog.label_cache(spark, sf))
    n = spark.read.text(pages, wholetext=True).select("page").distinct().count()
    SC.build_cases(spark, pages, f"{base}/out", f"{base}/checkpoint", refs, max_files_per_trigger=max(1, -(-n // batches)))
    cases = SC.committed(spark, f"{base}/out", "cases").select("id", F.lit("case").alias("step"), F.lit(None).cast("string").alias("reason"),
                                                              "meddra_pt_code", "labelling_status")
    rejects = SC.committed(spark, f"{base}/out", "rejects").select("id", "step", "reason", F.lit(None).cast("long").alias("meddra_pt_code"),
                                                                  F.lit(None).cast("string").alias("labelling_status"))
    return cases.unionByName(rejects)


_NO_CLASS = CASES_CTE.replace("FROM case_in2)", "FROM case_in1)")
assert _NO_CLASS != CASES_CTE
ORACLE["stream_cases"] = "WITH " + CLEAN_CTE + "," + DICT_CTE + "," + LABEL_CTE + _NO_CLASS + """
SELECT id, CASE WHEN reject_reason IS NULL THEN 'case' ELSE 'validate' END AS step, reject_reason AS reason,
  CASE WHEN reject_reason IS NULL THEN meddra_pt_code END AS meddra_pt_code, CASE WHEN reject_reason IS NULL THEN labelling_status END AS labelling_status
FROM validated
UNION ALL SELECT id, 'code', 'no dictionary term', NULL, NULL FROM clean WHERE id NOT IN (SELECT id FROM coded2)
UNION ALL SELECT safetyreportid, 'normalise', reject_reason, NULL, NULL FROM st2 WHERE reject_reason IS NOT NULL"""


# ---------------------------------------------------------- event-time streams ----
def land_slices(df, time: str, path: str, slices: int):
    """Rows landed as ``slices`` folders of equal spans of time, one after another, as a feed would."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        df.write.parquet(f"{path}/slice=0")
        return
    step = (high - low) / slices
    for k in range(slices):
        part = df.where(F.col(time) >= F.lit(low + k * step))
        part = part.where(F.col(time) < F.lit(low + (k + 1) * step)) if k < slices - 1 else part
        part.coalesce(1).write.parquet(f"{path}/slice={k}")


def run_stream(stream, out: str, checkpoint: str):
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def received_reports(spark, sf):
    """Reports with their patient as case, the received time, and whether they are serious and unexpected."""
    clean = staged(catalog.clean_reports(spark, sf), "clean")
    told = L.assess(clean.select("id", "drug_name", "reaction_pt", "serious"), catalog.label_cache(spark, sf, clean))
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return orders.join(told, orders["o_orderkey"] == told["id"].cast("long")).select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("timestamp").alias("received"),
        (F.col("serious") & F.coalesce(F.col("labelling_status") == "Unexpected", F.lit(False))).alias("opens"))


@query("stream_expedited")
def stream_expedited(spark, sf):
    """15-day clocks of the patients: opened by a serious unexpected report, closed by the next report or overdue."""
    base = scratch_dir(spark)
    reports = staged(received_reports(spark, sf), "received")
    land_slices(reports, "received", f"{base}/landing", 4)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    run_stream(CK.expedited(stream), f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema(CK.OUT).parquet(f"{base}/out")
    return out.select("case_id", "opened_by", F.timestamp_millis("opened_ms").cast("timestamp_ntz").alias("opened_at"), "closed_by",
                      F.timestamp_millis("closed_ms").cast("timestamp_ntz").alias("closed_at"), "status")


@query("drift_windows")
def drift_windows(spark, sf):
    """Daily event types compared with the day before, over a stream of landed events."""
    base = scratch_dir(spark)
    events = read_table(spark, sf, "events", "event_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    land_slices(events, "ts", f"{base}/landing", 4)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landing")
    run_stream(DR.window_counts(stream, "ts", "event_type"), f"{base}/out", f"{base}/checkpoint")
    counts = spark.read.schema("window_start timestamp, window_end timestamp, value string, n long").parquet(f"{base}/out")
    out = DR.divergence(counts, 0.002)
    return out.withColumns({c: F.round(c, 9) for c in ("js", "variation")}).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


ORACLE["stream_expedited"] = "WITH RECURSIVE " + CLEAN_CTE + "," + LABEL_CTE + LABELLED_CTE + """,
rp AS (SELECT o_custkey AS case_id, o_orderkey AS id, o_orderdate AS t, serious AND coalesce(labelling_status = 'Unexpected', false) AS opens,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
       FROM orders JOIN labelled ON labelled.id = CAST(o_orderkey AS VARCHAR)),
walk AS (
  SELECT case_id, rn, CASE WHEN opens THEN id END AS ob, CASE WHEN opens THEN t END AS oa,
    NULL::BIGINT AS eb, NULL::TIMESTAMP AS ea, NULL::BIGINT AS cb, NULL::TIMESTAMP AS ca, NULL::VARCHAR AS status FROM rp WHERE rn = 1
  UNION ALL
  SELECT r.case_id, r.rn,
    CASE WHEN ob IS NOT NULL AND t <= oa + INTERVAL 15 DAY THEN NULL WHEN opens THEN id END,
    CASE WHEN ob IS NOT NULL AND t <= oa + INTERVAL 15 DAY THEN NULL WHEN opens THEN t END,
    ob, oa, CASE WHEN ob IS NOT NULL AND t <= oa + INTERVAL 15 DAY THEN id END, CASE WHEN ob IS NOT NULL AND t <= oa + INTERVAL 15 DAY THEN t END,
    CASE WHEN ob IS NULL THEN NULL WHEN t <= oa + INTERVAL 15 DAY THEN 'met' ELSE 'overdue' END
  FROM walk w JOIN rp r ON r.case_id = w.case_id AND r.rn = w.rn + 1),
ended AS (
  SELECT case_id, eb, ea, cb, ca, status FROM walk WHERE status IS NOT NULL
  UNION ALL
  SELECT case_id, ob, oa, NULL, NULL, 'overdue' FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rn DESC) AS l FROM walk)
  WHERE l = 1 AND ob IS NOT NULL AND oa + INTERVAL 15 DAY < (SELECT max(t) FROM rp))
SELECT case_id, eb AS opened_by, ea AS opened_at, cb AS closed_by, ca AS closed_at, status FROM ended"""
ORACLE["drift_windows"] = """WITH c AS (
  SELECT date_trunc('day', ts) AS d, event_type AS v, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT d, v, n, sum(n) OVER (PARTITION BY d) AS total FROM c WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
t AS (SELECT DISTINCT d, CAST(total AS BIGINT) AS n FROM s),
x AS (SELECT t.d, t.n, b.n AS nb, v FROM t LEFT JOIN t b ON b.d = t.d - INTERVAL 1 DAY, (SELECT DISTINCT v FROM s)),
y AS (SELECT x.d, x.n, x.nb, coalesce(b.n / b.total, 0) AS p, coalesce(a.n / a.total, 0) AS q
      FROM x LEFT JOIN s a ON a.d = x.d AND a.v = x.v LEFT JOIN s b ON b.d = x.d - INTERVAL 1 DAY AND b.v = x.v),
z AS (SELECT d, n, nb, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js,
        sum(abs(p - q)) / 2 AS tv FROM y GROUP BY 1, 2, 3)
SELECT d::TIMESTAMP AS window_start, d::TIMESTAMP + INTERVAL 1 DAY AS window_end, n, nb AS n_before, CASE WHEN nb IS NOT NULL THEN round(js, 9) END AS js,
  CASE WHEN nb IS NOT NULL THEN round(tv, 9) END AS variation, coalesce(nb IS NOT NULL AND js > 0.002, false) AS drifted FROM z"""
