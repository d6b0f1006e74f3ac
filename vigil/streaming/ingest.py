"""Incremental ingest with Structured Streaming.

W1: landed files are a file-source stream with a checkpoint; a trigger of
``availableNow`` processes whatever has landed and stops (the reference's
poll-and-resume loop).  W2: each micro-batch is written by ``foreachBatch``
and is idempotent by id (an anti-join against the output), so a batch
replayed after an executor or driver loss writes nothing twice.  W3: ids are
unique in the output; with a received-time column, duplicates are dropped
within a watermark with bounded state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.normalize import normalize_reports
from ..schemas import RAW_PAGE
from ..session import free_shuffles, partitions_kept, path_exists, staged, unstaged
from ..sources import paged

KEY_BUCKETS = 64
BATCH_PAGES = 8192
# JSON keeps microseconds only with an explicit pattern (the default writes ms).
MICROS_TS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
MICROS_TS_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON_TIME_OPTIONS = {"timestampFormat": MICROS_TS, "timestampNTZFormat": MICROS_TS_NTZ}


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the stream that ``checkpoint`` belongs to: a file beside it, made with the checkpoint.

    A new checkpoint starts again at epoch 0; its output must not replace that of an earlier one."""
    path = f"{checkpoint.rstrip('/')}/run_id"
    if not path_exists(spark, path):
        spark.createDataFrame([(uuid.uuid4().hex,)], "value string").coalesce(1).write.text(path)
    return spark.read.text(path).first().value


def _buckets(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(KEY_BUCKETS)).cast("int")


def _existing_ids(spark: SparkSession, out_path: str, key: str, run: str, epoch: int) -> DataFrame | None:
    """Keys that other epochs or runs have written; None if there are no data files yet."""
    pattern = f"{out_path.rstrip('/')}/run=*/epoch=*"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return None
    done = spark.read.option("basePath", out_path).parquet(pattern)
    return done.where((F.col("run") != run) | (F.col("epoch") != epoch)).select(key, "key_bucket")


def idempotent_write(batch: DataFrame, out_path: str, key: str, run: str, epoch: int, stable: bool = False) -> None:
    """Write one micro-batch as partition ``run=<id>/epoch=<n>`` (overwrite: a replayed
    batch replaces its own output and no other), keeping only keys not written before.

    The batch is computed once, and kept meanwhile unless it is ``stable``: a stored table, of which the keys alone
    can be read.  Output is partitioned by a hash of the key, so
    the check reads only the key buckets that the batch has."""
    spark = batch.sparkSession
    keyed = batch.withColumn("key_bucket", _buckets(F.col(key)))
    if stable:
        out, done = keyed.repartition("key_bucket"), _existing_ids(spark, out_path, key, run, epoch)
        if done is not None:
            wanted = [r.key_bucket for r in keyed.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS numbers
            out = out.join(done.where(F.col("key_bucket").isin(wanted)).repartition("key_bucket"), [key, "key_bucket"], "left_anti")
        out = out.dropDuplicates([key, "key_bucket"])
        with partitions_kept(spark):  # rows move once
            out.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{out_path.rstrip('/')}/run={run}/epoch={epoch}")
        return
    fresh = keyed.repartition("key_bucket").dropDuplicates([key, "key_bucket"]).persist()
    try:
        out = fresh
        done = _existing_ids(spark, out_path, key, run, epoch)
        if done is not None:
            wanted = [r.key_bucket for r in fresh.select("key_bucket").distinct().collect()]  # at most KEY_BUCKETS numbers
            out = fresh.join(done.where(F.col("key_bucket").isin(wanted)), [key, "key_bucket"], "left_anti").repartition("key_bucket")
        # a bucket in one task: one file for each bucket that the batch has
        out.write.mode("overwrite").partitionBy("key_bucket").parquet(f"{out_path.rstrip('/')}/run={run}/epoch={epoch}")
    finally:
        fresh.unpersist()


def read_output(spark: SparkSession, out_path: str) -> DataFrame:
    """All rows that any run has written, without the columns of the layout."""
    return spark.read.option("basePath", out_path).parquet(f"{out_path.rstrip('/')}/run=*/epoch=*").drop("run", "epoch", "key_bucket")


def ingest_files(spark: SparkSession, landing: str, schema: StructType, out_path: str,
                 checkpoint: str, key: str, fmt: str = "json",
                 transform=None, max_files_per_trigger: int | None = None,
                 received_col: str | None = None, watermark: str = "1 hour",
                 multiline: bool = True, options: dict | None = None) -> None:
    """Stream every landed file once into ``out_path`` (parquet, one
    ``run=<id>/epoch=<batch>`` partition per micro-batch), unique by ``key``; returns
    when the landed backlog is processed."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "json" and multiline:
        r = r.option("multiLine", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    stream = r.load(landing)
    if transform is not None:
        stream = transform(stream)
    if received_col:
        # watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is cast in the session
        # time zone (only ordering and the delay matter for the watermark)
        wm = received_col
        if stream.schema[received_col].dataType.typeName() == "timestamp_ntz":
            wm = "_received_ts"
            stream = stream.withColumn(wm, F.col(received_col).cast("timestamp"))
        stream = stream.withWatermark(wm, watermark).dropDuplicatesWithinWatermark([key])
        if wm != received_col:
            stream = stream.drop(wm)

    run = run_id(spark, checkpoint)

    def write(batch: DataFrame, epoch: int) -> None:
        idempotent_write(batch, out_path, key, run, epoch)

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def reached(spark: SparkSession, checkpoint: str) -> int:
    """Start of the first page that the stream of ``checkpoint`` has not planned to read yet."""
    path = f"{checkpoint.rstrip('/')}/offsets"
    if not path_exists(spark, path):
        return 0
    logged = spark.read.text(path).where(F.col("value").startswith('{"skip"'))
    return logged.agg(F.coalesce(F.max(F.get_json_object("value", "$.skip").cast("long")), F.lit(0))).first()[0]


def fetch_pages(spark: SparkSession, pages: str, out_path: str, checkpoint: str, limit: int = paged.DEFAULT_PAGE_SIZE,
                search: str = paged.REQUIRED_FIELDS_SEARCH, max_failed: int = paged.MAX_FAILED_PAGES, batch_pages: int = BATCH_PAGES) -> None:
    """S1 + S2 as a stream: read all pages from where the checkpoint stands, unique by report id, into
    ``out_path``/reports, and failed pages into ``out_path``/errors.

    A batch takes up to ``batch_pages`` pages; its rows are stored once, as a service may not answer twice alike, and go
    with the batch.  After ``max_failed`` failed pages in a row it keeps what stands before them and raises ``FetchStopped``; as the
    offset isn't committed then, the next call reads these pages again."""
    paged.register(spark)
    free_shuffles(spark)
    run = run_id(spark, checkpoint)
    errors_path = f"{out_path.rstrip('/')}/errors"

    def write(batch: DataFrame, epoch: int) -> None:
        held = staged(batch, "pages")
        try:
            failed = held.where(F.col("page_error").isNotNull()).select("page_skip", "page_error")
            failed.write.mode("overwrite").parquet(f"{errors_path}/run={run}/epoch={epoch}")
            known = spark.read.option("basePath", errors_path).schema("page_skip long, page_error string, run string, epoch long").parquet(errors_path)
            known = known.where((F.col("run") == run) & (F.col("epoch").between(epoch - span, epoch)))
            stop = paged.stop_page(known, limit, max_failed)
            good = held.where(F.col("page_error").isNull())
            good = good if stop is None else good.where(F.col("page_skip") < stop)
            idempotent_write(good.drop("page_error"), f"{out_path.rstrip('/')}/reports", "safetyreportid", run, epoch, stable=True)
        finally:
            unstaged(held)
        if stop is not None:
            raise paged.FetchStopped(f"{max_failed} failed pages in a row, the last one at {stop}")

    span = max(1, -(-max_failed // batch_pages))  # batches before this one that a run of failed pages may have begun in
    end, upto = paged.PageStore(pages).end(limit), reached(spark, checkpoint)
    while True:
        upto += batch_pages * limit
        options = {"path": pages, "limit": str(limit), "search": search, "upto": str(upto)}
        q = (spark.readStream.format("paged_reports").options(**options).load().writeStream.foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        if upto >= end:
            return


def reports_transform(stream: DataFrame) -> DataFrame:
    """Landed report pages -> clean reports (P1-P13, per micro-batch)."""
    raw = stream.select(F.explode("results").alias("r")).select("r.*")
    return normalize_reports(raw, dedup=False)


def ingest_report_pages(spark: SparkSession, landing: str, out_path: str, checkpoint: str,
                        max_files_per_trigger: int | None = None) -> None:
    """W1 + W2 + W3 for report pages."""
    ingest_files(spark, landing, RAW_PAGE, out_path, checkpoint, "id", "json",
                 reports_transform, max_files_per_trigger)
