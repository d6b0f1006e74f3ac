"""Incremental case build (W2): landed report pages through coding, labelling and validation, batch by batch.

Each micro-batch writes two tables, ``cases`` and ``rejects``, below ``run=<id>/epoch=<n>``, and last of all a row in
``ledger``.  Readers see only epochs that the ledger has, so the two outputs appear together or not at all.  A batch
replayed after a failure overwrites its own epoch; reports that an earlier committed epoch has taken, as
case or as reject, are left out, so every report id ends in one output once.

Rejects carry the step that refused them and its reason: ``normalise`` (required fields), ``code`` (no dictionary term),
``validate`` (the validation's reason).  Reports of drugs without label text fail validation here: class-level evidence
needs the counts of all reports, which a batch doesn't have.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import casebuild as CB
from ..operators import coding as C
from ..operators import labels as L
from ..operators import normalize as N
from ..operators import quality as Q
from ..schemas import RAW_PAGE
from ..session import path_exists, staged
from .ingest import run_id

LEDGER = "run string, epoch long, n_cases long, n_rejects long"


@dataclass(frozen=True)
class References:
    """The tables that batches are joined with: dictionary lookup, and label text of every drug."""

    lookup: DataFrame
    labels: DataFrame
    scorer: str = "levenshtein"


def build(raw: DataFrame, refs: References) -> tuple[DataFrame, DataFrame]:
    """Valid cases, and rejects (id, step, reason), of raw reports with unique ids."""
    refused = N.report_rejects(raw).select("id", F.lit("normalise").alias("step"), F.col("reject_reason").alias("reason"))
    clean = staged(N.normalize_reports(raw, dedup=False), "batch-clean")
    coded = staged(C.code_terms(clean, refs.lookup, scorer=refs.scorer), "batch-coded")
    uncoded = coded.where("meddra_pt is null").select("id", F.lit("code").alias("step"), F.lit("no dictionary term").alias("reason"))
    fields = CB.prompt_fields(L.assess(C.drop_unmatched(coded), refs.labels))
    checked = Q.validate(CB.assemble_cases(fields.withColumn("narrative_raw", CB.template_narrative())))
    checked = staged(checked, "batch-checked")
    invalid = checked.where("reject_reason is not null").select("id", F.lit("validate").alias("step"), F.col("reject_reason").alias("reason"))
    return checked.where("reject_reason is null").drop("reject_reason", "reason_code"), refused.unionByName(uncoded).unionByName(invalid)


def _at(out_path: str, table: str, run: str, epoch: int) -> str:
    return f"{out_path.rstrip('/')}/{table}/run={run}/epoch={epoch}"


def ledger(spark: SparkSession, out_path: str) -> DataFrame:
    """(run, epoch, n_cases, n_rejects) of the committed batches."""
    path = f"{out_path.rstrip('/')}/ledger"
    return spark.read.schema(LEDGER).option("basePath", path).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], LEDGER)


def committed(spark: SparkSession, out_path: str, table: str) -> DataFrame:
    """All rows of ``table`` that committed batches have written."""
    path = f"{out_path.rstrip('/')}/{table}"
    done = F.broadcast(ledger(spark, out_path).select("run", "epoch"))  # a row for each micro-batch
    return spark.read.option("basePath", path).parquet(path).withColumn("epoch", F.col("epoch").cast("long")).join(done, ["run", "epoch"], "left_semi")


def _taken(spark: SparkSession, out_path: str, run: str, epoch: int) -> DataFrame | None:
    if ledger(spark, out_path).where((F.col("run") != run) | (F.col("epoch") != epoch)).isEmpty():
        return None
    both = [committed(spark, out_path, t) for t in ("cases", "rejects")]
    return reduce_union([t.where((F.col("run") != run) | (F.col("epoch") != epoch)).select("id") for t in both])


def reduce_union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def commit_batch(raw: DataFrame, epoch: int, out_path: str, run: str, refs: References, before_commit: Callable[[], None] = lambda: None) -> None:
    """One micro-batch: both tables, then the ledger.  ``before_commit`` is a hook for tests of a crash between them."""
    spark = raw.sparkSession
    taken = _taken(spark, out_path, run, epoch)
    fresh = raw.dropDuplicates(["safetyreportid"])
    if taken is not None:
        fresh = fresh.join(taken, F.coalesce("safetyreportid", F.lit("")) == F.col("id"), "left_anti")
    cases, rejects = build(staged(fresh, "batch"), refs)
    cases.write.mode("overwrite").parquet(_at(out_path, "cases", run, epoch))
    rejects.write.mode("overwrite").parquet(_at(out_path, "rejects", run, epoch))
    n = [spark.read.parquet(_at(out_path, t, run, epoch)).count() for t in ("cases", "rejects")]
    before_commit()
    spark.createDataFrame([tuple(n)], "n_cases long, n_rejects long").coalesce(1).write.mode("overwrite").parquet(_at(out_path, "ledger", run, epoch))


def build_cases(spark: SparkSession, landing: str, out_path: str, checkpoint: str, refs: References, max_files_per_trigger: int = 1000) -> None:
    """Every landed page once, ``max_files_per_trigger`` pages a micro-batch; returns when the backlog is done."""
    run = run_id(spark, checkpoint)
    pages = spark.readStream.schema(RAW_PAGE).option("multiLine", True).option("maxFilesPerTrigger", max_files_per_trigger).json(landing)
    raw = pages.select(F.explode("results").alias("r")).select("r.*")
    q = (raw.writeStream.foreachBatch(lambda b, e: commit_batch(b, e, out_path, run, refs))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
