"""Validation, reject reasons, the exact seeded split and split balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# ---- fixed values (must equal the reference's) ---------------------------------
MIN_NARRATIVE_LEN = 100
VALID_SERIOUSNESS = ["Serious", "Non-serious"]
VALID_WHO_UMC = ["Certain", "Probable/Likely", "Possible", "Unlikely",
                 "Conditional/Unclassified", "Unassessable"]
VALID_LABELLING = ["Expected", "Unexpected"]
TRAIN_RATIO_NUM, TRAIN_RATIO_DEN = 9, 10        # 0.90
SPLIT_SEED = 42
# --------------------------------------------------------------------------------


def _show(c: Column) -> Column:
    """How Python's f-string prints an optional string (None -> 'None')."""
    return F.coalesce(c, F.lit("None"))


def reject_reason() -> Column:
    """V1: first failing rule wins; null = valid."""
    n = F.coalesce(F.col("narrative"), F.lit(""))
    pt = F.coalesce(F.col("meddra_pt"), F.lit(""))
    return (F.when(F.length(n) < MIN_NARRATIVE_LEN,
                   F.concat(F.lit("Narrative too short ("), F.length(n).cast("string"), F.lit(" chars)")))
            .when(pt == "", F.lit("Missing meddra_pt"))
            .when(~F.coalesce(F.col("seriousness").isin(*VALID_SERIOUSNESS), F.lit(False)),
                  F.concat(F.lit("Invalid seriousness: "), _show(F.col("seriousness"))))
            .when(~F.coalesce(F.col("who_umc_category").isin(*VALID_WHO_UMC), F.lit(False)),
                  F.concat(F.lit("Invalid who_umc_category: "), _show(F.col("who_umc_category"))))
            .when(~F.coalesce(F.col("labelling_status").isin(*VALID_LABELLING), F.lit(False)),
                  F.concat(F.lit("Invalid labelling_status: "), _show(F.col("labelling_status")))))


def reason_code() -> Column:
    """Stable code next to the value-bearing reason text."""
    n = F.coalesce(F.col("narrative"), F.lit(""))
    pt = F.coalesce(F.col("meddra_pt"), F.lit(""))
    ok = lambda c, dom: F.coalesce(F.col(c).isin(*dom), F.lit(False))
    return (F.when(F.length(n) < MIN_NARRATIVE_LEN, "too_short").when(pt == "", "missing_pt")
            .when(~ok("seriousness", VALID_SERIOUSNESS), "bad_seriousness")
            .when(~ok("who_umc_category", VALID_WHO_UMC), "bad_causality")
            .when(~ok("labelling_status", VALID_LABELLING), "bad_labelling"))


def validate(cases: DataFrame) -> DataFrame:
    return cases.withColumn("reject_reason", reject_reason()).withColumn("reason_code", reason_code())


def valid_only(cases: DataFrame) -> DataFrame:
    """V2: rows passing every rule."""
    return validate(cases).where(F.col("reject_reason").isNull()).drop("reject_reason", "reason_code")


def reason_counts(cases: DataFrame) -> DataFrame:
    """V2: count per reason (reasons embed values, so one row per length)."""
    v = validate(cases).where(F.col("reject_reason").isNotNull())
    return v.groupBy("reject_reason", "reason_code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- split ----
_DIGITS, _LEVELS = 3, 3          # hex digits a level: 4,096 buckets, 6.9e10 after three


def exact_split(df: DataFrame, key: str = "id", seed: int = SPLIT_SEED) -> DataFrame:
    """V3: seeded shuffle + exact ``floor(n * 0.9)`` train rows.

    Order = (md5(seed:key), key).  Nothing is ranked as a whole: rows are
    counted by the leading hex digits of the hash, then, in the bucket that
    holds the cut, by the next digits, three times; only rows that share all
    nine digits with the cut are ranked.  Same result for any input order or
    partitioning."""
    x = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary")))
    total = x.agg(F.count(F.lit(1))).scalar()
    left = F.floor(total * TRAIN_RATIO_NUM / TRAIN_RATIO_DEN).cast("long")
    at = None
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)   # over <= 4096 rows
    for level in range(1, _LEVELS + 1):
        inside = x if at is None else x.where(F.substring("_h", 1, (level - 1) * _DIGITS) == at)
        counts = inside.groupBy(F.substring("_h", 1, level * _DIGITS).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.select("_b", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), left.alias("_left"))
        cut = cut_lineage(counts.where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_n")))
                          .select("_b", (F.col("_left") - F.col("_before")).alias("_rest")))   # one row
        at, left = cut.select("_b").scalar(), cut.select("_rest").scalar()
    p = F.substring("_h", 1, _LEVELS * _DIGITS)
    settled = x.withColumn("_c", F.coalesce(at, F.lit(""))).where(p != F.col("_c")) \
        .withColumn("split", F.when(p < F.col("_c"), "train").otherwise("val")).drop("_c")
    rank = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))
    ranked = x.withColumn("_c", p).where(F.col("_c") == at).withColumn("_r", rank).withColumn("_left", left) \
        .withColumn("split", F.when(F.col("_r") <= F.col("_left"), "train").otherwise("val"))
    return settled.unionByName(ranked.drop("_c", "_r", "_left")).drop("_h")


def hash_split(df: DataFrame, key: str = "id", seed: int = SPLIT_SEED, train_pct: int = 90) -> DataFrame:
    """V3, streaming-safe form: each row decides alone (about 90/10)."""
    return df.withColumn("split", F.when(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100)) < train_pct,
                                         "train").otherwise("val"))


def split_balance(df: DataFrame) -> DataFrame:
    """V4: share Serious and share Expected per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("seriousness") == "Serious").cast("int")).alias("share_serious"),
        F.avg((F.col("labelling_status") == "Expected").cast("int")).alias("share_expected"))


# V8: narrative QC flags (prose only in the reference)
TEMPORAL_RE = r"(?i)\b(after|following|days later|weeks? later|months? later)\b"


def narrative_qc(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.length("narrative")).alias("mean_len"),
        F.avg(F.col("narrative").rlike(TEMPORAL_RE).cast("int")).alias("share_temporal"),
        F.avg((F.coalesce(F.col("labelling_evidence"), F.lit("")) != "").cast("int")).alias("share_evidence"))
