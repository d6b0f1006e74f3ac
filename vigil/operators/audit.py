"""Audit of two dictionary versions: what changed, where replaced codes lead, which records are touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import followed


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(code, change, old_name, new_name, old_soc, new_soc) of a null-safe full outer join of two versions (code, name, soc).

    ``added``, ``removed``, ``renamed``, ``moved`` (other organ class), ``renamed+moved``, ``unchanged``; null equals null."""
    o = old.select(F.col("code").alias("o_code"), F.col("name").alias("old_name"), F.col("soc").alias("old_soc"), F.lit(True).alias("in_old"))
    n = new.select(F.col("code").alias("n_code"), F.col("name").alias("new_name"), F.col("soc").alias("new_soc"), F.lit(True).alias("in_new"))
    j = o.join(n, F.col("o_code").eqNullSafe(F.col("n_code")), "full_outer")
    renamed, moved = ~F.col("old_name").eqNullSafe(F.col("new_name")), ~F.col("old_soc").eqNullSafe(F.col("new_soc"))
    change = (F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(renamed & moved, "renamed+moved")
              .when(renamed, "renamed").when(moved, "moved").otherwise("unchanged"))
    return j.select(F.coalesce("o_code", "n_code").alias("code"), change.alias("change"), "old_name", "new_name", "old_soc", "new_soc")


def audit(old: DataFrame, new: DataFrame, replaced: DataFrame, records: DataFrame, record_code: str) -> DataFrame:
    """``changes`` with ``final_code``, ``hops`` and ``in_cycle`` of the codes that ``replaced`` (code, new_code) leads on,
    ``final_exists`` (the end is in the new version), and ``n_records``, the records that bear the code."""
    chains = followed(replaced).select("code", F.col("end").alias("final_code"), "hops", F.col("cycle").alias("in_cycle"))
    there = new.select(F.col("code").alias("final_code"), F.lit(True).alias("there")).where("final_code is not null")
    counts = records.groupBy(F.col(record_code).alias("code")).agg(F.count(F.lit(1)).alias("n_records"))
    out = changes(old, new).join(chains.join(there, "final_code", "left"), "code", "left")
    out = out.join(counts.withColumnRenamed("code", "r_code"), F.col("code").eqNullSafe(F.col("r_code")), "left").drop("r_code")
    return out.select("code", "change", "old_name", "new_name", "old_soc", "new_soc", "final_code", "hops", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
                      F.when(F.col("final_code").isNotNull(), F.coalesce("there", F.lit(False))).alias("final_exists"),
                      F.coalesce("n_records", F.lit(0)).cast("long").alias("n_records"))


def recode(records: DataFrame, record_code: str, audited: DataFrame) -> DataFrame:
    """Records whose code was replaced by one that the new version has get that code (``new_code``); others keep theirs."""
    to = audited.where("change = 'removed' and final_exists").select(F.col("code").alias(record_code), F.col("final_code").alias("_to"))
    return records.join(to, record_code, "left").withColumn("new_code", F.coalesce("_to", record_code)).drop("_to")
