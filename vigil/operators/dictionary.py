"""Terminology dictionary: three sheets (names, levels, edges) -> PT lookup.

Order semantics ("last row wins", "first SOC parent") are carried by the
explicit sheet position ``pos``; every step is a partial aggregate
(``max_by`` / ``min_by`` / ``count``), so a hub term with millions of
children costs one row per task in the shuffle, never one huge group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim


def term_names(names: DataFrame) -> DataFrame:
    """G1: id -> name, the last sheet row wins on duplicate ids."""
    return names.groupBy("term_id").agg(F.max_by("name", "pos").alias("name"))


def term_levels(levels: DataFrame) -> DataFrame:
    """Id -> level (last row wins); ``level_pos`` is the id's first
    position in the sheet, which is the order a dict keeps its keys in."""
    return levels.groupBy("term_id").agg(F.max_by("level", "pos").alias("level"),
                                         F.min("pos").alias("level_pos"))


def parent_summary(edges: DataFrame) -> DataFrame:
    """Child -> its parents in sheet order, as (count, first, last);
    the edge table itself is the ordered adjacency list."""
    return edges.groupBy("child_id").agg(
        F.count(F.lit(1)).alias("n_parents"),
        F.min_by("parent_id", "pos").alias("first_parent"),
        F.max_by("parent_id", "pos").alias("last_parent"))


def child_summary(edges: DataFrame) -> DataFrame:
    """The reverse direction (parent -> children)."""
    return edges.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("n_children"),
        F.min_by("child_id", "pos").alias("first_child"))


def level_counts(levels: DataFrame) -> DataFrame:
    """Number of ids per level."""
    return term_levels(levels).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def first_soc(edges: DataFrame, levels: DataFrame, names: DataFrame,
              resolved: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """For every child, its first parent (sheet order) whose level is SOC.
    ``resolved`` = (term_levels, term_names) when the caller has them."""
    lv, tn = resolved or (term_levels(levels), term_names(names))
    socs = lv.where(F.col("level") == "SOC").select(F.col("term_id").alias("parent_id"))
    hit = edges.join(socs, "parent_id", "left_semi")
    best = hit.groupBy("child_id").agg(F.min_by("parent_id", "pos").alias("soc_id"))
    nm = tn.select(F.col("term_id").alias("soc_id"), F.col("name").alias("soc_name"))
    return best.join(nm, "soc_id", "left").select("child_id", "soc_id",
                                                  F.coalesce(utrim("soc_name"), F.lit("")).alias("soc_name"))


def _pt_rows(names: DataFrame, levels: DataFrame, edges: DataFrame) -> DataFrame:
    tl, tn = term_levels(levels), term_names(names)       # each aggregated once
    lv = tl.where(F.col("level") == "PT")
    pts = lv.join(tn, "term_id", "left").select(
        "term_id", "level_pos", utrim(F.coalesce("name", F.lit(""))).alias("pt_name"))
    soc = first_soc(edges, levels, names, (tl, tn)).withColumnRenamed("child_id", "term_id")
    return pts.join(soc, "term_id", "left")


def build_lookup(names: DataFrame, levels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per lower-cased PT name.  Nameless PTs are skipped; LLT
    fields equal the PT fields; on equal keys the later PT (level order)
    wins, while the key keeps the position of its first PT (``key_pos``,
    the order used to break fuzzy-match ties)."""
    rows = _pt_rows(names, levels, edges).where(F.col("pt_name") != "")
    val = F.struct(F.col("pt_name").alias("meddra_pt"), F.col("term_id").alias("meddra_pt_code"),
                   F.col("soc_name").alias("meddra_soc"), F.col("soc_id").alias("meddra_soc_code"))
    g = rows.groupBy(F.lower("pt_name").alias("pt_key")).agg(
        F.max_by(val, "level_pos").alias("v"), F.min("level_pos").alias("key_pos"))
    return g.select("pt_key", "key_pos",
                    F.col("v.meddra_pt").alias("meddra_pt"), F.col("v.meddra_pt_code").alias("meddra_pt_code"),
                    F.col("v.meddra_pt").alias("meddra_llt"), F.col("v.meddra_pt_code").alias("meddra_llt_code"),
                    F.coalesce(F.col("v.meddra_soc"), F.lit("")).alias("meddra_soc"),
                    F.col("v.meddra_soc_code").alias("meddra_soc_code"))


def coverage(names: DataFrame, levels: DataFrame, edges: DataFrame) -> DataFrame:
    """G8 + G9: PTs, PTs skipped for having no name, PTs with a SOC parent."""
    rows = _pt_rows(names, levels, edges)
    return rows.agg(F.count(F.lit(1)).alias("n_pt"),
                    F.count_if(F.col("pt_name") == "").alias("n_skipped"),
                    F.count_if(F.col("soc_id").isNotNull()).alias("n_with_soc"),
                    (F.count_if(F.col("soc_id").isNotNull()).cast("double")
                     / F.count(F.lit(1)).cast("double")).alias("soc_share"))
