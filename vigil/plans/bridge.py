"""Test-table bridge: derive safety reports, a terminology dictionary and
product labels from the driver's TPC-H-like tables (SURVEY §7.2).

The per-row derivations are SQL expression strings so the DuckDB oracle can
repeat them exactly; everything structural (joins, aggregations, the
operators under test) is written independently on each side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# ---------------------------------------------------------------- reports ----
# Report header: orders (+ customer as the patient).
HEADER_EXPRS = {
    "safetyreportid": "CAST(o_orderkey AS STRING)",
    "serious": ("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '1' "
                "WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE '2' END"),
    "seriousnessdeath": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 11 = 0 THEN '1' END",
    "seriousnesslifethreatening": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 7 = 0 THEN '1' END",
    "seriousnesshospitalization": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 = 0 THEN '1' ELSE '2' END",
    "seriousnessdisabling": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 13 = 0 THEN '1' END",
    # independent of `serious` on purpose (the two fields are not tied together)
    "seriousnesscongeni": "CASE WHEN o_orderkey % 17 = 0 THEN '1' END",
    "seriousnessother": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 2 = 0 THEN '1' END",
    "narrativeincludeclinical": ("CASE WHEN o_orderkey % 4 = 0 THEN ' Patient ' || CAST(o_custkey AS STRING) "
                                 "|| ' reported a ' || lower(o_orderstatus) || ' case. ' END"),
    "patientonsetage": "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE CAST(c_custkey % 90 AS STRING) END",
    "patientsex": "CAST(c_nationkey % 3 AS STRING)",
}

# One order line = one reaction entry and one drug entry.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
REACTION_EXPRS = {
    "reactionmeddrapt": (
        "CASE WHEN l_partkey % 89 = 0 THEN ' ' || chr(9) || ' ' "
        "WHEN l_partkey % 53 = 0 THEN 'zq' || CAST(l_partkey AS STRING) "
        "WHEN l_partkey % 13 = 2 THEN substr(p_name, 1, length(p_name) - 1) "
        "WHEN l_partkey % 7 = 0 THEN upper(p_name) "
        "WHEN l_partkey % 7 = 1 THEN '  ' || p_name || ' ' "
        "ELSE p_name END"),
    "reactionoutcome": ("CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL "
                        "ELSE CAST((l_orderkey + l_linenumber) % 7 AS STRING) END"),
}
DRUG_EXPRS = {
    "medicinalproduct": "CASE WHEN l_partkey % 97 = 0 THEN '' ELSE p_brand END",
    "drugcharacterization": "CASE l_returnflag WHEN 'A' THEN '1' WHEN 'R' THEN '2' ELSE '3' END",
    "drugadditional": "CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey % 5 AS STRING) END",
    "drugrecurrence": "CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE CAST(l_suppkey % 3 AS STRING) END",
    "drugdosagetext": "CAST(CAST(l_quantity AS BIGINT) AS STRING) || ' mg'",
    "drugindication": "CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE lower(p_type) END",
}


FACT_TABLES = {"lineitem", "orders"}


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, name, *columns, fact=name in FACT_TABLES)


def report_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header row per order: top-level report fields + patient fields."""
    orders = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cust = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    j = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    return j.select(F.col("o_orderkey").alias("report_key"),
                    *[F.expr(e).alias(n) for n, e in HEADER_EXPRS.items()])


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with a unique in-report position key."""
    li = _read(spark, sf_dir, "lineitem", 
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate")
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    return j.select(F.col("l_orderkey").alias("report_key"),
                    F.struct(*LINE_ORDER).alias("pos"),
                    *[F.expr(e).alias(n) for n, e in {**REACTION_EXPRS, **DRUG_EXPRS}.items()])


def raw_reports_nested(spark: SparkSession, sf_dir: str, page: Column | None = None, wanted: Column | None = None) -> DataFrame:
    """Nested D1 reports, as a landed JSON page would deliver them.  Used to
    write landing pages; the registered queries use the flat form (``report_headers`` / ``report_lines``).

    With ``page``, an expression over ``report_key``, they have it as ``at``, and only those ``wanted`` by it are made: lines
    and headers are dealt by page, and under ``partitions_kept`` a page's rows then stay where they are."""
    def by_page(df: DataFrame) -> DataFrame:
        return df if page is None else df.withColumn("at", page).where(wanted).repartition("at")

    at = [] if page is None else ["at"]
    lines = by_page(report_lines(spark, sf_dir))
    per = lines.groupBy(*at, "report_key").agg(F.sort_array(F.collect_list(F.struct(
        "pos", F.struct(*REACTION_EXPRS).alias("r"), F.struct(*DRUG_EXPRS).alias("d")))).alias("items"))
    per = per.select(*at, "report_key",
                     F.transform("items", lambda x: x["r"]).alias("reaction"),
                     F.transform("items", lambda x: x["d"]).alias("drug"))
    j = by_page(report_headers(spark, sf_dir)).join(per, [*at, "report_key"], "left")
    return j.select(*at, *[c for c in HEADER_EXPRS if not c.startswith("patient")],
                    F.struct("patientonsetage", "patientsex", "reaction", "drug").alias("patient"))


# ------------------------------------------------------------- dictionary ----
# Terms: one PT per distinct part name, one SOC per region, one HLT per part
# type, one LLT per part (so the dictionary grows with `part`).
PT_BASE, SOC_BASE, HLT_BASE, LLT_BASE = 10_000_000, 20_000_000, 30_000_000, 40_000_000


def dictionary_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, levels, edges) sheets with explicit sheet positions."""
    part = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type")
    region = _read(spark, sf_dir, "region", "r_regionkey", "r_name")
    # one aggregation per key, shared by the names, levels and edges sheets
    by_name = part.groupBy("p_name").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("t"))
    by_type = part.groupBy("p_type").agg(F.min("p_partkey").alias("hk"))
    pts = by_name.select((F.lit(PT_BASE) + F.col("k")).alias("term_id"), F.col("p_name").alias("name"))
    hlts = by_type.select((F.lit(HLT_BASE) + F.col("hk")).alias("term_id"),
                          F.concat(F.lower("p_type"), F.lit(" conditions")).alias("name"))
    socs = region.select((F.lit(SOC_BASE) + F.col("r_regionkey")).alias("term_id"),
                         F.concat(F.lower("r_name"), F.lit(" disorders")).alias("name"))
    llts = part.select((F.lit(LLT_BASE) + F.col("p_partkey")).alias("term_id"),
                       F.concat("p_name", F.lit(" nos")).alias("name"), "p_name")

    # Names sheet: every term once at pos = 2*id+1; every third PT also has an
    # earlier all-caps row (pos = 2*id) that the later row overrides.
    names = (pts.select("term_id", "name", (F.col("term_id") * 2 + 1).alias("pos"))
             .unionByName(pts.where(F.col("term_id") % 3 == 0)
                          .select("term_id", F.upper("name").alias("name"), (F.col("term_id") * 2).alias("pos")))
             .unionByName(hlts.select("term_id", "name", (F.col("term_id") * 2 + 1).alias("pos")))
             .unionByName(socs.select("term_id", "name", (F.col("term_id") * 2 + 1).alias("pos")))
             .unionByName(llts.select("term_id", "name", (F.col("term_id") * 2 + 1).alias("pos"))))

    levels = (pts.select("term_id", F.lit("PT").alias("level"))
              .unionByName(hlts.select("term_id", F.lit("HLT").alias("level")))
              .unionByName(socs.select("term_id", F.lit("SOC").alias("level")))
              .unionByName(llts.select("term_id", F.lit("LLT").alias("level")))
              .withColumn("pos", F.col("term_id")))

    # Edges (child -> parent).  Slots fix the sheet order within a child:
    #   PT: HLT at slot 1, primary SOC at slot 2, secondary SOC at slot 3 for
    #   even-length names; names with length % 7 = 0 list the secondary SOC
    #   first (slot 0); names with length % 11 = 0 have no SOC parent.
    ptp = by_name.join(by_type, by_name.t == by_type.p_type, "left").select(
        (F.lit(PT_BASE) + F.col("k")).alias("child_id"), F.length("p_name").alias("len"),
        (F.lit(HLT_BASE) + F.col("hk")).alias("hlt_id"))
    e_hlt = ptp.select("child_id", F.col("hlt_id").alias("parent_id"), F.lit(1).alias("slot"))
    with_soc = ptp.where(F.col("len") % 11 != 0)
    e_soc1 = with_soc.select("child_id", (F.lit(SOC_BASE) + F.col("len") % 5).alias("parent_id"),
                             F.lit(2).alias("slot"))
    e_soc2 = with_soc.where((F.col("len") % 2 == 0) | (F.col("len") % 7 == 0)).select(
        "child_id", (F.lit(SOC_BASE) + (F.col("len") + 1) % 5).alias("parent_id"),
        F.when(F.col("len") % 7 == 0, 0).otherwise(3).alias("slot"))
    e_llt = llts.join(pts.withColumnRenamed("term_id", "parent_id").withColumnRenamed("name", "p_name"), "p_name") \
        .select(F.col("term_id").alias("child_id"), "parent_id", F.lit(0).alias("slot"))
    edges = (e_hlt.unionByName(e_soc1).unionByName(e_soc2).unionByName(e_llt)
             .select("child_id", "parent_id", (F.col("child_id") * 4 + F.col("slot")).alias("pos")))
    return names, levels, edges


# ----------------------------------------------------------------- labels ----
# Label documents keyed by brand number b (from 'Brand#b'):
#   b % 8 = 0: substance key only; 4: no label; b % 4 = 1: brand key with adverse-reaction text;
#   2: generic key only; 3: brand row with warnings only + generic row with
#   adverse-reaction text (the brand hit must win: cascade order).
# Adverse text = sentences naming every distinct part name with
# (length(name) + b) % 3 = 0.  For b % 8 = 5 they stand behind more text than a
# prompt excerpt holds, for b % 8 = 1 with line breaks inside the sentences.
LONG_LEAD = "Problème général : voir la notice. " * 80

def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part", "p_brand", "p_name")
    brands = part.select("p_brand").distinct().select(
        "p_brand", F.expr("CAST(substr(p_brand, 7) AS INT)").alias("b"))
    names = part.select("p_name").distinct()
    # (length(name) + b) % 3 = 0  <=>  length(name) % 3 = (3 - b % 3) % 3:
    # an equi-join on the residue, not a theta join.
    brands = brands.withColumn("res", (3 - F.col("b") % 3) % 3)
    names = names.withColumn("res", F.length("p_name") % 3)
    mention = (brands.join(names, "res", "inner")
               .groupBy("p_brand", "b")
               .agg(F.array_join(F.array_sort(F.collect_list(F.concat(
                   F.lit("Reports of "), F.lower("p_name"), F.lit(" were observed in clinical trials.")))),
                   " ").alias("adr")))
    b = mention.withColumn("adr", F.when(F.col("b") % 8 == 5, F.concat(F.lit(LONG_LEAD), "adr"))
                           .when(F.col("b") % 8 == 1, F.replace("adr", F.lit(" were "), F.lit("\nwere "))).otherwise(F.col("adr")))
    adr_arr = F.array(F.col("adr"))
    warn_arr = F.array(F.concat(F.lit("Use caution when prescribing "), F.col("p_brand"), F.lit(".")))
    empty = F.array().cast("array<string>")
    brand_adr = b.where(F.col("b") % 4 == 1).select(
        F.lit("brand").alias("key_type"), F.col("p_brand").alias("key"),
        adr_arr.alias("adverse_reactions"), empty.alias("warnings_and_cautions"),
        F.lit(None).cast("array<string>").alias("warnings"), (F.col("b") * 10).alias("pos"))
    generic_only = b.where(F.col("b") % 4 == 2).select(
        F.lit("generic").alias("key_type"), F.col("p_brand").alias("key"),
        adr_arr.alias("adverse_reactions"), empty.alias("warnings_and_cautions"),
        F.lit(None).cast("array<string>").alias("warnings"), (F.col("b") * 10 + 1).alias("pos"))
    brand_warn = b.where(F.col("b") % 4 == 3).select(
        F.lit("brand").alias("key_type"), F.col("p_brand").alias("key"),
        empty.alias("adverse_reactions"), warn_arr.alias("warnings_and_cautions"),
        F.lit(None).cast("array<string>").alias("warnings"), (F.col("b") * 10 + 2).alias("pos"))
    substance = b.where(F.col("b") % 8 == 0).select(
        F.lit("substance").alias("key_type"), F.col("p_brand").alias("key"),
        adr_arr.alias("adverse_reactions"), empty.alias("warnings_and_cautions"),
        F.lit(None).cast("array<string>").alias("warnings"), (F.col("b") * 10 + 4).alias("pos"))
    generic_adr = b.where(F.col("b") % 4 == 3).select(
        F.lit("generic").alias("key_type"), F.col("p_brand").alias("key"),
        adr_arr.alias("adverse_reactions"), empty.alias("warnings_and_cautions"),
        F.lit(None).cast("array<string>").alias("warnings"), (F.col("b") * 10 + 3).alias("pos"))
    return brand_adr.unionByName(generic_only).unionByName(brand_warn).unionByName(generic_adr).unionByName(substance)
