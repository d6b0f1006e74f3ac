"""Evaluation of predictions against gold: per-record matches, counters,
rates, running counters and base-vs-tuned comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ci_equal, null_safe_equal

FIELDS = [  # (result name, json key, comparison)
    ("seriousness", "seriousness", "exact"),
    ("labelling", "labelling_status", "exact"),
    ("meddra_pt", "meddra_pt", "ci"),
    ("meddra_soc", "meddra_soc", "ci"),
]


def score_pairs(pairs: DataFrame) -> DataFrame:
    """J9 + A13 + D13: pairs(index, parse_ok, narrative, pred_<k>, gold_<k>)
    -> per-record pred/gold/match structs and ``all_match``.  Records with a
    parse failure keep ``parse_ok = false`` and null matches."""
    cols = [F.col("index"), F.col("parse_ok"),
            F.when(~F.col("parse_ok"), F.substring("narrative", 1, 80)).alias("narrative")]
    matches = []
    for name, key, how in FIELDS:
        p, g = F.col(f"pred_{key}"), F.col(f"gold_{key}")
        m = null_safe_equal(p, g) if how == "exact" else ci_equal(p, g)
        m = F.when(F.col("parse_ok"), m)
        matches.append(m)
        cols.append(F.when(F.col("parse_ok"), F.struct(p.alias("pred"), g.alias("gold"), m.alias("match")))
                    .alias(name))
    all_m = matches[0]
    for m in matches[1:]:
        all_m = all_m & m
    cols.append(all_m.alias("all_match"))
    return pairs.select(*cols)


def counters(scored: DataFrame, group: str | None = None) -> DataFrame:
    """Total, parsed, four field matches, all-field matches (one agg)."""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if("parse_ok").alias("json_parse_ok"),
            F.count_if(F.col("seriousness.match")).alias("seriousness_match"),
            F.count_if(F.col("labelling.match")).alias("labelling_match"),
            F.count_if(F.col("meddra_pt.match")).alias("meddra_pt_match"),
            F.count_if(F.col("meddra_soc.match")).alias("meddra_soc_match"),
            F.count_if("all_match").alias("all_fields_match")]
    return scored.groupBy(group).agg(*aggs) if group else scored.agg(*aggs)


def rates(cnt: DataFrame) -> DataFrame:
    """A14 + A15: parse rate over the total, accuracies over parsed records
    (``or 1`` guard), in percent; null when there is no record.  Raw ratios;
    format last (Spark rounds half-up, Python half-even)."""
    p = F.greatest(F.col("json_parse_ok"), F.lit(1)).cast("double")
    n = F.col("total").cast("double")
    pct = lambda num, den: F.when(F.col("total") > 0, F.col(num).cast("double") * 100.0 / den)
    keep = [c for c in cnt.columns if c not in (
        "total", "json_parse_ok", "seriousness_match", "labelling_match", "meddra_pt_match",
        "meddra_soc_match", "all_fields_match")]
    return cnt.select(*keep, "total", "json_parse_ok",
                      pct("json_parse_ok", n).alias("parse_rate"),
                      pct("seriousness_match", p).alias("seriousness_acc"),
                      pct("meddra_pt_match", p).alias("meddra_pt_acc"),
                      pct("meddra_soc_match", p).alias("meddra_soc_acc"),
                      pct("labelling_match", p).alias("labelling_acc"),
                      pct("all_fields_match", p).alias("all_fields_acc"))


def running_totals(df: DataFrame, order_col: str, value_cols: list[str], block: int | None = None) -> DataFrame:
    """Cumulative sums in ``order_col`` order without one global window:
    block totals get prefix offsets, then each block runs its own window.
    The block size defaults to sqrt(max index) (at least 10,000), so both the
    offset window (one row per block) and every block window hold about
    sqrt(n) rows.  ``order_col`` must be a non-negative integer."""
    if block is None:
        import math
        top = df.agg(F.max(order_col)).first()[0] or 0
        block = max(10_000, math.isqrt(int(top) + 1) + 1)
    b = F.floor(F.col(order_col) / block)
    x = df.withColumn("_blk", b)
    tot = x.groupBy("_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    w_prev = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_blk", *[F.coalesce(F.sum(f"_t_{c}").over(w_prev), F.lit(0)).alias(f"_o_{c}")
                                for c in value_cols])
    w_in = Window.partitionBy("_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(offs, "_blk")
    for c in value_cols:
        x = x.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(w_in))
    return x.drop("_blk", *[f"_o_{c}" for c in value_cols])


def running_log(scored: DataFrame) -> DataFrame:
    """Running counters printed every 10th record; a parse failure at
    such a record skips the line (the reference ``continue``s first)."""
    x = scored.select("index", "parse_ok",
                      F.lit(1).alias("one"),
                      F.coalesce(F.col("seriousness.match"), F.lit(False)).cast("int").alias("s"),
                      F.coalesce(F.col("labelling.match"), F.lit(False)).cast("int").alias("l"),
                      F.coalesce(F.col("meddra_pt.match"), F.lit(False)).cast("int").alias("pt"))
    r = running_totals(x, "index", ["one", "s", "l", "pt"])
    return r.where(((F.col("index") + 1) % 10 == 0) & F.col("parse_ok")).select(
        "index", F.col("cum_one").alias("evaluated"), F.col("cum_s").alias("seriousness_match"),
        F.col("cum_l").alias("labelling_match"), F.col("cum_pt").alias("meddra_pt_match"))


METRICS = ["parse_rate", "seriousness_acc", "meddra_pt_acc", "meddra_soc_acc", "labelling_acc",
           "all_fields_acc"]


def compare_modes(rates_by_mode: DataFrame, base: str = "base", tuned: str = "tuned") -> DataFrame:
    """A19 + A20: metric rows, one column per mode, delta in points; plus the
    mean of the four field accuracies as its own metric."""
    with_mean = rates_by_mode.withColumn(
        "mean_field_acc", (F.col("seriousness_acc") + F.col("meddra_pt_acc") + F.col("meddra_soc_acc")
                           + F.col("labelling_acc")) / 4.0)
    long = with_mean.unpivot("mode", METRICS + ["mean_field_acc"], "metric", "value")
    wide = long.groupBy("metric").pivot("mode", [base, tuned]).agg(F.first("value"))
    return wide.select("metric", F.col(base).alias("base"), F.col(tuned).alias("tuned"),
                       (F.col(tuned) - F.col(base)).alias("delta_pts"))


def _bucket(score: str, buckets: int) -> Column:
    """Null for a missing score (``least`` alone would take the bound for it)."""
    return F.when(F.col(score).isNotNull(), F.least(F.floor(F.col(score) * buckets), F.lit(buckets - 1)))


def risk_coverage(df: DataFrame, score: str, correct: str, buckets: int = 1000) -> DataFrame:
    """(bucket, n, errors, covered, wrong, coverage, risk): what share of all rows stands in a score bucket or a higher one
    and what share of these is wrong.  Scores are in 0 to 1; rows without one are never covered but count as rows.

    The rows are counted by bucket first; only that table, of fixed size, is put in order."""
    at = _bucket(score, buckets)
    wrong = F.count_if(~F.coalesce(F.col(correct), F.lit(False)))
    per = df.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), wrong.alias("errors"))
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last("bucket"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    curve = per.withColumns({"total": total, "covered": F.sum("n").over(down), "wrong": F.sum("errors").over(down)}).where("bucket is not null")
    return curve.select("bucket", "n", "errors", "covered", "wrong", (F.col("covered") / F.col("total")).alias("coverage"),
                        (F.col("wrong") / F.col("covered")).alias("risk"))


def route(df: DataFrame, score: str, correct: str, max_risk_pct: int, buckets: int = 1000) -> DataFrame:
    """Adds ``route``: ``auto`` for the largest share of rows, taken from the highest score down, of which ``max_risk_pct`` %
    at most are wrong, ``review`` for the rest (all, if there is no such share) and for rows without a score."""
    curve = risk_coverage(df, score, correct, buckets)
    cut = curve.where(F.col("wrong") * 100 <= F.col("covered") * max_risk_pct).agg(F.min("bucket")).scalar()
    at = _bucket(score, buckets)
    return df.withColumn("route", F.when(F.coalesce(at >= cut, F.lit(False)), "auto").otherwise("review"))
