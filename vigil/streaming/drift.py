"""Drift of an output's distribution: event-time windows counted as a stream, neighbouring windows compared.

``window_counts`` counts values in tumbling windows under a watermark: a window is told once, when no row for it can
come any more, and its state is dropped.  ``divergence`` compares each window with the one right before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, time: str, value: str, length: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(window_start, window_end, value, n) of closed windows; a null value counts as ``(none)``; rows without a time don't count."""
    at = F.col(time).cast("timestamp")
    rows = stream.where(F.col(time).isNotNull()).select(at.alias("at"), F.coalesce(F.col(value).cast("string"), F.lit("(none)")).alias("value"))
    out = rows.withWatermark("at", delay).groupBy(F.window("at", length).alias("w"), "value").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value", "n")


def divergence(counts: DataFrame, limit: float = 0.05) -> DataFrame:
    """Each window against its left neighbour: rows of both, Jensen-Shannon divergence (nats, 0 to ln 2) and total
    variation of the value shares, and whether the divergence exceeds ``limit``.  A window without a neighbour has nulls."""
    totals = counts.groupBy("window_start", "window_end").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, ["window_start", "window_end"]).select("window_start", "window_end", "value", (F.col("n") / F.col("total")).alias("share"))
    pairs = totals.select("window_start", "window_end", F.col("total").alias("n")).join(
        totals.select(F.col("window_end").alias("window_start"), F.col("total").alias("n_before")), "window_start")
    # values of either window, under the later window's start
    now = shares.select("window_start", "value", F.col("share").alias("q"), F.lit(0.0).alias("p"))
    before = shares.select(F.col("window_end").alias("window_start"), "value", F.lit(0.0).alias("q"), F.col("share").alias("p"))
    both = now.unionByName(before).groupBy("window_start", "value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2
    part = F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)
    scored = both.groupBy("window_start").agg((F.sum(part) / 2).alias("js"), (F.sum(F.abs(p - q)) / 2).alias("variation"))
    out = totals.select("window_start", "window_end", F.col("total").alias("n")).join(pairs.select("window_start", "n_before"), "window_start", "left") \
        .join(scored, "window_start", "left")
    known = F.col("n_before").isNotNull()
    return out.select("window_start", "window_end", "n", "n_before", F.when(known, F.col("js")).alias("js"), F.when(known, F.col("variation")).alias("variation"),
                      F.coalesce(known & (F.col("js") > limit), F.lit(False)).alias("drifted"))
