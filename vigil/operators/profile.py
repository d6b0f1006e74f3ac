"""Profiles over a table: counts, shares, value counts, top-k, describe."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged


def value_counts(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A3: full value counts (``groupBy.count``; partial aggregation map-side)."""
    return df.groupBy(F.col(col).alias(name or col)).agg(F.count(F.lit(1)).alias("n"))


def optional_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of those columns that the table has, in one pass; a table with none of them gives no rows."""
    have = [c for c in columns if c in df.columns]
    if not have:
        return df.sparkSession.createDataFrame([], "field string, value string, n bigint")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in have)))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def over_limits(df: DataFrame, col: str, limits: list[int]) -> DataFrame:
    """How many values lie over each limit and their share of all values; nulls count as neither, the share of none is null."""
    over = [x for n in limits for x in (F.count_if(F.col(col) > n).alias(f"over_{n}"),
                                        (F.count_if(F.col(col) > n).cast("double") / F.nullif(F.count(col), F.lit(0)).cast("double")).alias(f"share_{n}"))]
    return df.agg(F.count(col).alias("n"), *over)


def distribution(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A5: counts with share of the total.  The total is a scalar subquery
    (one partial-aggregated row), not an un-partitioned window over all rows."""
    vc = value_counts(df, col, name)
    total = vc.agg(F.sum("n")).scalar()
    return vc.select(name or col, "n", (F.col("n").cast("double") / total.cast("double")).alias("share"))


def top_k(df: DataFrame, col: str, k: int, name: str | None = None) -> DataFrame:
    """A2: the k most frequent values, ties broken by the value (a top-k
    report: the limit is the feature).  Spark plans TakeOrderedAndProject,
    a per-partition top-k followed by a k-row merge."""
    c = name or col
    return value_counts(df, col, c).orderBy(F.desc("n"), F.asc(c)).limit(k)


def unnest_counts(df: DataFrame, col: str, name: str) -> DataFrame:
    """A4: explode an array column and count its elements."""
    return df.select(F.explode(col).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


SLICES = 1024  # value ranges that one pass counts


def order_statistics(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """The values at these ranks (from 0) of a numeric column without nulls, exactly.

    One pass counts the rows in ``SLICES`` equal ranges between the smallest and largest value; the range that holds a rank
    is cut again, between the smallest and largest value that stand in it, until all values in it are equal.  A pass
    moves ``SLICES`` partial counts a task for each range, never the values, and a handful of passes do for doubles."""
    x = F.col(col)
    low, high = df.agg(F.min(x), F.max(x)).first()
    spans = {r: (low, high, 0) for r in ranks}  # lowest and highest value in question, rows below
    while open_spans := sorted({s for s in spans.values() if s[0] < s[1]}):
        at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi, _) in enumerate(open_spans)]))
        rows = df.select(x.alias("x"), at.alias("s")).where("x >= s.lo and x <= s.hi")
        piece = F.least(F.floor((F.col("x") - F.col("s.lo")) / (F.col("s.hi") - F.col("s.lo")) * SLICES), F.lit(SLICES - 1))
        found = rows.groupBy(F.col("s.i").alias("i"), piece.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        parts: dict[int, list] = {}
        for row in found.orderBy("i", "k").collect():  # at most SLICES rows a range
            parts.setdefault(row.i, []).append(row)
        for rank, span in spans.items():
            if span[0] < span[1]:
                below = span[2]
                for row in parts[open_spans.index(span)]:
                    if rank < below + row.n:
                        spans[rank] = (row.lo, row.hi, below)
                        break
                    below += row.n
    return {r: s[0] for r, s in spans.items()}


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; null for a column without values."""
    own = staged(df.select(F.col(col).cast("double").alias("x")).where("x is not null"), "values")
    n = own.count()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * s for s in shares]
    at = order_statistics(own, "x", sorted({r for p in places for r in (math.floor(p), math.ceil(p))}))
    return [at[math.floor(p)] + (at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) for p in places]


def describe_exact(df: DataFrame, col: str, digits: int = 0) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear
    interpolation), max; half-even rounding like pandas ``round``."""
    x = F.col(col).cast("double")
    q = [F.lit(v).cast("double") for v in quantiles(df, col, [0.25, 0.5, 0.75])]
    agg = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                 F.min(x).alias("min"), F.max(x).alias("max"))
    r = lambda c: F.bround(c, digits)
    return agg.select(F.col("count").cast("long").alias("count"), r(F.col("mean")).alias("mean"),
                      r(F.col("std")).alias("std"), r(F.col("min")).alias("min"),
                      r(q[0]).alias("q25"), r(q[1]).alias("q50"), r(q[2]).alias("q75"), r(F.col("max")).alias("max"))
