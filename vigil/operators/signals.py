"""Disproportionality of drug-event pairs in a table of reports.

``counts`` takes (report, drug, event) rows and counts distinct reports of every pair, drug, event and
of the whole table from one shuffle of the rows; ``cells`` joins them to the 2x2 table of a pair:

                  event    other events
    drug            a           b
    other drugs     c           d

``prr_ror`` and ``information_component`` are expressions over that table.  ``ebgm`` shrinks the ratio of observed
to expected reports: its prior, a mixture of two gamma distributions, is fitted to all pairs.  Pairs of the same observed and
expected count stand in the fit as one with their number.  Each EM step
is one distributed sum over these, of which the driver sees seven numbers a task (up to ``LOCAL_PAIRS`` of them are
summed up on the driver); the posterior is computed row by row.  Pairs without a report aren't in the table, so the likelihood is that of counts of
one or more: an EM step adds, for each pair, the zero counts that were expected unseen beside it.

Null or blank drugs, events and reports don't count; repeated rows count once; an empty table gives no rows
(and ``fit_prior`` its starting values).  A ratio whose denominator is 0 is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import digamma, gamma_cdf, log_gamma, trigamma
from ..session import staged

Z95 = 1.959963984540054  # standard normal quantile of 97.5 %
#: Usual screening limits of a signal: reports, ratio and chi square.
MIN_REPORTS, MIN_PRR, MIN_CHI2 = 3, 2.0, 4.0
LOCAL_PAIRS = 1 << 16  # so many different (observed, expected) need no job a pass


def counts(reports: DataFrame, report: str, drug: str, event: str) -> DataFrame:
    """(drug, event, n): distinct reports of each pair, of each drug (event null), each event (drug null), and of all."""
    given = [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in (report, drug, event)]
    rows = reports.where(given[0] & given[1] & given[2]).select(
        F.col(report).alias("report"), F.col(drug).cast("string").alias("drug"), F.col(event).cast("string").alias("event"))
    # dealt by report once: a report's pairs, drugs and events become distinct where they stand, only counts move after
    none = F.lit(None).cast("string")
    sets = F.array(*[F.struct(d.alias("drug"), e.alias("event")) for d in (F.col("drug"), none) for e in (F.col("event"), none)])
    each = rows.repartition("report").select("report", F.explode(sets).alias("s")).select("report", "s.drug", "s.event").distinct()
    return each.groupBy("drug", "event").agg(F.count(F.lit(1)).alias("n"))


def cells(n: DataFrame) -> DataFrame:
    """(drug, event, a, b, c, d) of every pair that a report has, from ``counts``."""
    both, no_drug, no_event = F.col("drug").isNotNull() & F.col("event").isNotNull(), F.col("drug").isNull(), F.col("event").isNull()
    drugs = n.where(no_event & ~no_drug).select("drug", F.col("n").alias("n_drug"))
    events = n.where(no_drug & ~no_event).select("event", F.col("n").alias("n_event"))
    total = n.where(no_drug & no_event).select("n").scalar()
    x = n.where(both).join(drugs, "drug").join(events, "event").withColumn("total", total)
    return x.select("drug", "event", F.col("n").alias("a"), (F.col("n_drug") - F.col("n")).alias("b"), (F.col("n_event") - F.col("n")).alias("c"),
                    (F.col("total") - F.col("n_drug") - F.col("n_event") + F.col("n")).alias("d"))


def _x(name: str) -> Column:
    return F.col(name).cast("double")


def _over(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / bottom)


def _interval(ratio: Column, variance: Column) -> tuple[Column, Column]:
    """95 % limits of a ratio whose logarithm has that variance."""
    width = F.lit(Z95) * F.sqrt(variance)
    return F.exp(F.log(ratio) - width), F.exp(F.log(ratio) + width)


def prr_ror(table: DataFrame) -> DataFrame:
    """Adds the proportional reporting ratio and the reporting odds ratio with 95 % limits, chi square
    with Yates' correction, and whether the pair passes the usual limits of a signal."""
    a, b, c, d = _x("a"), _x("b"), _x("c"), _x("d")
    n = a + b + c + d
    prr = _over(a * (c + d), (a + b) * c)
    low, high = _interval(prr, 1 / a - 1 / (a + b) + _over(F.lit(1.0), c) - _over(F.lit(1.0), c + d))
    ror = _over(a * d, b * c)
    ror_low, ror_high = _interval(F.when(ror > 0, ror), 1 / a + _over(F.lit(1.0), b) + _over(F.lit(1.0), c) + _over(F.lit(1.0), d))
    off = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi2 = _over(n * off * off, (a + b) * (c + d) * (a + c) * (b + d))
    signal = (F.col("a") >= MIN_REPORTS) & (F.col("prr") >= MIN_PRR) & (F.col("chi2") >= MIN_CHI2)
    out = table.withColumns({"prr": prr, "prr_low": low, "prr_high": high, "ror": ror, "ror_low": ror_low, "ror_high": ror_high, "chi2": chi2})
    return out.withColumn("is_signal", F.coalesce(signal, F.lit(False)))


def expected() -> Column:
    """Reports of the pair if drug and event were independent."""
    a, b, c, d = _x("a"), _x("b"), _x("c"), _x("d")
    return (a + b) * (a + c) / (a + b + c + d)


def information_component(table: DataFrame) -> DataFrame:
    """Adds the expected count, the information component (log2 of observed to expected, both shrunk by
    a half) and its 95 % limits by the usual approximation."""
    o = _x("a") + 0.5
    ic = F.log2(o / (F.col("expected") + 0.5))
    return (table.withColumn("expected", expected()).withColumn("ic", ic)
            .withColumn("ic025", F.col("ic") - 3.3 / F.sqrt(o) - 2.0 / (o * F.sqrt(o)))
            .withColumn("ic975", F.col("ic") + 2.4 / F.sqrt(o) - 0.5 / (o * F.sqrt(o))))


# ------------------------------------------------------------ gamma mixture ----
@dataclass(frozen=True)
class Prior:
    """share, shape and rate of two gamma distributions of the true ratio."""

    share: float
    shape1: float
    rate1: float
    shape2: float
    rate2: float

    def free(self) -> np.ndarray:
        """The same without bounds."""
        return np.array([np.log(self.share / (1 - self.share)), *np.log([self.shape1, self.rate1, self.shape2, self.rate2])])

    @staticmethod
    def of(free: np.ndarray) -> Prior:
        free = np.clip(free, -25, 25)
        return Prior(float(1 / (1 + np.exp(-free[0]))), *(float(x) for x in np.exp(free[1:])))

    def parts(self) -> list[tuple[float, float, float]]:
        return [(self.share, self.shape1, self.rate1), (1 - self.share, self.shape2, self.rate2)]


#: Starting values in common use for this mixture.
START = Prior(1 / 3, 0.2, 0.1, 2.0, 4.0)


def _log_joint(prior: Prior, n: np.ndarray, e: np.ndarray) -> np.ndarray:
    """ln(share * probability of n) of both parts, one row each."""
    return np.array([np.log(p) + log_gamma(a + n) - log_gamma(np.array(a)) - log_gamma(n + 1.0) + a * np.log(b / (b + e)) + n * np.log(e / (b + e))
                     for p, a, b in prior.parts()])


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def em_sums(prior: Prior, n: np.ndarray, e: np.ndarray, w: np.ndarray | float = 1.0) -> np.ndarray:
    """Log likelihood, and of both parts the sums of membership, ratio and log ratio given the counts; ``w`` is how often each stands."""
    seen, unseen = _log_joint(prior, n, e), _log_joint(prior, np.zeros_like(n), e)
    own, none = _log_sum(seen), _log_sum(unseen)
    some = -np.expm1(none)  # probability of one report or more
    out = [float((w * (own - np.log(some))).sum())]
    beside = w * np.exp(none) / some
    for k, (_, a, b) in enumerate(prior.parts()):
        r, z = w * np.exp(seen[k] - own), beside * np.exp(unseen[k] - none)
        out += [float((r + z).sum()), float((r * (a + n) / (b + e) + z * a / (b + e)).sum()),
                float((r * (digamma(a + n) - np.log(b + e)) + z * (digamma(np.array(a)) - np.log(b + e))).sum())]
    return np.array(out)


def em_step(sums: np.ndarray) -> Prior:
    """The mixture that fits the expected memberships, ratios and log ratios best."""
    parts = []
    for weight, ratio, log_ratio in (sums[1:4], sums[4:7]):
        mean = ratio / weight
        gap = max(np.log(mean) - log_ratio / weight, 1e-12)  # ln(shape) - digamma(shape)
        x = (3 - gap + np.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
        for _ in range(30):
            step = (np.log(x) - digamma(np.array(x)) - gap) / (1 / x - trigamma(np.array(x)))
            x = float(max(x - step, x / 4))
        parts += [x, float(x / mean)]
    return Prior(float(sums[1] / (sums[1] + sums[4])), *parts)


def weighted(table: DataFrame) -> DataFrame:
    """Different (a, expected) and the number of pairs that have them, as w."""
    return table.groupBy("a", "expected").agg(F.count(F.lit(1)).alias("w"))


def _columns(b: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.asarray(b.column(c).to_numpy(), float) if isinstance(b, pa.Table) else b.column(c).to_numpy(False).astype(float) for c in ("a", "expected", "w")]


def distributed_sums(pairs: DataFrame, prior: Prior) -> np.ndarray:
    """``em_sums`` over all ``weighted`` pairs: each task adds up its batches, the driver the tasks."""
    schema = T.StructType([T.StructField(f"s{i}", T.DoubleType()) for i in range(7)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((em_sums(prior, *_columns(b)) for b in it if len(b)), np.zeros(7))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], schema.names)

    return sum((np.array(r) for r in pairs.select("a", "expected", "w").mapInArrow(run, schema).collect()), np.zeros(7))


def summing(table: DataFrame) -> Callable[[Prior], np.ndarray]:
    """``em_sums`` of a table of (a, expected) for any prior; the table is read once."""
    pairs = staged(weighted(table), "pairs")
    few = pairs.limit(LOCAL_PAIRS + 1).toArrow()
    if len(few) > LOCAL_PAIRS:
        return lambda prior: distributed_sums(pairs, prior)
    n, e, w = _columns(few)
    order = np.lexsort((e, n))
    n, e, w = n[order], e[order], w[order]
    return lambda prior: em_sums(prior, n, e, w) if len(n) else np.zeros(7)


def gradient(prior: Prior, sums: np.ndarray) -> np.ndarray:
    """Of the log likelihood by the unbounded values: that of the completed likelihood, whose sums an EM step has anyway."""
    out = [sums[1] - prior.share * (sums[1] + sums[4])]
    for (_, a, b), (weight, ratio, log_ratio) in zip(prior.parts(), (sums[1:4], sums[4:7])):
        out += [a * (weight * (np.log(b) - float(digamma(np.array(a)))) + log_ratio), weight * a - b * ratio]
    return np.array(out)


def fit_prior(table: DataFrame, start: Prior = START, warm_up: int = 5, passes: int = 150, tolerance: float = 1e-10) -> Prior:
    """The likeliest mixture for (a, expected): ``warm_up`` EM steps, then, as EM crawls near the top, quasi-Newton steps on
    the gradient that the same sums give, halved until the likelihood rises.  It ends when a step raises the mean
    log likelihood by less than ``tolerance``, or after so many passes over the table."""
    sums_at = summing(table)
    at, sums, used = start, sums_at(start), 1
    if not sums[1] + sums[4] > 0:
        return start
    for _ in range(warm_up):
        at = em_step(sums)
        sums, used = sums_at(at), used + 1
    n = sums[1] + sums[4]
    x, slope, bend = at.free(), gradient(at, sums) / n, np.eye(5)
    while used < passes:
        step = bend @ slope
        if step @ slope <= 0:
            step, bend = slope, np.eye(5)
        step *= min(1.0, 2.0 / np.abs(step).max())
        size = 1.0
        while True:
            new = Prior.of(x + size * step)
            found, used = sums_at(new), used + 1
            if found[0] >= sums[0] + 1e-4 * size * n * (step @ slope) or size < 1e-4 or used >= passes:
                break
            size /= 4
        if not found[0] > sums[0]:
            break
        moved, turned = new.free() - x, slope - gradient(new, found) / n
        if moved @ turned > 1e-14:
            r = 1 / (moved @ turned)
            left = np.eye(5) - r * np.outer(moved, turned)
            bend = left @ bend @ left.T + r * np.outer(moved, moved)
        gain = (found[0] - sums[0]) / n
        at, sums, x, slope = new, found, new.free(), gradient(new, found) / n
        if gain < tolerance:
            break
    return at


def _quantile(prior: Prior, share: np.ndarray, n: np.ndarray, e: np.ndarray, p: float) -> np.ndarray:
    """The ratio below which the posterior has mass ``p``: Newton steps for its logarithm, halving where they leave the
    bounds found so far; rows that have converged leave."""
    (_, a1, b1), (_, a2, b2) = prior.parts()
    out, live = np.zeros(len(n)), np.arange(len(n))
    low, high = np.full(len(n), -40.0), np.full(len(n), 40.0)
    at = np.clip(np.log(share * (a1 + n) / (b1 + e) + (1 - share) * (a2 + n) / (b2 + e)), -39.0, 39.0)
    while len(live):
        x = np.exp(at)
        below, slope = np.zeros(len(at)), np.zeros(len(at))
        for part, shape, z in ((share, a1 + n, x * (b1 + e)), (1 - share, a2 + n, x * (b2 + e))):
            below += part * gamma_cdf(shape, z)
            slope += part * np.exp(shape * np.log(z) - z - log_gamma(shape))
        low, high = np.where(below < p, at, low), np.where(below < p, high, at)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = at - (below - p) / slope
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(new - at) < 1e-11) | (high - low < 1e-13)
        out[live[done]] = new[done]
        live, share, n, e, low, high, at = (v[~done] for v in (live, share, n, e, low, high, new))
    return np.exp(out)


def posterior(prior: Prior, n: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Geometric mean of the posterior of the ratio, and its 5 % and 95 % quantiles."""
    seen = _log_joint(prior, n, e)
    share = np.exp(seen[0] - _log_sum(seen))
    (_, a1, b1), (_, a2, b2) = prior.parts()
    mean = share * (digamma(a1 + n) - np.log(b1 + e)) + (1 - share) * (digamma(a2 + n) - np.log(b2 + e))
    return np.exp(mean), _quantile(prior, share, n, e, 0.05), _quantile(prior, share, n, e, 0.95)


def ebgm(table: DataFrame, prior: Prior | None = None) -> DataFrame:
    """Adds expected, ebgm, eb05 and eb95 to ``cells``; the prior is fitted to the table unless given."""
    x = staged(table.withColumn("expected", expected()), "cells")
    fitted = prior or fit_prior(x)
    names = ["ebgm", "eb05", "eb95"]
    schema = T.StructType([*x.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            pairs = np.stack([b.column("a").to_numpy(False).astype(float), b.column("expected").to_numpy(False)])
            (n, e), place = np.unique(pairs, axis=1, return_inverse=True)  # pairs of the same counts have one posterior
            found = posterior(fitted, n, e)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x[place.ravel()]) for x in found)], [*b.schema.names, *names])

    return x.mapInArrow(run, schema)
