import math

import numpy as np
import pytest

from vigil.functions import special
from vigil.operators import signals as S


def test_gamma_functions():
    x = np.concatenate([np.linspace(1e-3, 3, 200), np.linspace(3, 500, 300)])
    assert np.allclose(special.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5 * x
    assert np.allclose(special.digamma(x), (special.log_gamma(x + h) - special.log_gamma(x - h)) / (2 * h), rtol=1e-5, atol=1e-5)
    assert np.allclose(special.trigamma(x), (special.digamma(x + h) - special.digamma(x - h)) / (2 * h), rtol=1e-5, atol=1e-5)
    # whole shapes: 1 - P is a sum of Poisson probabilities
    for a in (1, 2, 7, 60):
        for v in (0.01, 0.5, a - 0.5, a + 1.0, a * 2.0, a * 5.0):
            tail = math.fsum(math.exp(-v + k * math.log(v) - math.lgamma(k + 1)) for k in range(a))
            assert special.gamma_cdf(np.array([a]), np.array([v]))[0] == pytest.approx(1 - tail, abs=1e-12)
    assert special.gamma_cdf(np.array([0.3]), np.array([0.0]))[0] == 0


ROWS = [("1", "A", "x"), ("1", "A", "x"), ("1", "A", "y"), ("2", "A", "x"), ("3", "B", "x"), ("3", "A", "z"), ("4", "B", "y"), ("5", "C", "y"),
        ("6", "A", "x"), ("7", "A", "x"), (None, "A", "x"), ("8", "", "x"), ("9", "D", None), ("10", "C", "w"), ("11", "C", "w")]


def slow_cells(rows):
    ok = [r for r in rows if all(r)]
    reports = {r[0] for r in ok}
    of = lambda test: {r[0] for r in ok if test(r)}
    out = {}
    for d, e in {(r[1], r[2]) for r in ok}:
        both, drug, event = of(lambda r: r[1:] == (d, e)), of(lambda r: r[1] == d), of(lambda r: r[2] == e)
        out[d, e] = len(both), len(drug) - len(both), len(event) - len(both), len(reports) - len(drug) - len(event) + len(both)
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "report string, drug string, event string")
    return S.cells(S.counts(df, "report", "drug", "event"))


def test_cells(spark):
    got = {(r.drug, r.event): (r.a, r.b, r.c, r.d) for r in table(spark, ROWS).collect()}
    assert got == slow_cells(ROWS)
    assert table(spark, []).count() == 0


def test_ratios(spark):
    for r in S.prr_ror(table(spark, ROWS)).collect():
        a, b, c, d = r.a, r.b, r.c, r.d
        if c == 0:
            assert r.prr is None and r.ror is None and not r.is_signal
            continue
        assert r.prr == pytest.approx(a / (a + b) / (c / (c + d)))
        assert r.prr_low == pytest.approx(r.prr * math.exp(-S.Z95 * math.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))))
        if b and d:
            assert r.ror == pytest.approx(a * d / b / c) and r.ror_high == pytest.approx(r.ror * math.exp(S.Z95 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)))
    for r in S.information_component(table(spark, ROWS)).collect():
        e = (r.a + r.b) * (r.a + r.c) / (r.a + r.b + r.c + r.d)
        assert r.expected == pytest.approx(e) and r.ic == pytest.approx(math.log2((r.a + 0.5) / (e + 0.5))) and r.ic025 < r.ic < r.ic975


# ------------------------------------------------------------------- EBGM ----
def plain_likelihood(prior, n, e):
    """Log likelihood of counts of one or more, by plain loops."""
    def mix(k, x):
        return sum(p * math.exp(math.lgamma(a + k) - math.lgamma(a) - math.lgamma(k + 1) + a * math.log(b / (b + x)) + k * math.log(x / (b + x)))
                   for p, a, b in prior.parts())
    return sum(math.log(mix(k, x)) - math.log(1 - mix(0, x)) for k, x in zip(n, e))


def simulated(size, seed=5):
    r = np.random.default_rng(seed)
    e = r.uniform(0.3, 6, size)
    ratio = np.where(r.random(size) < 0.15, r.gamma(3.0, 1 / 0.6, size), r.gamma(6.0, 1 / 6.0, size))
    n = r.poisson(ratio * e)
    return n[n > 0], e[n > 0]


def test_em_never_lowers_the_likelihood():
    n, e = simulated(400)
    at, last = S.START, -math.inf
    for _ in range(25):
        sums = S.em_sums(at, n.astype(float), e)
        assert sums[0] == pytest.approx(plain_likelihood(at, n.tolist(), e.tolist()))
        assert sums[0] >= last - 1e-9
        at, last = S.em_step(sums), sums[0]


def test_fit_on_simulated_pairs(spark):
    n, e = simulated(6000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(n, e)], "a long, expected double").repartition(4)
    prior = S.fit_prior(df)
    best = plain_likelihood(prior, n.tolist(), e.tolist())
    planted = S.Prior(0.15, 3.0, 0.6, 6.0, 6.0)
    assert best >= plain_likelihood(planted, n.tolist(), e.tolist()) - 0.5
    for k in range(5):  # a maximum: no neighbour is likelier by more than the tolerance
        for step in (-0.05, 0.05):
            free = prior.free()
            free[k] += step
            assert plain_likelihood(S.Prior.of(free), n.tolist(), e.tolist()) < best + 0.5
    assert S.fit_prior(df.limit(0)) == S.START


def test_posterior(spark):
    prior = S.Prior(0.3, 0.7, 0.4, 2.5, 3.0)
    n, e = np.array([1.0, 4.0, 30.0, 250.0]), np.array([0.2, 5.0, 2.0, 240.0])
    mean, low, high = S.posterior(prior, n, e)
    grid = np.exp(np.linspace(-14, 7, 200_001))
    for k in range(len(n)):
        log = [math.log(p) + a * math.log(b) - math.lgamma(a) + (a - 1) * np.log(grid) - b * grid for p, a, b in prior.parts()]
        density = (np.exp(log[0]) + np.exp(log[1])) * np.exp(n[k] * np.log(grid * e[k]) - grid * e[k] - math.lgamma(n[k] + 1)) * grid
        mass = np.cumsum(density) / density.sum()
        assert mean[k] == pytest.approx(math.exp((np.log(grid) * density).sum() / density.sum()), rel=1e-3)
        assert low[k] == pytest.approx(grid[np.searchsorted(mass, 0.05)], rel=1e-3)
        assert high[k] == pytest.approx(grid[np.searchsorted(mass, 0.95)], rel=1e-3)
    out = S.ebgm(table(spark, ROWS), prior).collect()
    assert len(out) == len(slow_cells(ROWS)) and all(r.eb05 < r.ebgm < r.eb95 for r in out)


def test_posterior_of_common_pairs_ends_soon():
    """Counts in the hundred thousands, as large tables have them."""
    import time
    prior = S.Prior(0.3, 0.7, 0.4, 2.5, 3.0)
    n = np.random.default_rng(2).integers(100_000, 140_000, 2000).astype(float)
    e = n * np.random.default_rng(3).uniform(0.8, 1.25, len(n))
    began = time.process_time()
    mean, low, high = S.posterior(prior, n, e)
    assert time.process_time() - began < 20
    assert ((low < mean) & (mean < high)).all()
    assert low == pytest.approx(mean * np.exp(-1.6448536 / np.sqrt(n)), rel=1e-4) and high == pytest.approx(mean * np.exp(1.6448536 / np.sqrt(n)), rel=1e-4)


def test_pairs_of_equal_counts_weigh_as_often_as_they_stand(spark):
    n, e = simulated(300)
    n, e = np.tile(n, 3), np.tile(e, 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(n, e)], "a long, expected double").repartition(3)
    pairs = S.weighted(df)
    assert pairs.count() == len(set(zip(n.tolist(), e.tolist())))
    want = S.em_sums(S.START, n.astype(float), e)
    assert S.distributed_sums(pairs, S.START) == pytest.approx(want, rel=1e-12)
    assert S.summing(df)(S.START) == pytest.approx(want, rel=1e-12)
