"""The sparse field and the fit's criteria against dense matrices, eigenvalues, quadrature and exact leave-one-out."""

import math
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survperf.operators import expected
from survperf.operators.field import Field, Precision, SharePrior


def grid_map(rows, cols, gone=(), alone=()):
    """Names and links of a grid without the cells ``gone``, and districts without links."""
    names = [f"{i:03d}-{j:03d}" for i in range(rows) for j in range(cols) if (i, j) not in gone]
    known = set(names)
    edges = [(f"{i:03d}-{j:03d}", f"{i + a:03d}-{j + b:03d}") for i in range(rows) for j in range(cols) for a, b in ((0, 1), (1, 0), (1, 1), (1, -1))]
    return names + list(alone), [(a, b) for a, b in edges if a in known and b in known]


#: Five by five; and two parts of different size with two districts on their own.
MAPS = {"square": grid_map(5, 5), "parts": grid_map(4, 7, gone=[(i, 3) for i in range(4)], alone=["x", "y"])}


def dense_field(names, edges):
    """Precision of the scaled field in the order of ``names``, and its components, by pseudo-inverses."""
    n = len(names)
    w = np.zeros((n, n))
    for a, b in edges:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = 1
    label = np.arange(n)
    for _ in range(n):
        label = np.minimum(label, np.where(w > 0, label[None], n).min(1))
    q = np.diag(w.sum(1)) - w
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        part = q[np.ix_(own, own)]
        q[np.ix_(own, own)] = np.eye(1) if len(own) == 1 else part * np.exp(np.log(np.diag(np.linalg.pinv(part, hermitian=True))).mean())
    return q, label


@pytest.mark.parametrize("name", MAPS)
def test_field_equals_the_dense_one(name):
    names, edges = MAPS[name]
    field = Field(names, edges)
    q, label = dense_field(names, edges)
    q = q[np.ix_(field.order, field.order)]
    assert np.allclose([field.precision(e) for e in np.eye(field.n)], q)
    rng = np.random.default_rng(1)
    add, r = rng.uniform(0.1, 2, field.n), rng.normal(size=(field.n, 3))
    f, whole = field.factor(0.7, add), 0.7 * q + np.diag(add)
    assert np.allclose(f.solve(r), np.linalg.solve(whole, r)) and f.logdet == pytest.approx(np.linalg.slogdet(whole)[1])
    assert np.allclose(f.variances(), np.diag(np.linalg.inv(whole)))
    half = f.half(np.eye(field.n))
    assert np.allclose(half @ half.T, np.linalg.inv(whole))
    var = np.diag(np.linalg.pinv(q, hermitian=True))
    assert field.trace == pytest.approx(var.sum()) and field.parts == len([c for c in np.unique(label) if (label == c).sum() > 1])
    for c in range(field.parts):
        assert np.log(var[field.component == c]).mean() == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("name", MAPS)
def test_share_prior_by_the_spectrum(name):
    """The divergence is the one of eigenvalues, and the prior gives its statement by quadrature."""
    names, edges = MAPS[name]
    field = Field(names, edges)
    e = np.linalg.eigvalsh(np.linalg.pinv(dense_field(names, edges)[0], hermitian=True))
    for phi in (0.01, 0.3, 0.9, 0.999):
        mixed = 1 - phi + phi * e[e > 1e-9]
        assert field.divergence(phi) == pytest.approx(0.5 * (mixed - 1 - np.log(mixed)).sum(), rel=1e-6, abs=1e-9)
    for u, alpha in ((0.5, 0.5), (0.5, 2 / 3), (0.2, 0.9), (0.5, 0.1)):
        prior = SharePrior(field, u, alpha)
        at = np.linspace(-8, 8, 40_001)
        density = np.exp([prior.log_density(t) for t in at])
        below = (density * (at < math.log(u / (1 - u)))).sum() * (at[1] - at[0])
        assert below == pytest.approx(alpha, abs=0.01) and density.sum() * (at[1] - at[0]) == pytest.approx(1, abs=0.02)
        assert prior.cdf(u) == pytest.approx(alpha, abs=1e-9)


def dense_joint(field, q, sd, phi, h, cross, weight):
    """The precision of (u, s, f) as one matrix."""
    n, k = field.n, len(h)
    a, c = 1 / (sd**2 * (1 - phi)), math.sqrt(phi) / (sd * (1 - phi))
    whole = np.zeros((2 * n + k, 2 * n + k))
    whole[:n, :n] = np.diag(a + weight)
    whole[:n, n : 2 * n] = whole[n : 2 * n, :n] = -c * np.eye(n)
    whole[n : 2 * n, n : 2 * n] = q + (phi / (1 - phi) + Precision.RIDGE) * np.eye(n)
    whole[:n, 2 * n :], whole[2 * n :, :n] = cross, cross.T
    whole[2 * n :, 2 * n :] = h
    return whole


@pytest.mark.parametrize("name", MAPS)
def test_precision_equals_the_dense_one(name):
    names, edges = MAPS[name]
    field = Field(names, edges)
    n, k = field.n, 3
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n * 6, k))
    place, w = np.tile(np.arange(n), 6), rng.uniform(0.2, 3, n * 6)
    h, weight = x.T @ (x * w[:, None]) + np.eye(k), np.bincount(place, w, n)
    cross = np.stack([np.bincount(place, w * x[:, j], n) for j in range(k)], 1)
    extra = np.array([[0.0, 1.0, 1.0]])
    p = Precision(field, 0.6, 0.7, h, cross, weight, extra)
    q = dense_field(names, edges)[0][np.ix_(field.order, field.order)]
    whole = dense_joint(field, q, 0.6, 0.7, h, cross, weight)
    cov = np.linalg.inv(whole)
    g = rng.normal(size=2 * n + k)
    assert np.allclose(np.concatenate(p.solve(g[:n], g[n : 2 * n], g[2 * n :])), cov @ g) and p.logdet == pytest.approx(np.linalg.slogdet(whole)[1])
    a = np.zeros((field.parts + 1, 2 * n + k))
    a[: field.parts, n : 2 * n] = field.sums
    a[-1, 2 * n :] = extra
    held = cov - cov @ a.T @ np.linalg.solve(a @ cov @ a.T, a @ cov)
    assert p.logdet_held == pytest.approx(np.linalg.slogdet(a @ cov @ a.T)[1])
    u, s, f = p.draw(np.random.default_rng(3), 40_000)
    drawn = np.vstack((u, s, f))
    assert np.abs(a @ drawn).max() < 1e-9  # every draw, every component
    assert np.allclose(np.cov(drawn), held, atol=0.06 * np.sqrt(np.diag(held).max() * np.diag(held)).max())
    assert np.allclose(np.diag(np.cov(drawn)), np.diag(held), rtol=0.08, atol=1e-6)


def panel_of(names, rng, rate=6.0, years=range(2015, 2020), effect=None, year_sd=0.0, noise=0.0):
    shift = {y: year_sd * rng.standard_normal() for y in years}
    rows = []
    for n in names:
        for y in years:
            for m in range(1, 13):
                mean = rate * math.exp((effect or {}).get(n, 0.0) + shift[y] + noise * rng.standard_normal())
                rows.append((n, date(y, m, 1), float(rng.poisson(mean)), 12e5))
    return pd.DataFrame(rows, columns=["district", "month", "count", "pop"])


def test_mode_equals_a_dense_newton():
    names, edges = MAPS["square"]
    model = expected.Model(season="rw2", year_effect="rw1", extra="none")
    rng = np.random.default_rng(4)
    d = expected._Data(expected._sorted(panel_of(names, rng, effect={n: 0.5 * rng.standard_normal() for n in names})), edges, model)
    hyper = {"sd": 0.5, "phi": 0.6, "sd_year": 0.3, "sd_season": 0.2, "extra": 0.0}
    (u, s, f), lml = expected.laplace(d, model, hyper, expected.start_of(d))
    n, k = d.field.n, d.size
    q = dense_field(names, edges)[0][np.ix_(d.field.order, d.field.order)]
    prior = expected._effect_prior(d.sizes, model, hyper)
    year = np.eye(d.sizes["year"])[d.year]
    x = np.hstack((np.eye(n)[d.place], np.zeros((len(d.y), n)), d.dense, year))
    base = dense_joint(d.field, q, 0.5, 0.6, prior, np.zeros((n, k)), np.zeros(n))
    a = np.zeros((d.field.parts + 2, 2 * n + k))
    a[: d.field.parts, n : 2 * n] = d.field.sums
    a[d.field.parts :, 2 * n :] = expected._effect_sums(d.sizes, model)
    at = np.zeros(2 * n + k)
    at[2 * n] = f[0]
    for _ in range(30):
        mu = np.exp(d.offset + x @ at)
        both = np.block([[base + x.T @ (x * mu[:, None]), a.T], [a, np.zeros((len(a), len(a)))]])
        at = at + np.linalg.solve(both, np.concatenate((x.T @ (d.y - mu) - base @ at, -a @ at)))[: 2 * n + k]
    assert np.allclose(np.concatenate((u, s, f)), at, atol=1e-5) and np.abs(a @ at).max() < 1e-8 and math.isfinite(lml)
    # of two settings the marginal likelihoods differ as in dense matrices
    def dense_lml(h):
        b = dense_joint(d.field, q, h["sd"], h["phi"], expected._effect_prior(d.sizes, model, h), np.zeros((n, k)), np.zeros(n))
        z = np.concatenate(expected.laplace(d, model, h, expected.start_of(d))[0])
        mu = np.exp(d.offset + x @ z)
        post = b + x.T @ (x * mu[:, None])
        given = lambda m: np.linalg.slogdet(m)[1] + np.linalg.slogdet(a @ np.linalg.solve(m, a.T))[1]
        return (d.y * (d.offset + x @ z) - mu).sum() - 0.5 * z @ b @ z + 0.5 * given(b) - 0.5 * given(post)

    other = hyper | {"sd": 0.9, "phi": 0.2, "sd_year": 0.1, "sd_season": 0.5}
    assert expected.laplace(d, model, other, expected.start_of(d))[1] - lml == pytest.approx(dense_lml(other) - dense_lml(hyper), abs=2e-3)


def test_design_has_the_moments_of_a_normal():
    for m in (1, 2, 3, 4, 5):
        z, w = expected.design(m)
        p = w * np.exp(-0.5 * (z**2).sum(1))
        p /= p.sum()
        assert np.allclose(p @ z, 0) and np.allclose((z * p[:, None]).T @ z, np.eye(m)) and len(z) <= 27
    top, curve = expected.climb(lambda v: -0.5 * ((v - [1, 2]) @ np.array([[4, 1], [1, 3]]) @ (v - [1, 2])), np.zeros(2))
    assert np.allclose(top, [1, 2], atol=0.02) and np.allclose(curve, [[4, 1], [1, 3]], atol=0.05)


def test_planted_deviations_are_recovered():
    """Deviations of years, of districts and of observations, from data that know them well."""
    names, edges = grid_map(7, 7)
    rng = np.random.default_rng(5)
    model = expected.Model(season="none", extra="iid")
    effect = {n: 0.4 * rng.standard_normal() for n in names}
    d = expected._Data(expected._sorted(panel_of(names, rng, rate=40, years=range(2008, 2020), effect=effect, year_sd=0.3, noise=0.25)), edges, model)
    hyper = [expected.hyper_of(model, np.array(t)) for t, _ in expected.planned(d, model)][0]
    assert hyper["sd"] == pytest.approx(0.4, rel=0.3) and hyper["sd_year"] == pytest.approx(0.3, rel=0.6) and hyper["extra"] == pytest.approx(0.25, rel=0.1)


def test_left_out_density_and_its_tail():
    """Normal observations with a known answer; one far away is told by its tail."""
    rng = np.random.default_rng(6)
    y = np.append(rng.normal(size=60), 12.0)
    n = len(y)
    mean, var = y.sum() / (n + 0.01), 1 / (n + 0.01)
    draws = mean + math.sqrt(var) * rng.standard_normal(4000)
    log_normal = lambda x, m, v: -0.5 * np.log(2 * math.pi * v) - (x - m) ** 2 / (2 * v)
    loo, shape = expected.left_out(log_normal(y[:, None], draws[None], 1.0))
    rest = np.array([log_normal(v, (y.sum() - v) / (n - 0.99), 1 + 1 / (n - 0.99)) for v in y])
    assert np.allclose(loo[:-1], rest[:-1], atol=0.02) and (shape[:-1] < 0.5).all()
    few = expected.left_out(log_normal(np.array([[40.0]]), draws[None], 1.0))
    assert few[1][0] > expected.TAIL and shape[-1] > shape[:-1].max()
    tails = expected.pareto_shape(np.sort(np.random.default_rng(7).pareto(2.0, (50, 400)), 1))
    assert np.median(tails[0]) == pytest.approx(0.5, abs=0.1) and np.median(tails[1]) == pytest.approx(0.5, abs=0.15)


def test_outliers_fail_the_rule(spark):
    """Poisson counts of which each is a year and district of its own and far off: their densities are not usable, and the rule excludes the likelihood."""
    rng = np.random.default_rng(8)
    rows = [(f"d{i}", date(y, m, 1), int(rng.choice([0, 900])), 1e6) for i in range(3) for y in range(2012, 2021) for m in (1,)]
    panel = spark.createDataFrame(rows, "district string, month date, count long, pop double")
    edges = spark.createDataFrame([("d0", "d1"), ("d1", "d2")], "focal string, neighbour string")
    masked = expected.masked(panel, expected.windows(2020, 2020))
    got = {r.spec: r for r in expected.recommend(expected.compare_overdispersion(masked, edges, ("none", "nb"))).collect()}
    assert got["none"].cpo_valid < expected.CPO_SHARE and "cpo" in got["none"].excluded
    assert got["nb"].cpo_valid > got["none"].cpo_valid and "cpo" not in got["nb"].excluded


def test_one_outlier_is_flagged(spark):
    rng = np.random.default_rng(9)
    rows = [(f"d{i}", date(y, m, 1), int(rng.poisson(12)) if (i, y, m) != (2, 2018, 6) else 150, 1e6) for i in range(5) for y in range(2015, 2020) for m in range(1, 13)]
    panel = spark.createDataFrame(rows, "district string, month date, count long, pop double")
    edges = [(f"d{i}", f"d{i + 1}") for i in range(4)]
    masked, models = expected.masked(panel, expected.windows(2019, 2019)), {"none": expected.Model(extra="none", n_draws=400)}
    blocks = expected.posterior(masked, edges, models)
    cells = expected.left_out_cells(expected._drawn(masked, blocks, models, edges, expected.CELLS, expected._cell_terms(models)))
    worst = cells.orderBy(F.desc("khat")).limit(2).collect()
    assert (worst[0].district, worst[0].month) == ("d2", date(2018, 6, 1)) and worst[0].khat > expected.TAIL > worst[1].khat


@pytest.mark.parametrize("kind", ["iid", "rw1"])
def test_draws_of_effects_hold_their_sums(spark, kind):
    names, edges = MAPS["parts"]
    pdf = panel_of(names, np.random.default_rng(10), years=range(2017, 2020))
    panel = spark.createDataFrame(pdf).withColumn("month", F.col("month").cast("date")).withColumn("count", F.col("count").cast("long"))
    links = spark.createDataFrame(edges, "focal string, neighbour string")
    model = expected.Model(season="rw2", year_effect=kind, n_draws=80)
    rows = expected.effects(expected.masked(panel, expected.windows(2019, 2019)), links, model)
    got = rows.groupBy("effect").agg(F.sum("mean").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums = {r.effect: (r.s, r.n) for r in got}
    assert sums["season"] == (pytest.approx(0, abs=1e-6), 12) and sums["space"][1] == len(names)
    assert kind == "iid" or sums["year"] == (pytest.approx(0, abs=1e-6), 3)


def test_a_large_map_stays_small():
    """Ten thousand districts: the factor's numbers, and the time of a factor, are far below those of dense matrices."""
    names, edges = grid_map(100, 100)
    field = Field(names, edges)
    f = field.factor(1.0, np.full(field.n, 0.5))
    assert sum(b.size for b in f.inverse + f.below) < 0.05 * field.n**2
    x = np.random.default_rng(11).normal(size=field.n)
    assert np.allclose(field.precision(f.solve(x)) + 0.5 * f.solve(x), x)
