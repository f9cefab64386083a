"""Expected counts from a Bayesian spatio-temporal count model, fitted in grouped Spark tasks.

Counts are Poisson, optionally with a Gamma ("nb") or a log-normal ("iid") term of each observation, around
population x exp(intercept + season + year effect + spatial effect [+ covariates]). The spatial
effect mixes a scaled graph effect and an independent one; the graph effect sums to zero in each component of the map, and so do
random-walk effects of years and of the season. The posterior of the effects is Laplace's; that of the
hyperparameters is explored from its mode by a design of few points along its axes, and draws come
from the resulting mixture. Standard deviations have exponential priors, the share of structure the prior of ``field.SharePrior``.
The log-normal term is integrated out of the likelihood by adaptive quadrature
and drawn anew for each cell; the Gamma term has a closed form. Each assessment year sees only months up to its
close, with the counts of its own window hidden, and its draws carry the same draw numbers for all
districts, so that what districts share cancels when draws are centred.

Steps, all of Spark groups: the mode of the hyperparameters of each year and kind of term gives the points of its design; the
points are fitted side by side in parts; their weights, one small row each, are turned into numbers of draws; blocks of
``BLOCK`` draws are made side by side. Year and district effects are sums over codes and the map's matrices are sparse (``field``), so a
group's arrays have as many entries as the panel has cells, times the few other effects.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from copy import copy
from dataclasses import dataclass, replace
from datetime import date
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.session import cut
from survperf.operators.field import Field, Precision, SharePrior

N_DRAWS, QUICK_DRAWS, SEED = 1000, 100, 42
MIN_HISTORY = 3
#: Draws made in one task.
BLOCK = 100
#: Groups that a design's points are fitted in.
PARTS = 6
#: Bounds of the hyperparameters on their own scales: logs of deviations and of the share's odds.
BOUNDS = {"sd": (-5.0, 2.0), "phi": (-6.0, 6.0), "sd_year": (-5.0, 1.5), "sd_season": (-5.0, 1.5), "extra": (-4.0, 1.0)}
START = {"sd": -1.2, "phi": 0.0, "sd_year": -2.0, "sd_season": -1.5, "extra": -1.4}
#: Radius of the design's points in deviations, over the root of their number of axes.
RADIUS = 1.1
#: Tail shape of importance weights beyond which a left-out density is not usable.
TAIL = 0.7
_NODES, _WEIGHTS = np.polynomial.hermite.hermgauss(9)
P_EFF_SHARE, CPO_SHARE, PHI_LOW, PHI_HIGH = 0.2, 0.5, 0.02, 0.98
DRAWS = "target int, district string, month date, draw int, expected double"
FIT = "target int, spec string, n_obs long, dic double, waic double, p_eff double, sd_spatial double, phi_spatial double, sd_extra double, cpo_valid double, pit_ks double"


@dataclass(frozen=True)
class Model:
    """Choices of a fit. ``season``: harmonic, monthly, rw2 or none; ``year_effect``: iid, rw1 or none; ``extra``: nb, iid or none."""

    season: str = "harmonic"
    year_effect: str = "iid"
    extra: str = "nb"
    prior_sd: tuple[float, float] = (1.0, 0.01)
    prior_sd_year: tuple[float, float] = (1.0, 0.01)
    prior_phi: tuple[float, float] = (0.5, 0.5)
    n_draws: int = N_DRAWS
    seed: int = SEED

    def __post_init__(self) -> None:
        allowed = {"season": ("harmonic", "monthly", "rw2", "none"), "year_effect": ("iid", "rw1", "none"), "extra": ("nb", "iid", "none")}
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} is one of {', '.join(values)}")
        for name in ("prior_sd", "prior_sd_year", "prior_phi"):
            u, alpha = getattr(self, name)
            if u <= 0 or not 0 < alpha < 1 or name == "prior_phi" and u >= 1:
                raise ValueError(f"{name}: U must be positive (below 1 for phi) and alpha between 0 and 1")
        if self.n_draws < 1 or self.seed < 0:
            raise ValueError("n_draws is at least 1 and seed not negative")


def windows(first: int, last: int, year_end_month: int = 12, panel_first: date | None = None, min_history: int = MIN_HISTORY) -> list[tuple[int, date, date]]:
    """(target, opens, closes) of each assessment year; raises if the first lacks ``min_history`` years."""
    if not 1 <= year_end_month <= 12:
        raise ValueError("year_end_month is 1 to 12")
    out = []
    for year in range(first, last + 1):
        closes = date(year, year_end_month, 1)
        opens = date(year, 1, 1) if year_end_month == 12 else date(year - 1, year_end_month + 1, 1)
        out.append((year, opens, closes))
    if panel_first is not None and out:
        months = (out[0][1].year - panel_first.year) * 12 + out[0][1].month - panel_first.month
        if months < 12 * min_history:
            raise ValueError(f"{first} has {months} months before its window; {12 * min_history} are needed")
    return out


def masked(panel: DataFrame, years: list[tuple[int, date, date]]) -> DataFrame:
    """``panel`` (district, month, count, pop) once for each target, up to its close, counts of its window hidden."""
    table = F.broadcast(panel.sparkSession.createDataFrame(years, "target int, opens date, closes date"))
    rows = panel.join(table, F.col("month") <= F.col("closes"))
    return rows.select("target", "district", "month", F.when(F.col("month") < F.col("opens"), F.col("count")).alias("count"), "pop", (F.col("month") >= F.col("opens")).alias("inside"), *[c for c in panel.columns if c.startswith("x_")])


def season_design(month: np.ndarray, kind: str) -> np.ndarray:
    m = month.astype(float)
    if kind == "harmonic":
        return np.column_stack([f(2 * math.pi * k * m / 12) for k in (1, 2) for f in (np.sin, np.cos)])
    if kind in ("monthly", "rw2"):
        return np.eye(12)[month - 1] - 1 / 12
    return np.zeros((len(m), 0))


def walk(n: int, order: int, cyclic: bool) -> np.ndarray:
    """The precision of a random walk, scaled to a geometric mean variance of 1."""
    d = np.eye(n)
    for _ in range(order):
        d = d - np.roll(d, 1, 1) if cyclic else np.diff(d, axis=0)
    q = d.T @ d
    return q * math.exp(np.log(np.maximum(np.diag(np.linalg.pinv(q, hermitian=True)), 1e-12)).mean())


def _effect_prior(sizes: dict[str, int], model: Model, hyper: dict[str, float]) -> np.ndarray:
    """Prior precision of the effects that all districts share; what a walk leaves free, its level, is held at zero and has a precision for the factor's sake."""
    size = sum(sizes.values())
    q, at = np.zeros((size, size)), 0
    for name, n in sizes.items():
        own = slice(at, at + n)
        if name == "year":
            q[own, own] = walk(n, 1, False) / hyper["sd_year"] ** 2 + 1 / n if model.year_effect == "rw1" and n > 1 else np.eye(n) / hyper["sd_year"] ** 2
        elif name == "season" and model.season == "rw2":
            q[own, own] = walk(n, 2, True) / hyper["sd_season"] ** 2 + 1 / n
        else:
            q[own, own] = np.eye(n) * (1e-6 if name == "intercept" else 0.1)
        at += n
    return q


def _effect_sums(sizes: dict[str, int], model: Model) -> np.ndarray:
    """The sums of effects that are held at zero: those of the random walks."""
    out, at = [], 0
    for name, n in sizes.items():
        if name == "year" and model.year_effect == "rw1" and n > 1 or name == "season" and model.season == "rw2":
            out.append(np.zeros(sum(sizes.values())))
            out[-1][at : at + n] = 1.0
        at += n
    return np.array(out).reshape(-1, sum(sizes.values()))


def hyper_names(model: Model) -> list[str]:
    asked = {"sd": True, "phi": True, "sd_year": model.year_effect != "none", "sd_season": model.season == "rw2", "extra": model.extra != "none"}
    return [k for k, v in asked.items() if v]


def hyper_of(model: Model, theta: np.ndarray) -> dict[str, float]:
    """Hyperparameters from their unbounded scales."""
    out = {"sd_year": 0.2, "sd_season": 0.5, "extra": 0.0}
    for name, t in zip(hyper_names(model), theta, strict=True):
        out[name] = 1 / (1 + math.exp(-t)) if name == "phi" else math.exp(t)
    return out


def log_prior(model: Model, share: SharePrior, theta: np.ndarray) -> float:
    """Exponential priors on standard deviations by P(sd > U) = alpha, and the share's; on the unbounded scales."""
    prior = {"sd": model.prior_sd, "sd_year": model.prior_sd_year, "sd_season": model.prior_sd, "extra": (1.0, 0.01)}
    out = 0.0
    for name, t in zip(hyper_names(model), theta, strict=True):
        if name == "phi":
            out += share.log_density(t)
        else:
            rate = -math.log(prior[name][1]) / prior[name][0]
            out += math.log(rate) + t - rate * math.exp(t)
    return out


def _terms(y: np.ndarray, eta: np.ndarray, extra: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, its gradient and its curvature. "nb" adds variance extra^2 x mean^2, "iid" a normal term of that deviation."""
    mu = np.exp(np.clip(eta, -30, 30))
    if kind == "none":
        return y * eta - mu - _lgamma(y + 1), y - mu, mu
    if kind == "nb":
        r = 1 / extra**2
        ll = _lgamma(y + r) - math.lgamma(r) - _lgamma(y + 1) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))
        return ll, (y - mu) * r / (r + mu), mu * r / (r + mu)
    # the mode of the normal term of each observation, then quadrature around it
    z = np.clip((np.log(y + 0.5) - eta) * extra * y / (1 + extra**2 * y), -6, 6)
    for _ in range(8):
        at = np.exp(np.clip(eta + extra * z, -30, 30))
        z = z + np.clip((extra * (y - at) - z) / (extra**2 * at + 1), -2, 2)
    at = np.exp(np.clip(eta + extra * z, -30, 30))
    wide = 1 / np.sqrt(extra**2 * at + 1)
    nodes = z[:, None] + math.sqrt(2) * wide[:, None] * _NODES
    inner = eta[:, None] + extra * nodes
    means = np.exp(np.clip(inner, -30, 30))
    logs = y[:, None] * inner - means - nodes**2 / 2 + _NODES**2 + np.log(_WEIGHTS)
    top = logs.max(1)
    parts = np.exp(logs - top[:, None])
    total = parts.sum(1)
    ll = top + np.log(total) + np.log(wide) - 0.5 * math.log(math.pi) - _lgamma(y + 1)
    return ll, y - (parts * means).sum(1) / total, at / (1 + extra**2 * at)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma by Stirling's series after shifting to arguments of 8 or more; counts repeat, so each value is worked out once."""
    x, back = np.unique(np.asarray(x, float), return_inverse=True)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        shift = np.where(low, shift - np.log(np.where(low, z, 1)), shift)
        z = np.where(low, z + 1, z)
    return (shift + (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5))[back]


class _Data:
    """Design of one year's panel: a few dense columns, codes of years, and each cell's district in the field's order."""

    def __init__(self, pdf: pd.DataFrame, edges: list[tuple[str, str]], model: Model):
        month = pd.to_datetime(pdf["month"])
        names, years = sorted(pdf["district"].unique()), sorted(month.dt.year.unique())
        self.offset = np.log(np.maximum(pdf["pop"].to_numpy(float) / 12, 0.5))
        self.y = pdf["count"].to_numpy(float)
        self.seen = np.isfinite(self.y)
        self.field = Field(names, edges)
        cols = {"intercept": np.ones((len(pdf), 1)), "season": season_design(month.dt.month.to_numpy(), model.season)}
        given = [c for c in pdf.columns if c.startswith("x_")]
        x = pdf[given].to_numpy(float) if given else np.zeros((len(pdf), 0))
        keep = x[self.seen].std(0) > 1e-10 if len(given) and self.seen.any() else np.zeros(len(given), bool)
        cols["covariates"] = (x[:, keep] - x[self.seen][:, keep].mean(0)) / x[self.seen][:, keep].std(0) if keep.any() else np.zeros((len(pdf), 0))
        self.dense = np.hstack(list(cols.values()))
        self.sizes = {k: v.shape[1] for k, v in cols.items()}
        self.year = None
        if model.year_effect != "none":
            self.year = pd.Categorical(month.dt.year, years).codes.astype(np.int64)
            self.sizes["year"] = len(years)
        self.place = self.field.place[pd.Categorical(pdf["district"], names).codes]
        levels = {"year": [str(y) for y in years], "covariates": [c for c, k in zip(given, keep, strict=True) if k]}
        self.labels = [(k, levels[k][i] if k in levels else str(i + 1)) for k, n in self.sizes.items() for i in range(n)] + [("space", names[i]) for i in self.field.order]

    @property
    def size(self) -> int:
        """Number of effects that all districts share."""
        return sum(self.sizes.values())

    def cells(self, which: np.ndarray) -> _Data:
        """The design of some cells alone."""
        part = copy(self)
        part.offset, part.y, part.seen, part.dense, part.place = self.offset[which], self.y[which], self.seen[which], self.dense[which], self.place[which]
        part.year = None if self.year is None else self.year[which]
        return part

    def log_mean(self, f: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Log of the mean of each cell; the effects are vectors, or have a row for each draw."""
        k = self.dense.shape[1]
        out = self.offset + f[..., :k] @ self.dense.T + u[..., self.place]
        return out if self.year is None else out + f[..., k:][..., self.year]

    def sums(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each shared effect and of each district, the sum of ``g`` over its cells."""
        shared = [self.dense.T @ g] + ([] if self.year is None else [np.bincount(self.year, g, self.sizes["year"])])
        return np.concatenate(shared), np.bincount(self.place, g, self.field.n)

    def curvature(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sums of ``w`` over the cells of two shared effects, of a district and a shared effect, and of a district."""
        k, n = self.dense.shape[1], self.field.n
        h, cross = np.zeros((self.size, self.size)), np.zeros((n, self.size))
        h[:k, :k] = self.dense.T @ (self.dense * w[:, None])
        for j in range(k):
            cross[:, j] = np.bincount(self.place, w * self.dense[:, j], n)
        if self.year is not None:
            m = self.sizes["year"]
            h[np.arange(k, k + m), np.arange(k, k + m)] = np.bincount(self.year, w, m)
            for j in range(k):
                h[j, k:] = h[k:, j] = np.bincount(self.year, w * self.dense[:, j], m)
            cross[:, k:] = np.bincount(self.place * m + self.year, w, n * m).reshape(n, m)
        return h, cross, np.bincount(self.place, w, n)

    def precision(self, model: Model, hyper: dict[str, float], w: np.ndarray) -> Precision:
        h, cross, weight = self.curvature(w)
        return Precision(self.field, hyper["sd"], hyper["phi"], h + _effect_prior(self.sizes, model, hyper), cross, weight, _effect_sums(self.sizes, model))


Effects = tuple[np.ndarray, np.ndarray, np.ndarray]


def start_of(d: _Data) -> Effects:
    """The mean rate for all cells."""
    f = np.zeros(d.size)
    f[0] = math.log(max(d.y.sum(), 0.5)) - math.log(np.exp(d.offset).sum())
    return np.zeros(d.field.n), np.zeros(d.field.n), f


def laplace(d: _Data, model: Model, hyper: dict[str, float], start: Effects) -> tuple[Effects, float]:
    """The mode (u, s, f), and the log marginal likelihood but for what hyperparameters do not change; ``d`` has cells with counts alone."""
    q = _effect_prior(d.sizes, model, hyper)
    scale = hyper["sd"] * math.sqrt(hyper["phi"])
    a = 1 / (hyper["sd"] ** 2 * (1 - hyper["phi"]))

    def value(u: np.ndarray, s: np.ndarray, f: np.ndarray) -> float:
        own = u - scale * s
        return float(_terms(d.y, d.log_mean(f, u), hyper["extra"], model.extra)[0].sum() - 0.5 * (a * own @ own + s @ d.field.precision(s) + f @ q @ f))

    x = start
    now = value(*x)
    for _ in range(60):
        u, s, f = x
        _, g, w = _terms(d.y, d.log_mean(f, u), hyper["extra"], model.extra)
        p = d.precision(model, hyper, w)
        gf, gu = d.sums(g)
        own = u - scale * s
        step = p.solve(gu - a * own, a * scale * own - d.field.precision(s), gf - q @ f)
        step = tuple(y - o for y, o in zip(p.hold(*(o + z for o, z in zip(x, step, strict=True))), x, strict=True))
        size = 1.0
        while size > 1e-4 and not (new := value(*(o + size * z for o, z in zip(x, step, strict=True)))) >= now - 1e-9:
            size /= 2
        x = tuple(o + size * z for o, z in zip(x, step, strict=True))
        if abs(new - now) < 1e-8 * (1 + abs(new)):
            now = new
            break
        now = new
    p = d.precision(model, hyper, _terms(d.y, d.log_mean(x[2], x[0]), hyper["extra"], model.extra)[2])
    prior = 0.5 * d.field.n * math.log(a)
    if m := d.sizes.get("year"):
        prior -= (m - (model.year_effect == "rw1" and m > 1)) * math.log(hyper["sd_year"])
    if model.season == "rw2":
        prior -= (d.sizes["season"] - 1) * math.log(hyper["sd_season"])
    return x, now + prior - 0.5 * p.logdet - 0.5 * p.logdet_held


def climb(f: Callable[[np.ndarray], float], x: np.ndarray, rounds: int = 40, h: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """The top of ``f`` by quasi-Newton steps, and the curvature there: minus the second differences, made positive."""
    n = len(x)
    unit = np.eye(n) * h
    slope = lambda v: np.array([(f(v + e) - f(v - e)) / (2 * h) for e in unit])
    inverse, now, g = np.eye(n) * 0.1, f(x), slope(x)
    for _ in range(rounds):
        step = inverse @ g
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        size = 1.0
        while size > 1e-3 and f(x + size * step) < now + 1e-4 * size * (g @ step):
            size /= 2
        if size <= 1e-3:
            break
        x_new = x + size * step
        g_new, new = slope(x_new), f(x_new)
        d, y = x_new - x, g - g_new
        if d @ y > 1e-10:
            r = np.eye(n) - np.outer(d, y) / (d @ y)
            inverse = r @ inverse @ r.T + np.outer(d, d) / (d @ y)
        done = abs(new - now) < 1e-3 and np.abs(d).max() < 1e-2
        x, g, now = x_new, g_new, new
        if done:
            break
    wide = np.eye(n) * 0.1
    top, up, down = f(x), [f(x + e) for e in wide], [f(x - e) for e in wide]
    curve = np.diag([(2 * top - u - v) / 0.01 for u, v in zip(up, down, strict=True)])
    for i in range(n):
        for j in range(i):
            curve[i, j] = curve[j, i] = -(f(x + wide[i] + wide[j]) - up[i] - up[j] + top) / 0.01
    values, axes = np.linalg.eigh(curve)
    # an axis that the data say little about is followed for two deviations of one, no further
    return x, (axes * np.maximum(values, 0.25)) @ axes.T


def design(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in ``m`` standardised axes and their weights: the centre, two on each axis, and corners of a cube, all at one distance.

    With the density of a normal distribution at the points, the weights give its mean and its variances.
    """
    corners = [c if m < 5 else (*c, math.prod(c)) for c in product((-1.0, 1.0), repeat=min(m, 4))] if m > 1 else []
    ring = [RADIUS * np.array(c) for c in corners] + [v * RADIUS * math.sqrt(m) * np.eye(m)[i] for i in range(m) for v in (-1.0, 1.0)]
    weight = math.exp(m * RADIUS**2 / 2) / (len(ring) * (RADIUS**2 - 1))
    return np.array([np.zeros(m), *ring]), np.array([1.0, *[weight] * len(ring)])


PLANS = "target int, spec string, part int, point int, theta array<double>, prior double"
POINTS = "target int, spec string, part int, point int, theta array<double>, weight double, mode array<double>"
BLOCKS = "target int, spec string, block int, theta array<double>, first int, n int, mode array<double>, sd_spatial double, phi_spatial double, sd_extra double"


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["district", "month"], kind="stable").reset_index(drop=True)


def _columns(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _split(mode: np.ndarray, d: _Data) -> Effects:
    n = d.field.n
    return mode[:n], mode[n : 2 * n], mode[2 * n :]


def planned(d: _Data, model: Model) -> list[tuple[list[float], float]]:
    """(theta, log prior and weight) of the design's points around the mode of the hyperparameters."""
    names = hyper_names(model)
    low, high = np.array([BOUNDS[k] for k in names]).T
    share = SharePrior(d.field, *model.prior_phi)
    last = [start_of(d)]

    def value(theta: np.ndarray) -> float:
        inside = np.clip(theta, low, high)
        last[0], lml = laplace(d, model, hyper_of(model, inside), last[0])
        return lml + log_prior(model, share, inside) - 10 * float(((theta - inside) ** 2).sum())

    centre, curve = climb(value, np.array([START[k] for k in names]))
    values, axes = np.linalg.eigh(curve)
    points, weights = design(len(names))
    out = []
    for z, w in zip(points, weights, strict=True):
        theta = np.clip(centre + axes @ (z / np.sqrt(values)), low, high)
        out.append((theta.tolist(), log_prior(model, share, theta) + math.log(w)))
    return out


def posterior(masked_panel: DataFrame, edges: list[tuple[str, str]], models: dict[str, Model]) -> DataFrame:
    """Blocks of draws of each target and spec: the hyperparameters of a point, its mode, the first draw and their number."""
    specs = F.explode(F.array(*[F.lit(s) for s in models])).alias("spec")
    rows = masked_panel.select("*", specs)

    def data_of(pdf: pd.DataFrame, model: Model) -> _Data:
        whole = _Data(_sorted(pdf), edges, model)
        if not whole.seen.any():
            raise ValueError("no counts to learn from")
        return whole.cells(whole.seen)

    def plan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = planned(data_of(pdf, models[key[1]]), models[key[1]])
        return pd.DataFrame([(int(key[0]), key[1], i % PARTS, i, t, p) for i, (t, p) in enumerate(points)], columns=_columns(PLANS))

    def fit_part(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        model, out = models[key[1]], []
        if not len(own):
            return pd.DataFrame(columns=_columns(POINTS))
        d = data_of(pdf, model)
        mode = start_of(d)
        for p in own.sort_values("point").itertuples(index=False):
            mode, lml = laplace(d, model, hyper_of(model, np.asarray(p.theta)), mode)
            out.append((p.target, p.spec, p.part, p.point, p.theta, lml + p.prior, np.concatenate(mode)))
        return pd.DataFrame(out, columns=_columns(POINTS))

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Which point each draw comes from, by weight; draws of one point are consecutive."""
        model = models[key[1]]
        pdf = pdf.sort_values("point").reset_index(drop=True)
        weight = np.exp(pdf["weight"] - pdf["weight"].max()).to_numpy()
        weight /= weight.sum()
        hyper = [hyper_of(model, np.asarray(t)) for t in pdf["theta"]]
        mean = {k: float(weight @ [h[k] for h in hyper]) for k in ("sd", "phi", "extra")}
        dealt = np.random.Generator(np.random.PCG64([model.seed, int(key[0])])).multinomial(model.n_draws, weight)
        out, first = [], 1
        for i in np.flatnonzero(dealt).tolist():
            for at in range(0, int(dealt[i]), BLOCK):
                n = min(BLOCK, int(dealt[i]) - at)
                out.append((int(key[0]), key[1], len(out), pdf["theta"][i], first, n, pdf["mode"][i], mean["sd"], mean["phi"], mean["extra"] if model.extra != "none" else None))
                first += n
        return pd.DataFrame(out, columns=_columns(BLOCKS))

    plans = cut(rows.groupBy("target", "spec").applyInPandas(plan, PLANS))
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    points = cut(parts.groupBy("target", "spec", "part").cogroup(plans.groupBy("target", "spec", "part")).applyInPandas(fit_part, POINTS))
    return cut(points.groupBy("target", "spec").applyInPandas(deal, BLOCKS))


def _drawn(masked_panel: DataFrame, blocks: DataFrame, models: dict[str, Model], edges: list[tuple[str, str]], schema: str, result: Callable[[int, str, pd.DataFrame, _Data, np.ndarray, np.ndarray, int, float, np.random.Generator], pd.DataFrame]) -> DataFrame:
    """``result`` of each block of draws; blocks are few for each target, so their names are broadcast."""
    names = blocks.select(F.col("target").alias("own"), F.col("spec").alias("spec"), F.col("block").alias("block"))
    rows = masked_panel.join(F.broadcast(names), F.col("target") == F.col("own")).drop("own")

    def draw(key: tuple, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        target, spec, block = int(key[0]), key[1], own.iloc[0]
        model = models[spec]
        pdf = _sorted(pdf)
        d = _Data(pdf, edges, model)
        hyper = hyper_of(model, np.asarray(block["theta"], float))
        u, s, f = _split(np.asarray(block["mode"], float), d)
        seen = d.cells(d.seen)
        p = seen.precision(model, hyper, _terms(seen.y, seen.log_mean(f, u), hyper["extra"], model.extra)[2])
        rng = np.random.Generator(np.random.PCG64([model.seed, target, int(key[2]) + 1]))
        du, _, df = p.draw(rng, int(block["n"]))
        return result(target, spec, pdf, d, f + df.T, u + du.T, int(block["first"]), hyper["extra"], rng)

    return rows.groupBy("target", "spec", "block").cogroup(blocks.groupBy("target", "spec", "block")).applyInPandas(draw, schema)


CELLS = "target int, spec string, district string, month date, y double, n long, extra double, logs double, below double, equal double, ll array<double>"


def _cell_terms(models: dict[str, Model]) -> Callable[..., pd.DataFrame]:
    """What a block of draws says of each cell with a count."""

    def terms(target: int, spec: str, pdf: pd.DataFrame, whole: _Data, f: np.ndarray, u: np.ndarray, first: int, extra: float, rng: np.random.Generator) -> pd.DataFrame:
        d, kind, n = whole.cells(whole.seen), models[spec].extra, len(f)
        ll = np.empty((len(d.y), n))
        logs, below, equal = (np.zeros(len(d.y)) for _ in range(3))
        for i in range(n):
            eta = d.log_mean(f[i], u[i])
            ll[:, i] = _terms(d.y, eta, extra, kind)[0]
            rate = np.exp(np.clip(eta, -30, 30))
            if kind == "nb":
                rate = rate * rng.gamma(1 / extra**2, extra**2, rate.shape)
            elif kind == "iid":
                rate = rate * np.exp(extra * rng.standard_normal(rate.shape))
            made = rng.poisson(rate)
            logs, below, equal = logs + eta, below + (made < d.y), equal + (made == d.y)
        own = pdf[whole.seen]
        return pd.DataFrame({"target": target, "spec": spec, "district": own["district"].to_numpy(object), "month": own["month"].to_numpy(object), "y": d.y, "n": n, "extra": extra * n, "logs": logs, "below": below, "equal": equal, "ll": list(ll)})

    return terms


def pareto_shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape, scale) of generalised Pareto distributions fitted to the rows of ``x``, ascending excesses: an empirical Bayes estimate over a grid."""
    rows, n = x.shape
    m = 30 + int(math.sqrt(n))
    quarter = np.maximum(x[:, int(n / 4 + 0.5) - 1], 1e-300)
    theta = (1 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3 * quarter[:, None]) + 1 / np.maximum(x[:, -1:], 1e-300)
    k = np.stack([np.log1p(-theta[:, j : j + 1] * x).mean(1) for j in range(m)], 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        fit = n * (np.log(-theta / k) - k - 1)
    fit = np.where(np.isfinite(fit), fit, -np.inf)
    weight = np.exp(fit - fit.max(1, keepdims=True))
    best = (theta * weight).sum(1) / weight.sum(1)
    shape = np.log1p(-best[:, None] * x).mean(1)
    return (shape * n + 5) / (n + 10), -shape / best


def left_out(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log density of each row's observation without it, tail shape) from its log likelihoods under draws, a column each.

    The weights 1 / likelihood are smoothed: the largest are replaced by quantiles of the tail fitted to them. A large
    shape says that no number of draws like these would do.
    """
    rows, n = ll.shape
    log_w = -ll - (-ll).max(1, keepdims=True)
    tail = min(n // 5, int(3 * math.sqrt(n)))
    shape = np.full(rows, np.inf if n < 25 else -np.inf)
    if n >= 25:
        order = np.argsort(log_w, 1)
        high = np.take_along_axis(log_w, order[:, -tail:], 1)
        cut_at = np.exp(np.take_along_axis(log_w, order[:, -tail - 1 : -tail], 1))
        excess = np.exp(high) - cut_at
        some = excess[:, -1] > 1e-12
        if some.any():
            k, scale = pareto_shape(np.maximum(excess[some], 1e-300))
            p = (np.arange(1, tail + 1) - 0.5) / tail
            flat = np.abs(k) < 1e-9
            safe = np.where(flat, 1.0, k)[:, None]
            quantile = np.where(flat[:, None], -scale[:, None] * np.log1p(-p), scale[:, None] * np.expm1(-safe * np.log1p(-p)) / safe)
            smooth = np.minimum(np.log(quantile + cut_at[some]), 0.0)
            fixed = log_w[some]
            np.put_along_axis(fixed, order[some][:, -tail:], smooth, 1)
            log_w[some], shape[some] = fixed, k
    both = log_w + ll
    top = both.max(1)
    loo = top + np.log(np.exp(both - top[:, None]).sum(1)) - np.log(np.exp(log_w).sum(1))
    return loo, shape


def left_out_cells(parts: DataFrame) -> DataFrame:
    """Of each cell, from the draws of all its blocks: mean and variance of its log likelihood, its log predictive density, that without it, and the tail shape."""
    sums = [F.sum(c).alias(c) for c in ("n", "extra", "logs", "below", "equal")]
    cells = parts.groupBy("target", "spec", "district", "month").agg(F.max("y").alias("y"), *sums, F.flatten(F.collect_list("ll")).alias("ll"))

    @F.pandas_udf("mean double, var double, lppd double, loo double, khat double")
    def told(column: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(column), 5))
        for at in range(0, len(column), 2048):
            ll = np.sort(np.stack(column.iloc[at : at + 2048]), 1)
            top = ll.max(1)
            lppd = top + np.log(np.exp(ll - top[:, None]).mean(1))
            out[at : at + 2048] = np.column_stack((ll.mean(1), ll.var(1, ddof=1) if ll.shape[1] > 1 else top * 0, lppd, *left_out(ll)))
        return pd.DataFrame(out, columns=["mean", "var", "lppd", "loo", "khat"])

    return cells.withColumn("x", told("ll")).select("target", "spec", "district", "month", "y", *[c for c in ("n", "extra", "logs", "below", "equal")], "x.*")


def criteria(masked_panel: DataFrame, blocks: DataFrame, models: dict[str, Model], edges: list[tuple[str, str]]) -> DataFrame:
    """DIC, WAIC, effective parameters, the share of usable CPOs and the distance of PITs from uniform, of each target and spec."""
    return summed_criteria(left_out_cells(_drawn(masked_panel, blocks, models, edges, CELLS, _cell_terms(models))), blocks, models)


def summed_criteria(told: DataFrame, blocks: DataFrame, models: dict[str, Model]) -> DataFrame:
    """The criteria from those of cells. A CPO is usable if the tail shape of its weights is at most ``TAIL``."""
    n = F.col("n")
    # a uniform number of the cell's own
    chance = F.pmod(F.xxhash64("target", "district", "month"), F.lit(1 << 40)) / float(1 << 40)
    cells = cut(told.select("target", "spec", "y", "mean", "var", "lppd", "khat", "loo", (F.col("extra") / n).alias("extra"), (F.col("logs") / n).alias("eta"), ((F.col("below") + chance * F.col("equal")) / n).alias("pit")))

    @F.pandas_udf("double")
    def at_mean(y: pd.Series, eta: pd.Series, extra: pd.Series, spec: pd.Series) -> pd.Series:
        out = np.zeros(len(y))
        for name in spec.unique():
            for e in extra[spec == name].unique():
                own = ((spec == name) & (extra == e)).to_numpy()
                out[own] = _terms(y.to_numpy(float)[own], eta.to_numpy(float)[own], float(e), models[name].extra)[0]
        return pd.Series(out)

    rows = cells.withColumn("hat", at_mean("y", "eta", F.round("extra", 9), "spec"))
    dbar, dhat = -2 * F.sum("mean"), -2 * F.sum("hat")
    usable = F.avg(((F.col("khat") <= TAIL) & ~F.isnan("loo")).cast("double"))
    found = rows.groupBy("target", "spec").agg(F.count(F.lit(1)).alias("n_obs"), (2 * dbar - dhat).alias("dic"), (-2 * (F.sum("lppd") - F.sum("var"))).alias("waic"), (dbar - dhat).alias("p_eff"), usable.alias("cpo_valid"))
    means = blocks.select("target", "spec", "sd_spatial", "phi_spatial", "sd_extra").distinct()
    done = found.join(means, ["target", "spec"]).join(pit_distance(cells, keys=("target", "spec")).select("target", "spec", "pit_ks"), ["target", "spec"], "left")
    return done.select(*_columns(FIT))


def ks_uniform(x: np.ndarray, least: int = 100) -> float | None:
    """Largest distance of the sample's distribution from uniform; None below ``least`` values."""
    x = np.sort(x[np.isfinite(x)])
    n = len(x)
    if n < least:
        return None
    i = np.arange(1, n + 1)
    return float(max((i / n - x).max(), (x - (i - 1) / n).max()))


def _small_edges(edges: DataFrame, most: int = 1_000_000) -> list[tuple[str, str]]:
    """The graph for the groups; its size is that of the map, not of the data, and is checked."""
    rows = edges.select("focal", "neighbour").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the graph has more than {most} links")
    return [(r.focal, r.neighbour) for r in rows]


def fit(masked_panel: DataFrame, edges: DataFrame, model: Model = Model()) -> DataFrame:
    """(target, district, month, draw, expected) of every masked cell."""
    links, models = _small_edges(edges), {model.extra: model}

    def cells(target: int, spec: str, pdf: pd.DataFrame, d: _Data, f: np.ndarray, u: np.ndarray, first: int, extra: float, rng: np.random.Generator) -> pd.DataFrame:
        own = pdf["inside"].to_numpy(bool)
        eta = d.cells(own).log_mean(f, u)
        if spec == "iid":
            eta = eta + extra * rng.standard_normal(eta.shape)
        inside, n = pdf[own], len(f)
        return pd.DataFrame({"target": target, "district": np.tile(inside["district"].to_numpy(object), n), "month": np.tile(inside["month"].to_numpy(object), n), "draw": np.repeat(np.arange(first, first + n), len(inside)), "expected": np.exp(np.clip(eta, -30, 30)).ravel()})

    return _drawn(masked_panel, posterior(masked_panel, links, models), models, links, DRAWS, cells)


LATENT = "target int, effect string, level string, draw int, value double"


def effects(masked_panel: DataFrame, edges: DataFrame, model: Model = Model()) -> DataFrame:
    """(target, effect, level, mean, q05, median, q95) of every effect on the log scale: intercept, season, covariates, years and space.

    exp of a quantile is a rate ratio; the rows of effect "space" are the districts' spatial effects.
    """
    links, models = _small_edges(edges), {model.extra: model}

    def latent(target: int, spec: str, pdf: pd.DataFrame, d: _Data, f: np.ndarray, u: np.ndarray, first: int, extra: float, rng: np.random.Generator) -> pd.DataFrame:
        n, draws = len(f), np.hstack((f, u))
        names = [np.tile(np.array([label[i] for label in d.labels], object), n) for i in (0, 1)]
        return pd.DataFrame({"target": target, "effect": names[0], "level": names[1], "draw": np.repeat(np.arange(first, first + n), draws.shape[1]), "value": draws.ravel()})

    rows = _drawn(masked_panel, posterior(masked_panel, links, models), models, links, LATENT, latent)
    q = {name: F.percentile("value", F.lit(p)).alias(name) for name, p in (("q05", 0.05), ("median", 0.5), ("q95", 0.95))}
    return rows.groupBy("target", "effect", "level").agg(F.avg("value").alias("mean"), *q.values())


def compare_overdispersion(masked_panel: DataFrame, edges: DataFrame, specs: tuple[str, ...] = ("none", "iid", "nb"), model: Model = Model(n_draws=200)) -> DataFrame:
    """Criteria of each extra term; all fits run side by side."""
    links, models = _small_edges(edges), {s: replace(model, extra=s) for s in specs}
    return criteria(masked_panel, posterior(masked_panel, links, models), models, links)


def recommend(criteria: DataFrame) -> DataFrame:
    """``criteria`` with why a term is excluded, and the recommended one: the smallest PIT distance of those left."""
    pegged = F.col("phi_spatial").isNotNull() & ((F.col("phi_spatial") > PHI_HIGH) | (F.col("phi_spatial") < PHI_LOW))
    why = F.concat_ws(", ", F.when(F.col("cpo_valid") < CPO_SHARE, "cpo"), F.when(F.col("p_eff") / F.col("n_obs") > P_EFF_SHARE, "p_eff"), F.when(pegged, "phi"))
    rows = criteria.withColumn("excluded", why)
    best = rows.filter("excluded = '' and pit_ks is not null").groupBy("target").agg(F.min_by("spec", F.struct("pit_ks", "spec")).alias("recommended"))
    return rows.join(best, "target", "left")


def covariate_standardise(panel: DataFrame, names: list[str], log_names: tuple[str, ...] = ()) -> DataFrame:
    """``panel`` with x_<name>: covariates centred and scaled over all rows, log1p first where asked; constant ones are dropped."""
    value = {c: (F.log1p(F.col(c)) if c in log_names else F.col(c).cast("double")) for c in names}
    stats = panel.agg(*[f(v).alias(f"{n}_{c}") for c, v in value.items() for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = panel.join(F.broadcast(stats), F.lit(True))
    scaled = {f"x_{c}": F.when(F.col(f"s_{c}") >= 1e-10, (v - F.col(f"m_{c}")) / F.col(f"s_{c}")) for c, v in value.items()}
    return out.withColumns(scaled).drop(*stats.columns)


def pit_distance(pits: DataFrame, value: str = "pit", least: int = 100, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n, pit_ks): the distance of a column from uniform without sorting it in one task.

    Equal values are counted first; values are ranked inside fixed ranges of the unit interval; a range's start is the
    number of values before it.
    """
    rows = pits.select(*keys, F.col(value).alias("x")).filter("x >= 0 and x <= 1").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("c")).withColumn("cell", F.floor(F.col("x") * 1024))
    sizes = rows.groupBy(*keys, "cell").agg(F.sum("c").alias("many"))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "cell", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"), F.sum("many").over(Window.partitionBy(*keys)).alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*keys, "cell").orderBy("x"))
    ranked = rows.withColumn("upto", upto).join(starts, [*keys, "cell"])
    i = F.col("base") + F.col("upto")
    gap = F.greatest(i / F.col("n") - F.col("x"), F.col("x") - (i - F.col("c")) / F.col("n"))
    found = ranked.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(gap).alias("d"))
    return found.select(*keys, "n", F.when(F.col("n") >= least, F.col("d")).alias("pit_ks"))
