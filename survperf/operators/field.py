"""A Gaussian field on a map's graph by sparse blocks: order, Cholesky factors, scaling, and the prior of its share.

Districts are ordered by their distance from an outer one of their component. A link joins districts of one
level or of neighbouring levels, so in this order every precision matrix here is block-tridiagonal, and its factor fills in blocks of two
neighbouring levels alone: on a map of n districts about sqrt(n) levels of sqrt(n) districts, n^1.5 numbers and n^2
multiplications where a dense matrix has n^2 and n^3.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np


class Factor:
    """The Cholesky factor of a block-tridiagonal matrix: diagonal blocks, and blocks ``below[i]`` that join level i + 1 to level i."""

    def __init__(self, blocks: list[np.ndarray], below: list[np.ndarray]) -> None:
        self.inverse: list[np.ndarray] = []  # of the diagonal blocks of the factor
        self.below: list[np.ndarray] = []
        self.logdet = 0.0
        self.at = np.cumsum([0, *map(len, blocks)])
        for i, block in enumerate(blocks):
            if i:
                self.below.append(below[i - 1] @ self.inverse[-1].T)
                block = block - self.below[-1] @ self.below[-1].T
            low = np.linalg.cholesky(block)
            self.logdet += 2 * np.log(np.diag(low)).sum()
            self.inverse.append(np.linalg.inv(low))

    def _cut(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[a:b] for a, b in zip(self.at, self.at[1:], strict=False)]

    def half(self, z: np.ndarray) -> np.ndarray:
        """The transposed factor's inverse times ``z``: of independent normal numbers, draws with the matrix as precision."""
        out = self._cut(z)
        for i in reversed(range(len(out))):
            r = out[i] if i + 1 == len(out) else out[i] - self.below[i].T @ out[i + 1]
            out[i] = self.inverse[i].T @ r
        return np.concatenate(out) if out else z

    def solve(self, r: np.ndarray) -> np.ndarray:
        """The matrix' inverse times ``r``, a vector or columns."""
        out = self._cut(r)
        for i in range(len(out)):
            out[i] = self.inverse[i] @ (out[i] if i == 0 else out[i] - self.below[i - 1] @ out[i - 1])
        return self.half(np.concatenate(out)) if out else r

    def variances(self) -> np.ndarray:
        """The diagonal of the inverse, of which only the blocks along it are formed."""
        out: list[np.ndarray] = []
        later = None
        for i in reversed(range(len(self.inverse))):
            own = self.inverse[i].T @ self.inverse[i]
            if later is not None:
                g = self.inverse[i].T @ self.below[i].T
                own = own + g @ later @ g.T
            out.append(np.diag(own))
            later = own
        return np.concatenate(out[::-1]) if out else np.zeros(0)


class Field:
    """The intrinsic field of a graph, scaled in each component to a geometric mean variance of 1; districts without links are independent.

    ``order`` has the names' places in the field's order and ``place`` the field's place of each name; ``component``
    numbers the components of more than one district, -1 elsewhere.
    """

    def __init__(self, names: list[str], edges: list[tuple[str, str]]) -> None:
        n = self.n = len(names)
        number = {name: i for i, name in enumerate(names)}
        links = sorted({(min(a, b), max(a, b)) for a, b in ((number[x], number[y]) for x, y in edges if x in number and y in number) if a != b})
        near: list[list[int]] = [[] for _ in range(n)]
        for a, b in links:
            near[a].append(b)
            near[b].append(a)
        depth, component, parts = np.zeros(n, int), np.full(n, -1), 0
        for start in range(n):
            if near[start] and component[start] < 0:
                far, _ = _reach(near, _reach(near, start)[0])
                _, seen = _reach(near, far)
                for i, d in seen.items():
                    depth[i], component[i] = d, parts
                parts += 1
        self.order = np.lexsort((np.arange(n), depth))
        self.place = np.empty(n, int)
        self.place[self.order] = np.arange(n)
        self.component, self.parts = component[self.order], parts
        self.at = np.searchsorted(depth[self.order], np.arange((depth.max(initial=0) if n else -1) + 2))
        ends = self.place[np.array(links, int).reshape(-1, 2)]
        level = depth[self.order]
        size = np.diff(self.at)
        self.blocks = [np.zeros((k, k)) for k in size]
        self.below = [np.zeros((b, a)) for a, b in zip(size, size[1:], strict=False)]
        for i, j in np.sort(ends, 1).tolist():
            a, b = level[i], level[j]
            p, q = i - self.at[a], j - self.at[b]
            if a == b:
                self.blocks[a][p, q] -= 1
                self.blocks[a][q, p] -= 1
            else:
                self.below[a][q, p] -= 1
            self.blocks[a][p, p] += 1
            self.blocks[b][q, q] += 1
        self._scale()

    def _scale(self) -> None:
        """Scale each component by the variances of its field that sums to zero."""
        ground = np.zeros(self.n)
        ground[self.component < 0] = 1.0
        first = np.array([np.flatnonzero(self.component == c)[0] for c in range(self.parts)], int)
        ground[first] = 1.0  # the same solutions for what sums to zero
        whole = self.factor(1.0, ground)
        member = (self.component[:, None] == np.arange(self.parts)).astype(float)
        count, rows = member.sum(0), whole.solve(member)
        c = np.maximum(self.component, 0)
        inside = self.component >= 0
        var = whole.variances()
        if self.parts:
            own = rows[np.arange(self.n), c]
            var = np.where(inside, var - 2 * own / count[c] + ((member * rows).sum(0) / count**2)[c], 1.0)
        log_var = np.log(np.maximum(var, 1e-300))
        self.factors = np.exp(np.array([log_var[self.component == k].mean() for k in range(self.parts)]))
        times = np.where(inside, self.factors[c], 1.0) if self.parts else np.ones(self.n)
        self.trace = float((var / times).sum())
        #: Of the scaled matrix, the log of the product of its eigenvalues but for the zeros.
        self.log_product = whole.logdet + float(np.log(count).sum() + ((count - 1) * np.log(self.factors)).sum())
        cut = [times[a:b] for a, b in zip(self.at, self.at[1:], strict=False)]
        alone = [~inside[a:b] for a, b in zip(self.at, self.at[1:], strict=False)]
        self.blocks = [b * t[:, None] + np.diag(s.astype(float)) for b, t, s in zip(self.blocks, cut, alone, strict=True)]
        self.below = [b * t[:, None] for b, t in zip(self.below, cut[1:], strict=True)]
        self.sums = member.T  # each component's sum, which is held at zero

    def factor(self, times: float, add: np.ndarray) -> Factor:
        """The factor of ``times`` the field's precision plus a diagonal."""
        return Factor([times * b + np.diag(add[i:j]) for b, i, j in zip(self.blocks, self.at, self.at[1:], strict=False)], [times * b for b in self.below])

    def precision(self, x: np.ndarray) -> np.ndarray:
        """The field's precision times ``x``."""
        cut = [x[a:b] for a, b in zip(self.at, self.at[1:], strict=False)]
        out = [b @ v for b, v in zip(self.blocks, cut, strict=True)]
        for i, b in enumerate(self.below):
            out[i] = out[i] + b.T @ cut[i + 1]
            out[i + 1] = out[i + 1] + b @ cut[i]
        return np.concatenate(out) if out else x

    def divergence(self, phi: float) -> float:
        """Of a field with the share ``phi`` of structure from an unstructured one: the Kullback-Leibler divergence, but for the components' levels, which are held at zero.

        It asks for the sum of log((1 - phi) + phi / e) over the positive eigenvalues e of the precision, here through a factor.
        """
        sum_log = self.factor(1 - phi, np.full(self.n, phi)).logdet - self.parts * math.log(phi) - self.log_product
        return 0.5 * (phi * (self.trace - self.n + self.parts) - sum_log)


def _reach(near: list[list[int]], start: int) -> tuple[int, dict[int, int]]:
    """The last one reached from ``start``, and how many links lie between it and each."""
    seen, wait, last = {start: 0}, deque([start]), start
    while wait:
        last = wait.popleft()
        for i in near[last]:
            if i not in seen:
                seen[i] = seen[last] + 1
                wait.append(i)
    return last, seen


class SharePrior:
    """A prior of the structured share phi: the distance sqrt(2 divergence) from no structure is exponential up to that of phi = 1, with P(phi < u) = alpha.

    The rate has no closed form and is found by bisection; it is negative where alpha is less than the distance's own share.
    """

    def __init__(self, field: Field, u: float, alpha: float, points: int = 57) -> None:
        self.logit = np.linspace(-8, 8, points)
        phi = 1 / (1 + np.exp(-self.logit))
        distance = np.sqrt(2 * np.maximum([field.divergence(p) for p in phi], 1e-14))
        self.log_distance = np.log(distance)
        self.slope = np.maximum(np.gradient(self.log_distance, self.logit), 1e-9)
        self.most = math.sqrt(2 * max(field.divergence(1.0), 1e-14))
        low, high = -200 / self.most, 200 / self._distance(u)
        for _ in range(200):
            self.rate = (low + high) / 2
            low, high = (self.rate, high) if self.cdf(u) < alpha else (low, self.rate)

    def _distance(self, phi: float) -> float:
        return math.exp(np.interp(math.log(phi / (1 - phi)), self.logit, self.log_distance))

    def cdf(self, phi: float) -> float:
        d = min(self._distance(phi), self.most)
        return d / self.most if abs(self.rate * self.most) < 1e-9 else math.expm1(-self.rate * d) / math.expm1(-self.rate * self.most)

    def log_density(self, logit: float) -> float:
        """On the scale of log(phi / (1 - phi))."""
        log_d = float(np.interp(logit, self.logit, self.log_distance))
        level = 1 / self.most if abs(self.rate * self.most) < 1e-9 else self.rate / -math.expm1(-self.rate * self.most)
        return math.log(level) - self.rate * math.exp(log_d) + log_d + math.log(np.interp(logit, self.logit, self.slope))


class Precision:
    """The normal distribution around a mode: effects f of all cells, a district's effect u and its structured part s.

    u given s is independent, so it is eliminated first, then s by its sparse factor, then f. ``sums`` and ``effect_sums``
    are linear sums of s and f that are held at zero.
    """

    RIDGE = 1e-7

    def __init__(self, field: Field, sd: float, phi: float, h: np.ndarray, cross: np.ndarray, weight: np.ndarray, effect_sums: np.ndarray) -> None:
        self.a, self.c = 1 / (sd**2 * (1 - phi)), math.sqrt(phi) / (sd * (1 - phi))
        self.r, self.e = cross, 1 / (self.a + weight)
        self.field = field.factor(1.0, phi / (1 - phi) - self.c**2 * self.e + self.RIDGE)
        mixed = self.c * self.e[:, None] * cross
        self.z = self.field.solve(mixed)
        self.top = np.linalg.cholesky(h - cross.T @ (self.e[:, None] * cross) - mixed.T @ self.z)
        self.logdet = float(-np.log(self.e).sum() + self.field.logdet + 2 * np.log(np.diag(self.top)).sum())
        self.sums = np.vstack((field.sums, np.zeros((len(effect_sums), field.n))))
        self.effect_sums = np.vstack((np.zeros((field.parts, h.shape[0])), effect_sums))
        self.pull = self.solve(np.zeros((self.sums.shape[1], len(self.sums))), self.sums.T, self.effect_sums.T)
        self.held = self.sums @ self.pull[1] + self.effect_sums @ self.pull[2]
        self.logdet_held = float(np.linalg.slogdet(self.held)[1]) if len(self.held) else 0.0

    def _effects(self, r: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.top.T, np.linalg.solve(self.top, r))

    def _times(self, x: np.ndarray) -> np.ndarray:
        return (self.e * x.T).T

    def solve(self, u: np.ndarray, s: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The covariance times (u, s, f)."""
        eu = self._times(u)
        q = self.field.solve(s + self.c * eu)
        out_f = self._effects(f - self.r.T @ eu - self.r.T @ (self.c * self._times(q)))
        out_s = q - self.z @ out_f
        return eu + self._times(self.c * out_s - self.r @ out_f), out_s, out_f

    def hold(self, u: np.ndarray, s: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, s, f), vectors or columns, conditioned on their sums being zero."""
        if not len(self.held):
            return u, s, f
        much = np.linalg.solve(self.held, self.sums @ s + self.effect_sums @ f)
        return u - self.pull[0] @ much, s - self.pull[1] @ much, f - self.pull[2] @ much

    def draw(self, rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Columns of ``n`` draws around zero."""
        f = np.linalg.solve(self.top.T, rng.standard_normal((len(self.top), n)))
        s = self.field.half(rng.standard_normal((len(self.e), n))) - self.z @ f
        u = (np.sqrt(self.e) * rng.standard_normal((n, len(self.e)))).T + self._times(self.c * s - self.r @ f)
        return self.hold(u, s, f)
