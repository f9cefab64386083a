"""Faults of polygons by hand, and crossings against all pairs of sides."""

import math
import time

import numpy as np

from survperf.operators import validity

VERTEX = "district string, part int, ring int, seq int, x double, y double"


def rows_of(polygons):
    """``polygons``: by district a list of (part, ring, points)."""
    return [(d, part, ring, i, float(x), float(y)) for d, rings in polygons.items() for part, ring, points in rings for i, (x, y) in enumerate(points)]


def box(x, y, side, side_y=None):
    h = side if side_y is None else side_y
    return [(x, y), (x + side, y), (x + side, y + h), (x, y + h), (x, y)]


def faults(spark, polygons):
    out = {}
    for r in validity.geometry_faults(spark.createDataFrame(rows_of(polygons), VERTEX)).collect():
        out.setdefault(r.district, set()).add(r.fault)
    return out


def test_faults_by_hand(spark):
    got = faults(
        spark,
        {
            "fine": [(0, 0, box(0, 0, 10)), (0, 1, box(2, 2, 2)), (0, 2, box(6, 6, 2)), (1, 0, box(20, 0, 5)), (2, 0, box(2.5, 2.5, 1))],
            "touching hole": [(0, 0, box(0, 0, 10)), (0, 1, [(0, 5), (3, 4), (3, 6), (0, 5)])],
            "parts touch": [(0, 0, box(0, 0, 1)), (1, 0, box(1, 1, 1))],
            "parts share a side": [(0, 0, box(0, 0, 1)), (1, 0, box(1, 0, 1))],
            "hole out": [(0, 0, box(0, 0, 10)), (0, 1, box(20, 20, 1))],
            "hole across": [(0, 0, box(0, 0, 10)), (0, 1, box(8, 8, 4))],
            "holes nested": [(0, 0, box(0, 0, 10)), (0, 1, box(1, 1, 8)), (0, 2, box(3, 3, 2))],
            "part in part": [(0, 0, box(0, 0, 10)), (1, 0, box(3, 3, 1))],
            "bow": [(0, 0, [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])],
            "spike": [(0, 0, [(0, 0), (4, 0), (4, 4), (4, 6), (4, 4), (0, 4), (0, 0)])],
            "repeated vertex": [(0, 0, [(0, 0), (0, 0), (1, 0), (1, 1), (1, 1), (0, 0)])],
            "open": [(0, 0, box(0, 0, 1)[:-1])],
            "nan": [(0, 0, [(0, 0), (math.nan, 0), (1, 1), (0, 0)])],
            "mixed": [(0, 0, box(0, 0, 1)[:3]), (1, 0, [(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)])],
            "long and short": [(0, 0, [(0, 0), (1e6, 0), (1e6, 1), (500, 1), (500, -1e-3), (499, -1e-3), (499, 1), (0, 1), (0, 0)])],
        },
    )
    assert got == {
        "parts share a side": {"crossing"}, "hole out": {"hole outside"}, "hole across": {"crossing"}, "holes nested": {"nested holes"}, "part in part": {"nested parts"},
        "bow": {"crossing"}, "spike": {"crossing"}, "open": {"open"}, "nan": {"not finite"}, "mixed": {"short", "crossing"}, "long and short": {"crossing"},
    }


def meet(p, q):
    """Whether two sides have a point in common."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = p, q
    side = lambda x, y, u, v, s, t: np.sign((u - x) * (t - y) - (v - y) * (s - x))
    over = max(min(ax, bx), min(cx, dx)) <= min(max(ax, bx), max(cx, dx)) and max(min(ay, by), min(cy, dy)) <= min(max(ay, by), max(cy, dy))
    return over and side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) <= 0 and side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) <= 0


def test_crossings_against_all_pairs(spark):
    """Random rings with sides of very different lengths."""
    rng = np.random.default_rng(2)
    polygons, want = {}, set()
    for i in range(60):
        n = int(rng.integers(4, 12))
        angle = np.sort(rng.uniform(0, 2 * math.pi, n))
        radius = np.exp(rng.uniform(0, 3, n))
        points = [(float(r * math.cos(a)), float(r * math.sin(a))) for r, a in zip(radius, angle, strict=True)]
        if i % 2:
            a, b = rng.integers(0, n, 2)
            points[a], points[b] = points[b], points[a]
        points.append(points[0])
        polygons[f"p{i}"] = [(0, 0, points)]
        sides = [(*points[j], *points[j + 1]) for j in range(n)]
        if any(meet(sides[a], sides[b]) for a in range(n) for b in range(a + 2, n) if not (a == 0 and b == n - 1)):
            want.add(f"p{i}")
    assert {d for d, f in faults(spark, polygons).items() if "crossing" in f} == want and 5 < len(want) < 55


def test_large_rings_take_time_in_proportion(spark):
    """A ring of 100,000 sides with long ones among short ones; a side moved across its neighbours is found."""
    def ring(n):
        t = np.linspace(0, 2 * math.pi, n, endpoint=False)
        r = 10 + 0.001 * np.sin(50 * t)
        return [*zip((r * np.cos(t)).tolist(), (r * np.sin(t)).tolist(), strict=True)]

    took = {}
    for n in (20_000, 100_000):
        good = [*ring(n), ring(n)[0]]
        bad = [*good[:500], good[520], *good[501:]]
        df = spark.createDataFrame(rows_of({"good": [(0, 0, good)], "bad": [(0, 0, bad)]}), VERTEX).cache()
        df.count()
        began = time.time()
        assert [tuple(r) for r in validity.geometry_faults(df).collect()] == [("bad", "crossing")]
        took[n] = time.time() - began
    assert took[100_000] < 12 * took[20_000] + 10
