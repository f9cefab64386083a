"""Nearest districts, components and dissolved provinces against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from survperf.operators import graph, outline

VERTEX = "district string, part int, ring int, seq int, x double, y double"
CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]


@pytest.mark.parametrize("kind", ["spread", "clustered", "line", "same"])
def test_nearest_against_all_pairs(spark, kind):
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 100, (300, 2))
    if kind == "clustered":
        xy[:280] = xy[:280] / 1000 + 50
    elif kind == "line":
        xy[:, 1] = 7.0
    elif kind == "same":
        xy[:] = xy[0]
    names = [f"d{i:03d}" for i in range(len(xy))]
    df = spark.createDataFrame([(n, float(x), float(y)) for n, (x, y) in zip(names, xy, strict=True)], "district string, cx double, cy double")
    seekers = df.filter("district like '%7' or district like '%2'")
    got = {r.focal: r.neighbour for r in graph.nearest(seekers, df).collect()}
    want = {}
    for i, n in enumerate(names):
        if n[-1] in "72":
            want[n] = min((math.hypot(*(xy[i] - xy[j])), m) for j, m in enumerate(names) if j != i)[1]
    assert got == want
    assert graph.nearest(df.limit(1), df.limit(1)).count() == 0 and graph.nearest(df.limit(0), df).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(f"p{i:04d}", f"p{i + 1:04d}") for i in range(300)] + [("hub", f"s{i}") for i in range(100)] + [("x", "y"), ("z", "z")]
    nodes = sorted({n for e in edges for n in e} | {"alone"})
    root = {n: n for n in nodes}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "focal string, neighbour string")
    got = {r.district: r.component for r in graph.components(spark.createDataFrame([(n,) for n in nodes], "district string"), df).collect()}
    assert got == root


def cells(spark, owner, shake=0.0, turn=()):
    """Unit squares of a grid; those in ``turn`` run the other way round."""
    rng = np.random.default_rng(1)
    rows = []
    for (i, j), _ in owner.items():
        ring = CORNERS[::-1] if (i, j) in turn else CORNERS
        moved = [(i + a + shake * rng.uniform(-1, 1), j + b + shake * rng.uniform(-1, 1)) for a, b in ring[:-1]]
        rows += [(f"{i}-{j}", 0, 0, s, float(x), float(y)) for s, (x, y) in enumerate([*moved, moved[0]])]
    return spark.createDataFrame(rows, VERTEX), spark.createDataFrame([(f"{i}-{j}", p) for (i, j), p in owner.items()], "district string, province string")


def traced(owner, province):
    """(corners, area) of each ring of a province of unit squares, by walking along its border with the inside to the left."""
    own = {c for c, p in owner.items() if p == province}
    sides = defaultdict(list)
    for i, j in own:
        for (ax, ay), (bx, by), beside in (((i, j), (i + 1, j), (i, j - 1)), ((i + 1, j), (i + 1, j + 1), (i + 1, j)), ((i + 1, j + 1), (i, j + 1), (i, j + 1)), ((i, j + 1), (i, j), (i - 1, j))):
            if beside not in own:
                sides[ax, ay].append((bx, by))
    rings = []
    while sides:
        start = at = min(sides)
        heading, ring = None, []
        while True:
            ways = sides[at]
            if heading is None:
                to = ways[0]
            else:  # left, ahead, right
                left = (-heading[1], heading[0])
                to = next(t for d in (left, heading, (heading[1], -heading[0])) for t in ways if (t[0] - at[0], t[1] - at[1]) == d)
            ways.remove(to)
            if not ways:
                del sides[at]
            heading = (to[0] - at[0], to[1] - at[1])
            ring.append(at)
            at = to
            if at == start:
                break
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
        rings.append((len(ring), area))
    return sorted(rings)


@pytest.mark.parametrize("shake", [0.0, 3e-6])
def test_rings_of_provinces(spark, shake):
    """Shells, holes, an island in a hole, and squares of one province that touch in a corner."""
    owner = {(i, j): "outer" for i in range(9) for j in range(9)}
    owner |= {(i, j): "inner" for i in range(2, 5) for j in range(2, 5)} | {(3, 3): "outer", (7, 7): "holes", (0, 3): "holes"}
    owner |= {(20, 20): "corner", (11, 11): "corner", (12, 10): "corner", (10, 11): "other", (11, 10): "other"}
    v, who = cells(spark, owner, shake, turn={(1, 1), (3, 3), (20, 20)})
    rings = outline.province_rings(v, who).cache()
    got = defaultdict(list)
    for r in outline.ring_measures(rings).collect():
        got[r.province].append((r.sides, round(r.area, 3) + 0.0))
    assert {p: sorted(x) for p, x in got.items()} == {p: traced(owner, p) for p in set(owner.values())}
    assert sorted(got["outer"])[0] == (4, -1.0) and (12, -9.0) in got["outer"] and (4, 1.0) in got["outer"]
    for key, points in _by_ring(rings).items():
        assert points[0][1:] == points[-1][1:] and [p[0] for p in points] == list(range(len(points))), key
    total = {r.province: r.area for r in outline.province_measures(rings).collect()}
    assert total == {p: pytest.approx(sum(q == p for q in owner.values()), abs=1e-3) for p in total}


def _by_ring(rings):
    out = defaultdict(list)
    for r in rings.orderBy("province", "ring", "seq").collect():
        out[r.province, r.ring].append((r.seq, r.x, r.y))
    return out


def test_a_long_outline(spark):
    """One province of many squares: a ring of hundreds of sides is ranked in a few rounds."""
    owner = {(i, j): "p" for i in range(120) for j in (0, 1) if j == 0 or i % 2}
    v, who = cells(spark, owner)
    (m,) = outline.ring_measures(outline.province_rings(v, who)).collect()
    assert [(m.sides, m.area)] == traced(owner, "p") and m.sides > 350


def test_holes_of_districts_and_overlaps(spark):
    ring = lambda r, x, y, side, turn: [("h", 0, r, s, float(x + a * side), float(y + b * side)) for s, (a, b) in enumerate(CORNERS[::-1] if turn else CORNERS)]
    df = spark.createDataFrame(ring(0, 0, 0, 5, True) + ring(1, 1, 1, 2, False), VERTEX)
    who = spark.createDataFrame([("h", "p"), ("a", "q"), ("b", "q")], "district string, province string")
    got = sorted((r.sides, r.area) for r in outline.ring_measures(outline.province_rings(df, who)).collect())
    assert got == [(4, -4.0), (4, 25.0)]
    assert outline.province_rings(df.limit(0), who).count() == 0
    bad = spark.createDataFrame([("a", 0, 0, s, float(x), float(y)) for s, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], VERTEX)
    with pytest.raises(ValueError, match="do not close"):
        outline.province_rings(bad, who).count()


def test_chains_of_near_vertices_move_together(spark):
    rows = [("a", 0, 0, i, i * 0.9e-5, 0.0) for i in range(20)] + [("b", 0, 0, 0, 1.0, 1.0)]
    got = outline.snapped(spark.createDataFrame(rows, VERTEX)).select("district", "x").distinct().collect()
    assert sorted(map(tuple, got)) == [("a", 0.0), ("b", 1.0)] and F is not None
