"""Contiguity graphs from polygon vertices, island repair, components and degrees."""

from __future__ import annotations

import math
import struct

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.session import cut, written

SNAP = 1e-5
#: Side of a cell in snaps, and where cells begin: round coordinates, which maps often have, lie off the borders of cells.
CELL, BEGIN = 8, 0.381966


def wkb_vertices(boundaries: DataFrame, id_col: str, wkb_col: str = "geometry") -> DataFrame:
    """(district, part, ring, seq, x, y): vertices of WKB polygons and multipolygons."""
    schema = "district string, part int, ring int, seq int, x double, y double"

    def parse(batches):
        for b in batches:
            out = []
            for name, data in zip(b["id"], b["wkb"], strict=True):
                if data is not None:
                    out += [(name, *row) for row in polygon_vertices(bytes(data))]
            yield pd.DataFrame(out, columns=["district", "part", "ring", "seq", "x", "y"])

    return boundaries.select(F.col(id_col).cast("string").alias("id"), F.col(wkb_col).alias("wkb")).mapInPandas(parse, schema)


def polygon_vertices(data: bytes) -> list[tuple[int, int, int, float, float]]:
    """(part, ring, seq, x, y) of a polygon or multipolygon in WKB."""
    at = 0

    def take(fmt: str):
        nonlocal at
        got = struct.unpack_from(end + fmt, data, at)
        at += struct.calcsize(end + fmt)
        return got

    def header() -> int:
        nonlocal at, end
        end = "<" if data[at] else ">"
        at += 1
        return take("I")[0] & 0xFF

    def rings(part: int) -> list:
        out = []
        for ring in range(take("I")[0]):
            n = take("I")[0]
            xy = take(f"{2 * n}d")
            out += [(part, ring, i, xy[2 * i], xy[2 * i + 1]) for i in range(n)]
        return out

    end = "<"
    kind = header()
    if kind == 3:
        return rings(0)
    if kind != 6:
        raise ValueError(f"geometry type {kind} is neither polygon nor multipolygon")
    out = []
    for part in range(take("I")[0]):
        header()
        out += rings(part)
    return out


def meeting(points: DataFrame, snap: float = SNAP) -> DataFrame:
    """(p, q): structs of all rows of ``points`` (x, y, ...) and those at most ``snap`` away, a point and itself included.

    A spatial hash: a point lies in one cell of ``CELL`` snaps and looks into each that a square around it touches, most often one;
    what meets there is measured. Points without finite coordinates meet none. Both sides are shuffled, whatever size the planner
    guesses: vertices made of few bytes in each row of a file would else be broadcast through the driver.
    """
    if snap < 0:
        raise ValueError("snap is not negative")
    size, reach = CELL * snap or 1.0, 1.5 * snap
    cell = lambda c, by: F.floor((F.col(c) + by) / size + BEGIN)
    rows = points.filter("abs(x) < 1e300 and abs(y) < 1e300")
    home = rows.select(F.struct("*").alias("q"), cell("x", 0.0).alias("gx"), cell("y", 0.0).alias("gy"))
    looks = rows.select(F.struct("*").alias("p"), F.explode(F.sequence(cell("x", -reach), cell("x", reach))).alias("gx"), F.sequence(cell("y", -reach), cell("y", reach)).alias("ys"))
    met = looks.select("p", "gx", F.explode("ys").alias("gy")).join(home.hint("merge"), ["gx", "gy"])
    dx, dy = F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")
    return met.filter(dx * dx + dy * dy <= snap * snap).select("p", "q")


def contiguity(vertices: DataFrame, rule: str = "queen", snap: float = SNAP) -> DataFrame:
    """(focal, neighbour): districts with a pair of vertices at most ``snap`` apart (queen), or two such pairs (rook), in both directions.

    A shared border needs shared vertices: one that meets another in mid-segment is not seen.
    """
    if rule not in ("queen", "rook"):
        raise ValueError("rule is 'queen' or 'rook'")
    pairs = meeting(vertices.select("district", "x", "y").distinct(), snap).filter("p.district <> q.district")
    shared = pairs.groupBy(F.col("p.district").alias("focal"), F.col("q.district").alias("neighbour")).agg(F.count(F.lit(1)).alias("n"))
    return shared.filter(F.col("n") >= (1 if rule == "queen" else 2)).select("focal", "neighbour")


def centroids(vertices: DataFrame) -> DataFrame:
    """(district, cx, cy): area-weighted centroid of all rings, holes subtracted by their direction.

    Areas are taken from a ring's first vertex: far from the origin products of coordinates lose the digits that a small district's area has.
    """
    order = Window.partitionBy("district", "part", "ring").orderBy("seq")
    ahead = {"x2": F.lead("x").over(order), "y2": F.lead("y").over(order), "x0": F.first("x").over(order), "y0": F.first("y").over(order)}
    nxt = vertices.withColumns(ahead).filter("x2 is not null")
    cross = (F.col("x") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y") - F.col("y0"))
    sums = nxt.groupBy("district").agg(F.sum(cross).alias("a"), F.sum((F.col("x") + F.col("x2") + F.col("x0")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y2") + F.col("y0")) * cross).alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    flat = F.abs("a") < 1e-15
    return sums.select("district", F.when(flat, F.col("mx")).otherwise(F.try_divide("sx", 3 * F.col("a"))).alias("cx"), F.when(flat, F.col("my")).otherwise(F.try_divide("sy", 3 * F.col("a"))).alias("cy"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` with their number from 0 in an order; they are sorted by ranges, whose sizes alone pass through one task."""
    at = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return at.join(F.broadcast(starts), "part").withColumn(name, F.col("start") + F.col("at").bitwiseAND(F.lit(2**33 - 1))).drop("at", "part", "start")


def packed(centres: DataFrame, leaf: int = 8) -> DataFrame:
    """(cx, cy, lo, hi, square): the places of ``centres`` (district, cx, cy) with their two smallest districts, ``leaf`` places to a square.

    Squares follow a curve through the map that goes by the order of the places, not by their distance: the digits of a place's numbers from the
    left and from below are taken in turn. However crowded a part of the map is, it has squares enough. A place of one district has it twice.
    """
    found = centres.filter("abs(cx) < 1e300 and abs(cy) < 1e300").select("district", "cx", "cy")
    first = found.withColumn("i", F.dense_rank().over(Window.partitionBy("cx", "cy").orderBy("district"))).filter("i <= 2")
    places = first.groupBy("cx", "cy").agg(F.min("district").alias("lo"), F.max("district").alias("hi"))
    both = numbered(numbered(cut(places), "left", "cx", "cy"), "below", "cy", "cx")
    apart = lambda c: F.conv(F.bin(c), 4, 10).cast("long")  # noqa: E731  binary digits read as those of base four
    along = both.select("cx", "cy", "lo", "hi", (2 * apart("left") + apart("below")).alias("curve"))
    return numbered(along, "n", "curve").select("cx", "cy", "lo", "hi", F.floor(F.col("n") / leaf).alias("square"))


def nearest(seekers: DataFrame, centres: DataFrame, leaf: int = 8) -> DataFrame:
    """(focal, neighbour): the district of ``centres`` (district, cx, cy) nearest to each of ``seekers``, itself apart; of equally near ones the smallest.

    Places of centres are held in squares (``packed``), four of which make one of the level above, each with the box of its places and two of
    their districts. A seeker goes down from the whole map and takes along the squares whose boxes are no farther than the nearest
    centre known so far: few on each level, so no seeker is held against all centres. Beyond the first levels both sides are shuffled, as in ``meeting``.
    """
    placed = cut(packed(centres, leaf))
    depth = -(-int(placed.agg(F.max("square")).first()[0] or 0).bit_length() // 2)
    own = lambda name: F.struct(F.col(name).alias("district"), "cx", "cy")
    leaves = placed.groupBy("square").agg(*[f(c).alias(n) for c, f, n in (("cx", F.min, "x1"), ("cx", F.max, "x2"), ("cy", F.min, "y1"), ("cy", F.max, "y2"))], F.min(own("lo")).alias("lo"), F.max(own("hi")).alias("hi"))
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("square", F.expr(f"shiftright(square, 2 * ({depth} - level))"))
    boxes = cut(up.groupBy("level", "square").agg(*[f(n).alias(n) for n, f in (("x1", F.min), ("x2", F.max), ("y1", F.min), ("y2", F.max), ("lo", F.min), ("hi", F.max))]))
    finite = seekers.filter("abs(cx) < 1e300 and abs(cy) < 1e300")
    now = finite.select(F.col("district").alias("focal"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0).cast("long").alias("square"), F.lit(float("inf")).alias("known"))
    near = F.col("least") <= F.col("known") * (1 + 1e-12)
    for level in range(depth + 1):
        held = boxes.filter(F.col("level") == level).drop("level")
        met = now.join(F.broadcast(held) if level < 6 else held.hint("merge"), "square")  # at most 4^level squares
        beside = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
        other = F.when(F.col("lo.district") != F.col("focal"), F.col("lo")).otherwise(F.col("hi"))
        away = F.when(other["district"] != F.col("focal"), F.hypot(other["cx"] - F.col("x"), other["cy"] - F.col("y"))).otherwise(F.lit(float("inf")))
        far = met.select("focal", "x", "y", "square", F.hypot(beside("x", "x1", "x2"), beside("y", "y1", "y2")).alias("least"), F.least("known", away).alias("known")).filter(near)
        far = far.withColumn("known", F.min("known").over(Window.partitionBy("focal"))).filter(near).drop("least")
        if level < depth:
            far = far.withColumn("square", F.explode(F.sequence(4 * F.col("square"), 4 * F.col("square") + 3)))
        now = far if level < min(depth, 5) else cut(far)  # levels of few squares are one job
    other = F.when(F.col("lo") != F.col("focal"), F.col("lo")).when(F.col("hi") != F.col("focal"), F.col("hi"))
    met = now.join(placed.hint("merge"), "square").withColumn("district", other).filter("district is not null")
    found = met.groupBy("focal").agg(F.min(F.struct(F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")).alias("d"), "district")).alias("m"))
    return found.select("focal", F.col("m.district").alias("neighbour"))


def island_links(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(focal, neighbour): links, both ways, of each district without ``edges`` and the one of the nearest centroid."""
    centres = cut(centres)
    islands = cut(centres.join(edges.select(F.col("focal").alias("district")).distinct().hint("merge"), "district", "left_anti"))
    if islands.isEmpty():
        return edges.limit(0)
    ways = F.array(F.struct("focal", "neighbour"), F.struct(F.col("neighbour").alias("focal"), F.col("focal").alias("neighbour")))
    return nearest(islands, centres).select(F.inline(ways)).distinct()


def attach_islands(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """``edges`` with each district that has none linked, both ways, to the one of the nearest centroid."""
    edges = written(edges)
    return edges.unionByName(island_links(edges, centres)).distinct()


def stars(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of the component of each node of ``edges`` (u, v) but the roots, of any ordered type.

    Large stars hang each node's larger neighbours on its smallest one, small stars its smaller ones; rounds grow with the log of the number of nodes.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(hung.select("e.u", "e.v").filter("u <> v").distinct())
        new = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(district, component): the smallest district that can be reached."""
    found = stars(edges.select(F.col("focal").alias("u"), F.col("neighbour").alias("v")))
    own = nodes.select("district").distinct()
    return own.join(found, own.district == found.node, "left").select("district", F.coalesce("root", "district").alias("component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(district, degree), zero for islands."""
    counted = edges.groupBy(F.col("focal").alias("district")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("district").distinct().join(counted, "district", "left").select("district", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: regions, links, percent of non-zero links, mean links, regions without links."""
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("regions"), F.sum("degree").alias("links"), F.sum((F.col("degree") == 0).cast("long")).alias("islands"))
    return d.select("regions", "links", F.try_divide(100.0 * F.col("links"), F.col("regions") * F.col("regions")).alias("pct_nonzero"), F.try_divide(F.col("links"), F.col("regions")).alias("mean_links"), "islands")
