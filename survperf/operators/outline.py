"""Provinces dissolved from their districts: outlines as segments and as closed rings with holes.

Districts' sides are directed so that the inside lies to the left. A side that two districts of a province have in
opposite directions is inside it and goes; what is left is chained: each side's next one is the sharpest turn to the left at its end,
so rings that touch in a point stay apart, and the chains are ranked by doubling. Nothing is gathered by province.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.session import cut, written
from survperf.operators.graph import SNAP, meeting, stars

RING = ["district", "part", "ring"]


def snapped(vertices: DataFrame, snap: float = SNAP) -> DataFrame:
    """``vertices`` with those that a chain of steps of at most ``snap`` joins moved to the smallest of them."""
    points = vertices.select("x", "y").distinct()
    at = lambda p: F.struct(F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"))
    moved = stars(meeting(points, snap).select(at("p").alias("u"), at("q").alias("v")))
    to = moved.select(F.col("node.x").alias("x"), F.col("node.y").alias("y"), F.col("root.x").alias("to_x"), F.col("root.y").alias("to_y"))
    return vertices.join(to, ["x", "y"], "left").select(*RING, "seq", F.coalesce("to_x", "x").alias("x"), F.coalesce("to_y", "y").alias("y"))


def sides(vertices: DataFrame) -> DataFrame:
    """(district, a, b): the sides of all rings as structs of x and y, with the inside to the left; a part's first ring is its shell, the others are holes."""
    order = Window.partitionBy(*RING).orderBy("seq")
    rows = vertices.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order)}).filter("x2 is not null")
    area = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).over(Window.partitionBy(*RING))
    a, b = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    turned = (area < 0) == (F.col("ring") == 0)
    return rows.select("district", F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b")).filter("a <> b")


def province_sides(vertices: DataFrame, province_of: DataFrame, snap: float = SNAP) -> DataFrame:
    """(province, a, b): the sides of each province of ``province_of`` (district, province) that are not inside it."""
    rows = sides(snapped(vertices, snap)).join(province_of.select("district", "province"), "district")
    ahead = F.when(F.col("a") < F.col("b"), 1).otherwise(-1)
    net = rows.groupBy("province", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.sum(ahead).alias("s")).filter("s <> 0")
    return net.select("province", F.when(F.col("s") > 0, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(F.col("s") > 0, F.col("hi")).otherwise(F.col("lo")).alias("b"))


def province_outline(vertices: DataFrame, province_of: DataFrame, snap: float = SNAP) -> DataFrame:
    """(province, x1, y1, x2, y2): the outline of each dissolved province as loose segments, each from its smaller end."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    return province_sides(vertices, province_of, snap).select("province", lo["x"].alias("x1"), lo["y"].alias("y1"), hi["x"].alias("x2"), hi["y"].alias("y2"))


def chained(outline: DataFrame) -> DataFrame:
    """(id, province, a, b, next): the sides of outlines with the one that follows in its ring."""
    rows = cut(outline.select("province", "a", "b").withColumn("id", F.monotonically_increasing_id()))
    after = rows.select(F.col("province").alias("p"), F.col("id").alias("next"), F.col("a").alias("at"), F.col("b").alias("to"))
    met = rows.join(after, (F.col("province") == F.col("p")) & (F.col("b") == F.col("at")))
    angle = lambda p: F.atan2(F.col(f"{p}.y") - F.col("b.y"), F.col(f"{p}.x") - F.col("b.x"))
    turn = F.pmod(angle("a") - angle("to"), F.lit(2 * math.pi))
    best = met.groupBy("id").agg(F.min_by("next", F.when(turn > 1e-12, turn).otherwise(2 * math.pi)).alias("next"))
    linked = cut(rows.join(best, "id"))
    told = linked.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("next").alias("k")).first()
    if told.n != told.k or told.n != rows.count():
        raise ValueError("outlines do not close: districts overlap, or a border lacks vertices that its neighbour has")
    return linked


def ranked(links: DataFrame) -> DataFrame:
    """(id, ring, seq, n) of ``links`` (id, next), a permutation: the smallest id of each cycle, the steps from it, and the cycle's length. Rounds are as the log of the longest cycle."""
    links = written(links.select("id", "next"))
    now = links.select("id", F.col("next").alias("hop"), F.col("id").alias("ring"))
    moved = True
    while moved:
        ahead = now.select(F.col("id").alias("hop"), F.col("hop").alias("further"), F.col("ring").alias("seen"))
        now = written(now.join(ahead, "hop").select("id", F.col("further").alias("hop"), F.least("ring", "seen").alias("ring"), (F.col("seen") < F.col("ring")).alias("moved")))
        moved = not now.filter("moved").isEmpty()
    # a side whose way has come to the ring's first one hops to its own complement, which nothing has as id
    first = F.when(F.col("next") == F.col("ring"), F.bitwise_not("id")).otherwise(F.col("next"))
    left = written(links.join(now.select("id", "ring"), "id").select("id", "ring", first.alias("hop"), F.lit(1).cast("long").alias("d")))
    while not left.filter("hop >= 0").isEmpty():
        ahead = left.select(F.col("id").alias("at"), F.col("hop").alias("further"), F.col("d").alias("more"))
        hop = F.when(F.col("further") < 0, F.bitwise_not("id")).otherwise(F.coalesce("further", "hop"))
        left = written(left.join(ahead, F.col("hop") == F.col("at"), "left").select("id", "ring", hop.alias("hop"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
    size = left.filter("id = ring").select("ring", F.col("d").alias("n"))
    return left.join(size, "ring").select("id", "ring", (F.col("n") - F.col("d")).alias("seq"), "n")


def province_rings(vertices: DataFrame, province_of: DataFrame, snap: float = SNAP) -> DataFrame:
    """(province, ring, seq, x, y): closed rings of the dissolved provinces, shells to the left and holes to the right; the last vertex of a ring is its first."""
    linked = chained(province_sides(vertices, province_of, snap))
    rows = cut(linked.join(ranked(linked.select("id", "next")), "id"))
    end = F.struct((F.col("seq") + 1).alias("seq"), F.col("b").alias("p"))
    start = F.struct("seq", F.col("a").alias("p"))
    points = rows.select("province", "ring", F.explode(F.when(F.col("seq") + 1 == F.col("n"), F.array(start, end)).otherwise(F.array(start))).alias("v"))
    return points.select("province", "ring", "v.seq", "v.p.x", "v.p.y")


def ring_measures(rings: DataFrame) -> DataFrame:
    """(province, ring, sides, area, length): area is negative for holes."""
    order = Window.partitionBy("province", "ring").orderBy("seq")
    rows = rings.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order)}).filter("x2 is not null")
    return rows.groupBy("province", "ring").agg(F.count(F.lit(1)).alias("sides"), (F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("length"))


def province_measures(rings: DataFrame) -> DataFrame:
    """(province, area, length, hole_area) of dissolved provinces: holes are no part of the area, their borders are of the length."""
    return ring_measures(rings).groupBy("province").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.sum(-F.least("area", F.lit(0.0))).alias("hole_area"))
