"""What is wrong with polygons: rings that are broken, cross or overlap, holes outside their shells, parts inside parts.

Sides are rows. Two sides can only meet if their boxes do: each side lies in the at most four cells of a grid as fine as itself, and
looks into the cells of every coarser grid that its district has sides in, so a pair meets once, on the grid of
its longer side, and the work follows the number of sides. Whether a ring lies in another one is told by rays from
the middles of three of its sides, which meet the sides at their height through the same grids in one dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.session import cut
from survperf.operators.graph import wkb_vertices

RING = ["district", "part", "ring"]
#: Faults, the first of which stands for a district that has several.
FAULTS = ("missing", "not finite", "short", "open", "crossing", "hole outside", "nested holes", "nested parts")
#: Sides of a ring whose middles are tried.
TRIED = 3


def broken_rings(vertices: DataFrame) -> DataFrame:
    """(district, part, ring, fault) of rings that are not finite, have fewer than three corners or do not close."""
    finite = (F.abs("x") < 1e300) & (F.abs("y") < 1e300)
    p = F.struct("x", "y")
    rings = vertices.groupBy(*RING).agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(finite & ~F.isnan("x") & ~F.isnan("y"), F.lit(False))).alias("finite"), F.min_by(p, "seq").alias("a"), F.max_by(p, "seq").alias("b"), F.count_distinct("x", "y").alias("corners"))
    fault = F.when(~F.col("finite"), "not finite").when((F.col("n") < 4) | (F.col("corners") < 3), "short").when(F.col("a") != F.col("b"), "open")
    return rings.select(*RING, fault.alias("fault")).filter("fault is not null")


def ring_sides(vertices: DataFrame) -> DataFrame:
    """(district, part, ring, k, n, x, y, x2, y2): the sides of rings, numbered from 0 to n - 1; repeated vertices make none."""
    order = Window.partitionBy(*RING).orderBy("seq")
    rows = vertices.withColumns({"x2": F.lead("x").over(order), "y2": F.lead("y").over(order)}).filter("x2 is not null and (x <> x2 or y <> y2)")
    return rows.select(*RING, (F.row_number().over(order) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*RING)).alias("n"), "x", "y", "x2", "y2")


def _level(size: Column) -> Column:
    """The grid, by the log of its cells' side, as fine as ``size``."""
    return F.ceil(F.log2(F.greatest(size, F.lit(1e-12)))).cast("int")


def _cells(lo: Column, hi: Column, level: Column) -> Column:
    side = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(lo / side), F.floor(hi / side))


def crossings(sides: DataFrame) -> DataFrame:
    """(district, part, ring): rings of which a side meets another one as it must not.

    Sides of one ring meet only as neighbours, end to end; those of two rings of a district may touch in a point.
    """
    lo, hi = (lambda c: F.least(c, f"{c}2")), (lambda c: F.greatest(c, f"{c}2"))
    rows = sides.withColumn("level", _level(F.greatest(hi("x") - lo("x"), hi("y") - lo("y"))))
    levels = rows.groupBy("district").agg(F.collect_set("level").alias("levels"))  # at most as many as powers of two
    s = F.struct("part", "ring", "k", "n", "x", "y", "x2", "y2", "level")
    spread = lambda df, level: df.select("district", "s", "level", F.explode(_cells(F.least("s.x", "s.x2"), F.greatest("s.x", "s.x2"), level)).alias("cx"), _cells(F.least("s.y", "s.y2"), F.greatest("s.y", "s.y2"), level).alias("ys")).select("district", "s", "level", "cx", F.explode("ys").alias("cy"))
    home = spread(rows.select("district", s.alias("s"), "level"), F.col("level"))
    wide = rows.join(levels, "district").select("district", s.alias("s"), F.explode(F.filter("levels", lambda x: x >= F.col("level"))).alias("level"))
    look = spread(wide, F.col("level"))
    met = home.withColumnRenamed("s", "p").join(look.withColumnRenamed("s", "q"), ["district", "level", "cx", "cy"])
    p, q = F.col("p"), F.col("q")
    name = lambda v: F.struct(v["part"], v["ring"], v["k"])
    met = met.filter((q["level"] < p["level"]) | (name(q) < name(p)))
    side = lambda o, u, v: F.signum((o["x2"] - o["x"]) * (v - o["y"]) - (o["y2"] - o["y"]) * (u - o["x"]))
    s1, s2, s3, s4 = side(p, q["x"], q["y"]), side(p, q["x2"], q["y2"]), side(q, p["x"], p["y"]), side(q, p["x2"], p["y2"])
    over = lambda c: F.least(F.greatest(p[c], p[f"{c}2"]), F.greatest(q[c], q[f"{c}2"])) - F.greatest(F.least(p[c], p[f"{c}2"]), F.least(q[c], q[f"{c}2"]))
    boxes = (over("x") >= 0) & (over("y") >= 0)
    touch = boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)
    flat = (s1 == 0) & (s2 == 0)
    overlap = touch & flat & ((over("x") > 0) | (over("y") > 0))
    through = touch & (s1 * s2 < 0) & (s3 * s4 < 0)
    one = (p["part"] == q["part"]) & (p["ring"] == q["ring"])
    apart = F.abs(p["k"] - q["k"])
    beside = one & ((apart == 1) | (apart == p["n"] - 1)) & (p["n"] > 2)
    bad = F.when(beside, overlap).when(one, touch).otherwise(through | overlap)
    both = F.explode(F.array(F.struct(p["part"], p["ring"]), F.struct(q["part"], q["ring"]))).alias("r")
    return met.filter(bad).select("district", both).select("district", "r.part", "r.ring").distinct()


def inside_rings(sides: DataFrame) -> DataFrame:
    """(district, part, ring, in_part, in_ring): rings that lie in another one of their district, in so far as they do not cross."""
    rows = sides.filter("y <> y2").withColumn("level", _level(F.abs(F.col("y2") - F.col("y"))))
    levels = rows.groupBy("district").agg(F.collect_set("level").alias("levels"))
    held = rows.select("district", "level", F.col("part").alias("in_part"), F.col("ring").alias("in_ring"), "x", "y", "x2", "y2", F.explode(_cells(F.least("y", "y2"), F.greatest("y", "y2"), F.col("level"))).alias("cy"))
    third = F.greatest(F.floor(F.col("n") / TRIED), F.lit(1))
    points = sides.filter((F.col("k") % third == 0) & (F.col("k") < TRIED * third)).select(*RING, "k", ((F.col("x") + F.col("x2")) / 2).alias("px"), ((F.col("y") + F.col("y2")) / 2).alias("py"))
    rays = points.join(levels, "district").select(*RING, "k", "px", "py", F.explode("levels").alias("level")).withColumn("cy", F.floor(F.col("py") / F.pow(F.lit(2.0), F.col("level"))))
    met = rays.join(held, ["district", "level", "cy"]).filter("part <> in_part or ring <> in_ring")
    spans = ((F.col("y") <= F.col("py")) != (F.col("y2") <= F.col("py")))
    at = F.col("x") + (F.col("py") - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))
    told = met.groupBy(*RING, "k", "in_part", "in_ring").agg(F.sum((spans & (at > F.col("px"))).cast("long")).alias("ahead"), F.max(spans & (at == F.col("px"))).alias("on"))
    return told.filter("ahead % 2 = 1 and not on").select(*RING, "in_part", "in_ring").distinct()


def geometry_faults(vertices: DataFrame) -> DataFrame:
    """(district, fault): all faults of the polygons in ``vertices`` (district, part, ring, seq, x, y), whose first ring of each part is its shell.

    Broken rings are not looked at further, and of rings that cross others nothing else is told. A null coordinate is not finite; a district without vertices has no row.
    """
    broken = cut(broken_rings(vertices))
    sides = cut(ring_sides(vertices.join(broken.select(*RING), RING, "left_anti")))
    crossed = cut(crossings(sides))
    rings = sides.select(*RING).distinct().join(crossed, RING, "left_anti")
    inside = cut(inside_rings(sides).join(crossed, RING, "left_anti"))
    own_shell = inside.filter("in_ring = 0 and part = in_part").select(*RING)
    outside = rings.filter("ring > 0").join(own_shell, RING, "left_anti").join(sides.filter("ring = 0").select("district", "part").distinct(), ["district", "part"], "left_semi")
    nested = inside.filter("ring > 0 and in_ring > 0 and part = in_part")
    # in a part's shell, but not in one of its holes
    within = inside.filter("ring = 0 and part <> in_part").groupBy(*RING, "in_part").agg(F.sum(F.when(F.col("in_ring") == 0, 1).otherwise(-1)).alias("depth")).filter("depth = 1")
    parts = [broken.select("district", "fault"), *[rows.select("district", F.lit(f).alias("fault")) for f, rows in (("crossing", crossed), ("hole outside", outside), ("nested holes", nested), ("nested parts", within))]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def invalid_geometries(boundaries: DataFrame, id_col: str, wkb_col: str = "geometry") -> DataFrame:
    """(id, fault): districts whose polygon is missing or faulty, each once with its first fault in the order of ``FAULTS``."""
    missing = boundaries.filter(F.col(wkb_col).isNull()).select(F.col(id_col).cast("string").alias("district"), F.lit("missing").alias("fault"))
    found = missing.unionByName(geometry_faults(wkb_vertices(boundaries, id_col, wkb_col)))
    rank = F.array_position(F.array(*[F.lit(f) for f in FAULTS]), F.col("fault"))
    return found.groupBy("district").agg(F.min_by("fault", rank).alias("fault")).select(F.col("district").alias(id_col), "fault")
