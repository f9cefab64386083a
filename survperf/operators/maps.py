"""Maps as SVG: the rate, the index and their category of one year side by side, and a district in its country.

Vertices are put on a grid of half pixels by Spark, and those that fall on the place before them in their ring go, so what is fetched
follows from the picture and the number of rings, not from how finely borders are drawn. Legends show each class with its number of
districts, also those that no district has.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survperf.operators.compare import CATEGORIES, NPAFP_BREAKS, NPAFP_TARGET, SPI_BREAKS, SPI_THRESHOLD, bins
from survperf.operators.outline import RING, province_outline

SIZE, MOST, NO_VALUE = 320, 200_000, "#d9d9d9"
#: Ends of the ramps of classes under a threshold and of the others, and the colours of the categories.
WARM, COOL = ("#8c2d04", "#fdbe85"), ("#c6dbef", "#08306b")
CATEGORY_COLOURS = dict(zip(CATEGORIES, ("#f0f0f0", "#e6ab02", "#1b9e77", "#737373"), strict=True))


@dataclass(frozen=True)
class Box:
    """From map to picture: the left and upper ends, and pixels of a unit."""

    left: float
    top: float
    scale: float

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.round((x - self.left) * self.scale * 2) / 2, F.round((self.top - y) * self.scale * 2) / 2


def box_of(outlines: DataFrame, size: int = SIZE) -> Box:
    """The box of all vertices; an empty map has one of its own."""
    e = outlines.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    return Box(0.0, 0.0, 1.0) if e.x0 is None else Box(e.x0, e.y1, size / max(e.x1 - e.x0, e.y1 - e.y0, 1e-9))


def on_picture(outlines: DataFrame, box: Box) -> DataFrame:
    """``outlines`` with places (px, py), less vertices on the place of the one before them in their ring."""
    px, py = box.place(F.col("x"), F.col("y"))
    placed = outlines.select(*RING, "seq", px.alias("px"), py.alias("py"))
    here, order = F.struct("px", "py"), Window.partitionBy(*RING).orderBy("seq")
    return placed.withColumn("before", F.lag(here).over(order)).filter(F.col("before").isNull() | (F.col("before") != here)).drop("before")


def shapes(outlines: DataFrame, box: Box, most: int = MOST) -> dict[str, str]:
    """The path of each district, holes left open; a ring on one place is a dot. Beyond ``most`` vertices on the picture an error."""
    rows = on_picture(outlines, box).orderBy(*RING, "seq").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} vertices on the picture; draw fewer districts")
    rings: dict[tuple, list[str]] = {}
    for r in rows:
        rings.setdefault((r.district, r.part, r.ring), []).append(f"{r.px:g},{r.py:g}")
    out: dict[str, str] = {}
    for (district, *_), points in rings.items():
        path = f"M{'L'.join(points)}Z" if len(points) > 1 else f"M{points[0]}h1v1h-1Z"
        out[district] = out.get(district, "") + path
    return out


def lines_of(outlines: DataFrame, province_of: DataFrame, box: Box, most: int = MOST) -> str:
    """One path of the borders of dissolved provinces."""
    a, b = box.place(F.col("x1"), F.col("y1")), box.place(F.col("x2"), F.col("y2"))
    rows = province_outline(outlines, province_of).select(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by"))
    kept = rows.filter("ax <> bx or ay <> by").distinct().orderBy("ax", "ay", "bx", "by").limit(most + 1).collect()
    if len(kept) > most:
        raise ValueError(f"more than {most} sides of provinces on the picture; draw it without provinces")
    return "".join(f"M{r.ax:g},{r.ay:g}L{r.bx:g},{r.by:g}" for r in kept)


def labels_of(breaks: tuple[float, ...]) -> list[str]:
    """What the classes that ``compare.bins`` makes of ``breaks`` hold."""
    return [f"<{breaks[0]:g}", *(f"{a:g}-{b:g}" for a, b in zip(breaks, breaks[1:], strict=False)), f">={breaks[-1]:g}"]


def ramp(ends: tuple[str, str], count: int) -> list[str]:
    """``count`` colours from one end to the other."""
    a, b = ([int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in ends)
    mix = lambda t: "#" + "".join(f"{round(x + (y - x) * t):02x}" for x, y in zip(a, b, strict=True))
    return [mix(k / (count - 1) if count > 1 else 0.0) for k in range(count)]


def colours_of(breaks: tuple[float, ...], threshold: float) -> list[str]:
    """A colour for each class: warm where all of it is under the threshold, cool elsewhere."""
    under = sum(b <= threshold for b in breaks)
    return ramp(WARM, under) + ramp(COOL, len(breaks) + 1 - under)


def legend(levels: list[tuple[str, str, int]], top: float) -> str:
    """A row for each (label, colour, districts)."""
    return "".join(f'<rect class="key" x="0" y="{top + 15 * i:g}" width="12" height="10" fill="{c}" stroke="#999"/><text x="17" y="{top + 9 + 15 * i:g}">{html.escape(label)} ({n})</text>' for i, (label, c, n) in enumerate(levels))


def maps_svg(comparison: DataFrame, outlines: DataFrame, year: int | None = None, province_of: DataFrame | None = None, npafp_target: float = NPAFP_TARGET, spi_threshold: float = SPI_THRESHOLD, rule: str = "median", simple: bool = False, npafp_breaks: tuple[float, ...] = NPAFP_BREAKS, spi_breaks: tuple[float, ...] = SPI_BREAKS, titles: tuple[str, str, str] | None = None, year_label: str | None = None, size: int = SIZE) -> str:
    """The three maps of a year (the last one if none is given). Districts without a row are not drawn, those without a value are grey.

    ``outlines`` is (district, part, ring, seq, x, y), a part's first ring its shell; ``province_of`` (district, province) adds the
    borders of provinces.
    """
    at = year if year is not None else comparison.agg(F.max("year").alias("y")).first().y
    rows = comparison.filter(F.col("year") == at).select("district", "npafp_rate", "spi_median", "category")
    if rows.isEmpty():
        raise ValueError(f"no rows of the year {at}")
    place = F.coalesce(*[F.when(F.col("category") == c, i) for i, c in enumerate(CATEGORIES)])
    classed = rows.select("district", bins(F.col("npafp_rate"), npafp_breaks).alias("a"), bins(F.col("spi_median"), spi_breaks).alias("b"), place.alias("c"))
    drawn = outlines.join(classed.select("district"), "district", "left_semi")
    box = box_of(drawn, size)
    paths = shapes(drawn, box)
    found = {r.district: r for r in classed.join(outlines.select("district").distinct(), "district", "left_semi").collect()}  # the districts on the picture
    borders = "" if province_of is None else f'<path class="province" d="{lines_of(drawn, province_of, box)}" fill="none" stroke="#333"/>'
    named, shown = year_label or str(at), "Index" if simple else "Posterior median index"
    panels = (
        ("a", f"A. Conventional rate ({named})", f"Target {npafp_target:g} per 100 000; warm: below it", labels_of(npafp_breaks), colours_of(npafp_breaks, npafp_target)),
        ("b", f"B. {shown} ({named})", f"Threshold {spi_threshold:g}; warm: below it" + ("; low also needs an interval under 1" if rule == "interval" else ""), labels_of(spi_breaks), colours_of(spi_breaks, spi_threshold)),
        ("c", f"C. Index and rate ({named})", "By both cuts", list(CATEGORIES), list(CATEGORY_COLOURS.values())),
    )
    out = []
    for i, (column, title, note, labels, colours) in enumerate(panels):
        got = {d: r[column] for d, r in found.items()}
        body = "".join(f'<path d="{p}" fill-rule="evenodd" fill="{NO_VALUE if got[d] is None else colours[got[d]]}" stroke="#fff" stroke-width="0.4"><title>{html.escape(str(d))}</title></path>' for d, p in paths.items())
        levels = [(label, c, sum(v == k for v in got.values())) for k, (label, c) in enumerate(zip(labels, colours, strict=True))]
        if None in got.values():
            levels.append(("no value", NO_VALUE, sum(v is None for v in got.values())))
        head = html.escape(titles[i] if titles else title)
        out.append(f'<g class="panel" transform="translate({10 + i * (size + 40)},0)"><text y="16" font-weight="bold">{head}</text><text y="31">{html.escape(note)}</text><g transform="translate(0,42)">{body}{borders}</g>{legend(levels, size + 56)}</g>')
    return f'<svg width="{3 * (size + 40)}" height="{size + 200}" font-size="11" font-family="sans-serif">{"".join(out)}</svg>'


def locator_svg(outlines: DataFrame, district: str, province_of: DataFrame | None = None, colour: str = "#333333", size: int = 180) -> str:
    """The district, filled, in the outline of its country and its provinces; a ring around it, as it may be small."""
    own = outlines.filter(F.col("district") == district)
    middle = own.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    if middle.x is None:
        return ""
    box = box_of(outlines, size)
    ids = outlines.select("district").distinct()
    country = lines_of(outlines, ids.withColumn("province", F.lit("")), box)
    inner = "" if province_of is None else f'<path class="province" d="{lines_of(outlines, province_of, box)}" fill="none" stroke="#bbb"/>'
    x, y = (middle.x - box.left) * box.scale, (box.top - middle.y) * box.scale
    return f'<svg class="locator" width="{size + 24}" height="{size + 24}"><g transform="translate(12,12)">{inner}<path class="country" d="{country}" fill="none" stroke="#555"/><path class="own" d="{shapes(own, box)[district]}" fill-rule="evenodd" fill="{colour}"/><circle cx="{x:.1f}" cy="{y:.1f}" r="10" fill="none" stroke="{colour}"/></g></svg>'
