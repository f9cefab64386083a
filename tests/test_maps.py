"""Maps of a comparison, and a district's page with all its parts."""

import re

import pytest
from pyspark.sql import functions as F

from survperf.operators import compare, guide, maps, render

VERTEX = "district string, part int, ring int, seq int, x double, y double"


@pytest.fixture(scope="module")
def outlines(spark):
    rows = []
    for name, (x, y) in {"A": (0, 0), "B": (1, 0), "C": (0, 1), "D": (1, 1), "E": (2, 0)}.items():
        rows += [(name, 0, 0, i, x + a, y + b) for i, (a, b) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]
    rows += [("D", 0, 1, i, 1.4 + a, 1.4 + b) for i, (a, b) in enumerate([(0.0, 0.0), (0.0, 0.2), (0.2, 0.2), (0.2, 0.0), (0.0, 0.0)])]
    return spark.createDataFrame(rows, VERTEX)


@pytest.fixture(scope="module")
def comparison(spark):
    rows = [("A", 2020, 0.5, 0.4, "Both below"), ("B", 2020, 3.0, 1.0, "Neither below"), ("C", 2020, 30.0, 0.99, "SPI below threshold only"), ("D", 2020, None, None, None), ("A", 2019, 9.0, 9.0, "Neither below")]
    return spark.createDataFrame(rows, "district string, year int, npafp_rate double, spi_median double, category string")


def panels_of(svg):
    return re.findall(r'<g class="panel".*?</g>(?=<g class="panel"|</svg>)', svg)


def test_three_maps(comparison, outlines, spark):
    provinces = spark.createDataFrame([("A", "p"), ("B", "p"), ("C", "q"), ("D", "q")], "district string, province string")
    svg = maps.maps_svg(comparison, outlines, province_of=provinces)
    parts = panels_of(svg)
    assert len(parts) == 3 and all(p.count("<title>") == 4 and ">E<" not in p and p.count('class="province"') == 1 for p in parts)
    # each class has its key, also those that no district has
    for part, labels in zip(parts, (maps.labels_of(compare.NPAFP_BREAKS), maps.labels_of(compare.SPI_BREAKS), compare.CATEGORIES), strict=True):
        assert part.count('class="key"') == len(labels) + 1 and "no value (1)" in part
    assert "&lt;1 (1)" in parts[0] and "3-6 (1)" in parts[0] and "&gt;=24 (1)" in parts[0] and "1-2 (0)" in parts[0]
    assert "&lt;0.5 (1)" in parts[1] and "0.75-1 (1)" in parts[1] and "1-1.33 (1)" in parts[1]
    assert "Both below (1)" in parts[2] and "NPAFP below target only (0)" in parts[2]
    # the border between A and B lies inside a province, the one between A and C does not
    border = re.search(r'class="province" d="([^"]*)"', parts[0])[1]
    half = maps.SIZE / 2
    assert f"{half:g},{half:g}L{maps.SIZE:g},{half:g}" in border and f"M{half:g},{half:g}L{half:g},{maps.SIZE:g}" not in border
    # a hole is a second ring of its part's path
    assert max(p.count("M") for p in re.findall(r'<path d="([^"]*)" fill-rule', parts[0])) == 2
    old = maps.maps_svg(comparison, outlines, 2019, titles=("x<", "y", "z"), simple=True)
    assert "x&lt;" in old and panels_of(old)[0].count("<title>") == 1
    assert "(rolling)" in maps.maps_svg(comparison, outlines, year_label="rolling") and "province" not in old
    with pytest.raises(ValueError):
        maps.maps_svg(comparison, outlines, 1999)


def test_classes_and_colours():
    for breaks, cut in ((compare.NPAFP_BREAKS, 3.0), (compare.SPI_BREAKS, 1.0), ((1.0,), 0.5), ((1.0,), 1.0)):
        colours = maps.colours_of(breaks, cut)
        assert len(colours) == len(set(colours)) == len(breaks) + 1 == len(maps.labels_of(breaks))
        under = sum(b <= cut for b in breaks)
        red = [int(c[1:3], 16) > int(c[5:7], 16) for c in colours]
        assert red == [True] * under + [False] * (len(colours) - under)


def test_fine_borders_are_drawn_coarsely(spark):
    ring = spark.range(20_001).select(F.lit("A").alias("district"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.col("id").cast("int").alias("seq"), F.cos(F.col("id") * 3.141592653589793 / 10_000).alias("x"), F.sin(F.col("id") * 3.141592653589793 / 10_000).alias("y"))
    dot = ring.select(F.lit("B").alias("district"), "part", "ring", "seq", (F.col("x") / 1e6).alias("x"), (F.col("y") / 1e6).alias("y"))
    both = ring.unionAll(dot)
    box = maps.box_of(both)
    paths = maps.shapes(both, box)
    assert 500 < paths["A"].count(",") < 3000 and paths["B"].count(",") < 20
    assert maps.shapes(both.limit(0), maps.box_of(both.limit(0))) == {}
    with pytest.raises(ValueError):
        maps.shapes(both, box, 100)


def test_whole_page(spark, outlines):
    rows = [(d, y, 5, 6.0, s, 0.4, 0.9, guide.VERDICTS[0], "2018, 2020", "2019") for d in "AB" for y, s in ((2018, 0.8), (2019, None), (2020, 0.6), (2021, 0.5))]
    g = spark.createDataFrame(rows, "district string, year int, observed long, expected_total double, spi_median double, spi_q05 double, spi_q95 double, verdict string, afp_years string, es_years string")
    provinces = spark.createDataFrame([(d, "p" if d in "AB" else "q") for d in "ABCDE"], "district string, province string")
    tiles = spark.createDataFrame([("A", 2020, 2.0, 50.0, 4, 80.0), ("A", 2021, 4.0, 75.0, 8, 90.0)], "district string, year int, npafp_rate double, stool_adequacy_pct double, stool_adequacy_n int, timely_pct double")
    page = render.pager(g, "A", 2021, outlines=outlines, province_of=provinces, prob_under=0.995, region={"name": "South <1>", "spi": 0.7, "rank": 1, "n": 22}, indicators=tiles, year_label="rolling year to Apr 2021")
    assert "rolling year to Apr 2021" in page and "over 99%" in page and "Region South &lt;1&gt;; index 0.70; rank 1 of 22, lowest first" in page
    assert page.count('class="own"') == page.count('class="country"') == page.count('class="province"') == 1
    assert "4.0, at or above the target of 3" in page and "75% of 8" in page and "90%" in page
    # two runs around the missing year, two years of cases and one of the environment
    assert page.count('class="interval"') == 2 and page.count('class="afp"') == 2 and page.count('class="es"') == 1
    before = render.pager(g, "A", 2020, indicators=tiles)
    assert "2 of 4, not assessed" in before and "below the target" in before and "locator" not in before and "context" not in before
    assert "locator" not in render.pager(g.withColumn("district", F.concat("district", F.lit("x"))), "Ax", 2021, outlines=outlines)
    assert [render.share_text(*a) for a in ((None,), (80.0,), (None, 0), (50.0, 5))] == ["–", "80%", "no case to assess", "50% of 5"]
    assert render.probability_text(0.005).endswith("under 1%") and render.probability_text(0.42).endswith("42%")
    with pytest.raises(ValueError):
        render.pager(g, "A", 2021, prob_under=1.2)
