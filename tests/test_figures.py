"""Ticks, scales and the five plots from plot data."""

import math
import re

import pytest
from pyspark.sql import functions as F

from survperf.operators import figures, render
from survperf.plans import queries as Q

SF = "/root/testdata/sf0.001"


def test_linear_ticks():
    assert figures.linear_ticks(0, 10) == [0, 2, 4, 6, 8, 10] and figures.linear_ticks(-0.31, 0.29) == [-0.2, 0.0, 0.2]
    assert figures.linear_ticks(97, 103) == [98, 100, 102] and figures.linear_ticks(0, 0.0004) == [0, 0.0001, 0.0002, 0.0003, 0.0004]
    assert figures.linear_ticks(5, 5) == [5]
    for lo, hi in ((0, 1), (3, 9999), (-1e-6, 1e-6), (12.5, 13.1)):
        ticks = figures.linear_ticks(lo, hi)
        steps = {round(b - a, 10) for a, b in zip(ticks, ticks[1:], strict=False)}
        assert 2 <= len(ticks) <= 7 and all(lo - 1e-9 <= t <= hi + 1e-9 for t in ticks) and len(steps) <= 1 or hi < 1e-5


def test_log_ticks():
    assert figures.log_ticks(1, 1000) == [1, 10, 100, 1000] and figures.log_ticks(0.9, 60) == [1, 5, 10, 50]
    assert figures.log_ticks(1, 10) == [1, 5, 10] and figures.log_ticks(2, 2.4) == [2.0, 2.1, 2.2, 2.3, 2.4]
    assert len(figures.log_ticks(1e-9, 1e9)) <= 7


def test_scales_of_rows_and_of_columns_agree(spark):
    df = spark.createDataFrame([(0.5,), (2.0,), (80.0,), (0.0,), (-1.0,), (None,), (math.nan,), (math.inf,)], "v double")
    for log in (False, True):
        for flip in (False, True):
            s = figures.scale_of(df, ["v"], log, 300, flip)
            rows = df.filter(figures.usable(F.col("v"), log)).select("v", s.place(F.col("v")).alias("p")).collect()
            assert len(rows) == (3 if log else 5) and all(abs(r.p - s.at(r.v)) <= 0.25 + 1e-9 and 0 <= r.p <= 300 for r in rows)
    assert figures.scale_of(df.filter("v > 1e9 and v < 1e10"), ["v"], True).ticks


@pytest.fixture(scope="module")
def rows(spark):
    return Q._comparison(spark, SF).cache()


def circles(svg):
    return sum(int(n) for n in re.findall(r"<title>(\d+)</title></circle>", svg))


def test_point_plots_tell_every_row(rows):
    n = rows.filter("expected_total > 0 and spi_median is not null").count()
    svg = figures.funnel_svg(rows, 1.0)
    assert circles(svg) == n and svg.count('class="rule"') == 1 and figures.PASS in svg and svg == figures.funnel_svg(rows, 1.0) != figures.funnel_svg(rows, 1.0, seed=2)
    assert circles(figures.calibration_svg(rows.withColumnRenamed("district", "unit").withColumnRenamed("year", "period"))) == rows.filter("observed > 0").count()
    svg = figures.quadrants_svg(rows, Q.TARGET, Q.CUT)
    quarters = [int(q) for q in re.findall(r'class="quarter"[^>]*>(\d+)<', svg)]
    want = {(r.a, r.b): r.n for r in rows.groupBy((F.col("npafp_rate") >= Q.TARGET).alias("a"), (F.col("spi_median") >= Q.CUT).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert quarters == [want.get((a, b), 0) for a in (False, True) for b in (False, True)] and sum(quarters) == circles(svg) and svg.count('class="rule"') == 2


def test_distribution_and_caterpillar(rows):
    svg = figures.distribution_svg(rows, 10)
    bars = [(float(h), int(n)) for h, n in re.findall(r'height="([\d.]+)" fill="#4a5568" stroke="#fff"><title>(\d+)', svg)]
    assert sum(n for _, n in bars) == rows.filter("spi_median > 0").count()
    tall = max(n for _, n in bars)
    assert all(h == pytest.approx(figures.HEIGHT * n / (1.05 * tall), abs=0.11) for h, n in bars)
    year = rows.filter("year = 2000")
    svg = figures.caterpillar_svg(year, 3)
    want = render.caterpillar(year, 3).orderBy("spi_median", "district").collect()
    assert svg.count('class="interval"') == len(want) and [d for d in re.findall(r'text-anchor="end">(\w+)</text>', svg)] == [r.district for r in want]
    at = [float(x) for x in re.findall(r'<circle cx="([\d.]+)"', svg)]
    assert at == sorted(at) and "No positive index" in figures.distribution_svg(rows.limit(0))
    for empty in (figures.funnel_svg, figures.quadrants_svg):
        assert circles(empty(rows.limit(0))) == 0
