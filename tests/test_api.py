"""End-to-end calls on simulated data."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from survperf import api
from survperf.operators import expected, render, simple
from tests.test_domain import annual_of, simulated

QUICK = expected.Model(n_draws=60)


@pytest.fixture(scope="module")
def world(spark):
    panel, edges, low = simulated(spark)
    population = panel.groupBy("district", F.year("month").alias("year")).agg(F.first("pop").alias("pop"))
    return panel.drop("pop").cache(), population.cache(), edges.cache(), low


@pytest.fixture(scope="module")
def index(world):
    cases, population, edges, _ = world
    return api.assess(cases, population, edges, 2019, 2020, model=QUICK)


def test_assessment_finds_planted_shortfalls(world, index):
    low = world[3]
    got = {(r.district, r.period): r.spi_median for r in index.summary.collect()}
    assert len(got) == 24 and sorted((k for k in got if k[1] == 2020), key=got.get)[:2] == [(d, 2020) for d in low]
    assert {(r.period, r.months, r.districts) for r in index.windows.collect()} == {(2019, 12, 12), (2020, 12, 12)}
    assert index.national.count() == 2 and index.totals.first().n_units == 12


def test_levels_share_one_fit(world, index):
    cases, population, _, _ = world
    fit = api.Fit(api.model_panel(cases, population), index.draws, QUICK)
    monthly = api.index_from(fit, "district_month")
    assert monthly.summary.count() == 288 and api.index_from(fit, "district_total").summary.count() == 12
    assert fit.summary().filter("expected_q05 <= expected_median and expected_median <= expected_q95").count() == 288
    for bad in (lambda: api.index_from(fit, "week"), lambda: api.index_from(fit, "district_month", year_end_month=4)):
        with pytest.raises(ValueError):
            bad()


def test_guide_from_model(spark, world, index):
    cases, population, edges, low = world
    done = api.compare_rates(index, strata=population.select("district", F.lit("s").alias("stratum")).distinct())
    assert done.metrics.first().n == 24 and done.by_stratum.first().stratum == "s"
    areas = population.select("district", F.lit("a").alias("area")).distinct()
    fit = api.Fit(api.model_panel(cases, population), index.draws, QUICK)
    monthly = api.index_from(fit, "district_month").summary.withColumnRenamed("period", "month")
    found = spark.createDataFrame([(low[0], 2020, 1)], "district string, year int, n int")
    g = api.field_guide(done, areas, edges=edges, monthly=monthly, afp=found)
    assert g.read_year == 2020 and g.signals == {"timeliness": False, "extent": True, "adequacy": False, "surroundings": True, "seasonal": True, "detect_afp": True, "detect_es": False}
    rows = {r.district: r for r in g.focal.collect()}
    assert all(rows[d].spi_below and rows[d].gate_pass for d in low) and rows[low[0]].afp_years == "2020"
    assert low[0] in render.guide_table(g.focal) and low[0] in render.pager(g.district_year, low[0], 2020)


def test_guide_from_simple(spark):
    done = api.compare_rates(simple.simple_index(simple.simple_annual(annual_of(spark)), first=2025), npafp_target=5)
    g = api.field_guide(done, spi_cut=1.0)
    assert g.read_year == 2026 and {r.district for r in g.focal.filter("spi_below").collect()} == {"A"}
    assert api.field_guide(done).focal.filter("spi_below").count() == 0
    with pytest.raises(ValueError):
        api.field_guide(done, rule="interval")


def test_rolling_with_and_without_fit(world):
    cases, population, edges, low = world
    panel = api.model_panel(cases, population)
    table = api.rolling_index(date(2021, 1, 10), panel, edges, model=QUICK).collect()
    assert [r.unit for r in table[:2]] and {r.unit for r in table[:2]} == set(low) and len(table) == 12
    with pytest.raises(ValueError):
        api.rolling_index(date(2021, 1, 10), panel)


def test_automatic_likelihood_and_missing_population(world):
    cases, population, edges, _ = world
    panel = api.model_panel(cases, population)
    fit = api.expected_counts(panel, edges, expected.windows(2020, 2020), QUICK, "auto")
    assert fit.model.extra in ("none", "iid", "nb") and fit.criteria.count() == 3
    with pytest.raises(ValueError, match="no population"):
        api.model_panel(cases, population.filter("district <> 'd01'"))
    monthly = cases.select("district", "month").withColumn("pop", F.lit(100.0))
    assert api.model_panel(cases, monthly).first().fit_pop == 1200
    extra = population.select("district", "year", (F.col("pop") / 10).alias("income"), F.lit(1).alias("flat"))
    assert "x_income" in api.model_panel(cases, population, extra).columns
