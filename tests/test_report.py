"""Printed summaries and the effects of a fit."""

import pytest
from pyspark.sql import functions as F

from survperf.operators import checks, expected, graph, report, simple
from survperf.plans import queries as plans
from survperf.sources import testdata as td
from tests.test_domain import annual_of, simulated

SF = "/root/testdata/sf0.001"


def test_texts(spark):
    summary = plans.REGISTERED["spi_year"](spark, SF)
    assert "quantiles" in report.index_text(summary) and "observed / expected" in report.index_text(summary)
    rows = plans._guide(spark, SF).filter(F.col("year") == 2000)
    assert "kappa" in report.comparison_text(rows) and "Priority for review" in report.guide_text(rows)
    one = simple.simple_index(simple.simple_annual(annual_of(spark)), first=2026).summary
    assert report.simple_text(one) == "2026: 5 of 5 districts, median 1.13; below 1: 1, 0.8: 1, 0.6: 0"
    found = checks.check_model_inputs(td.panel(spark, SF).withColumn("count", F.lit(-1)))
    assert report.checks_text(found).startswith("error: negative counts")
    assert "144 links" in report.graph_text(td.areas(spark, SF), graph.contiguity(td.vertices(spark, SF)))


def test_effects_and_criteria(spark):
    panel, edges, low = simulated(spark)
    masked = expected.masked(panel.withColumn("x_one", F.rand(1)), expected.windows(2021, 2021))
    got = {(r.effect, r.level): r for r in expected.effects(masked, edges, expected.Model(n_draws=50)).collect()}
    assert {e for e, _ in got} == {"intercept", "season", "covariates", "year", "space"}
    assert got["season", "1"].median == pytest.approx(0.3, abs=0.1) and all(got["space", d].median < 0.05 for d in low)
    text = report.fit_text(expected.recommend(expected.compare_overdispersion(masked, edges, ("none", "nb"), expected.Model(n_draws=50))))
    assert "(recommended)" in text and text.count("DIC") == 2
