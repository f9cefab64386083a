"""Findings name every affected id."""

from pyspark.sql import functions as F

from survperf.operators import checks


def test_findings_list_all_ids(spark):
    cases = spark.range(1500).select(F.format_string("D%05d", "id").alias("district"), F.lit("2020-01-01").cast("date").alias("month"), F.lit(-1).alias("count"))
    regions = cases.select("district").filter("district < 'D00200'")
    got = {r.code: (r.n, r["ids"]) for r in checks.check_model_inputs(cases, regions=regions).collect()}
    names = [f"D{i:05d}" for i in range(1500)]
    assert got["cases_negative"] == (1500, names) and got["cases_id_not_in_shapefile"] == (1300, names[200:])


def test_months_of_rows_are_those_of_dates(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from survperf.operators import prepare

    days = [date(2020, 1, 31), date(2021, 12, 1), date(2015, 6, 5), date(2016, 2, 1), None]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", prepare.window_of(F.col("d"), 5, 2).alias("w"), prepare.panel_months_of(F.col("d"), 2016).alias("p")).collect()
    for r in rows:
        assert r.w == (prepare.window(r.d, 5, 2) if r.d else None)
        assert r.p == (None if r.d is None else [] if r.d < date(2016, 2, 1) else prepare.panel_months(r.d, 2016))


def test_poisson_tails_of_many_rows():
    import math

    import numpy as np

    from survperf.functions.expr import poisson_cdf

    k = np.array([0, 0, 1, 3, 10, 100, 7, -1, 1200], float)
    rate = np.array([1e-9, 2.0, 5.0, 3.0, 2.0, 80.0, 700.0, 3.0, 1000.0])
    want = [0.0 if a < 0 else math.fsum(math.exp(i * math.log(r) - r - math.lgamma(i + 1)) for i in range(int(a) + 1)) for a, r in zip(k, rate, strict=True)]
    assert np.allclose(poisson_cdf(k, rate), want, rtol=1e-10, atol=1e-300)
