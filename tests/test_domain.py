"""Hand-checkable cases and algebraic identities of the surveillance operators."""

import math
import struct
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survperf.functions import expr
from survperf.operators import checks, compare, expected, graph, guide, national, outline, prepare, render, rolling, simple, validity

D = date


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        ("P1", "D1", "NPAFP", "AFP", D(2024, 1, 10), None, None, "Yes"), ("P1", "D1", "WPV1", "AFP", D(2024, 1, 20), None, None, "No"), ("P1", "D2", "PENDING", "AFP", None, D(2024, 2, 14), D(2024, 1, 30), " "),
        ("P2", "D3", None, "AFP", None, None, D(2024, 3, 2), "Yes"), ("P2", "D3", "cVDPV2", "AFP", D(2024, 2, 3), None, None, "Yes"), ("P2", None, "NPAFP", "AFP", D(2024, 1, 1), None, None, "Yes"), ("P1", "D1", "NPAFP", "Contact", D(2024, 1, 5), None, None, "Yes"),
    ]
    c = prepare.ColumnMap()
    schema = f"{c.parent} string, {c.district} string, {c.classification} string, {c.surveillance} string, {c.onset} date, {c.case_date} date, {c.stool1} date, {c.adequacy} string"
    return spark.createDataFrame(rows, schema)


def test_case_dates_and_panel(spark, cases):
    assert [r.d for r in cases.select(prepare.case_date().alias("d")).collect()] == [D(2024, 1, 10), D(2024, 1, 20), D(2024, 2, 14), D(2024, 3, 2), D(2024, 2, 3), D(2024, 1, 1), D(2024, 1, 5)]
    districts = spark.createDataFrame([("D1",), ("D2",), ("D3",), ("D4",)], "district string")
    months = prepare.months_frame(spark, [D(2024, m, 1) for m in (1, 2, 3)])
    panel = {(r.district, r.month.month): r["count"] for r in prepare.case_panel(cases, districts, months).collect()}
    assert len(panel) == 12 and {k for k, v in panel.items() if v} == {("D1", 1), ("D2", 2), ("D3", 3)} and sum(panel.values()) == 3
    wide = {(r.district, r.month.month): r["count"] for r in prepare.case_panel(cases, districts, months, surveillance_types=("AFP", "Contact")).collect()}
    narrow = {(r.district, r.month.month): r["count"] for r in prepare.case_panel(cases, districts, months, polio_pattern="VDPV").collect()}
    assert wide["D1", 1] == 2 and narrow["D1", 1] == 2


def test_population_index_and_panel(spark):
    rows = [("D1", 2022, 100.0), ("D1", 2023, 110.0), ("D1", 2024, 121.0), ("D2", 2022, 50.0), ("D2", 2023, 0.0), ("D3", 2023, 40.0), ("D3", 2024, 30.0), ("D3", 2024, 14.0)]
    seen = prepare.pop_observed(spark.createDataFrame(rows, "adm2_guid string, year int, u15_pop double"))
    assert sorted(map(tuple, prepare.pop_index(seen).collect())) == [(2022, 100.0), (2023, 110.0), (2024, 121.0)]
    districts = spark.createDataFrame([(f"D{i}",) for i in range(1, 5)], "district string")
    got = {(r.district, r.year): (r.pop, r.carried) for r in prepare.pop_panel(seen, districts, spark.createDataFrame([(2022,), (2023,), (2024,)], "year int")).collect()}
    assert got["D3", 2022][0] == pytest.approx(40 * 100 / 110) and got["D3", 2024] == (44.0, False) and got["D2", 2023][0] == pytest.approx(55) and got["D2", 2024][0] == pytest.approx(60.5)
    assert got["D4", 2022] == (None, True) and sum(c for _, c in got.values()) == 6


def test_windows():
    assert prepare.window(D(2024, 3, 31))[0] == D(2023, 3, 1) and prepare.window(D(2024, 3, 31))[-1] == D(2024, 2, 1)
    assert prepare.window(D(2024, 1, 15), 1, 0) == [D(2024, 1, 1)] and prepare.last_month(D(2024, 1, 15)) == D(2023, 12, 1)
    assert len(prepare.panel_months(D(2024, 3, 10), 2023)) == 14
    for bad in (lambda: prepare.panel_months(D(2016, 1, 5), 2016), lambda: prepare.window(D(2024, 1, 1), 0), lambda: prepare.ColumnMap.of({"nope": "x"})):
        with pytest.raises(ValueError):
            bad()


SIMPLE = {"A": [(2022, 8, 100000), (2023, 10, 105000), (2024, 9, 110000), (2025, 11, 115000), (2026, 6, 120000)], "B": [(2025, 1, 40000), (2026, 1, 42000)], "C": [(2022, 0, 250000), (2023, 1, 250000), (2024, 0, 250000), (2025, 1, 250000), (2026, 1, 255000)], "D": [(2022, 30, 300000), (2023, 32, 310000), (2024, 31, 320000), (2025, 33, 330000), (2026, 29, 340000)], "E": [(2022, 12, 150000), (2023, 14, 155000), (2024, 13, 160000), (2025, 15, 165000), (2026, 14, 170000)]}


def annual_of(spark, change=lambda d, y, n, p: (n, p)):
    rows = [(d, y, *change(d, y, float(n), float(p))) for d, years in SIMPLE.items() for y, n, p in years]
    return spark.createDataFrame(rows, "district string, year int, npafp_cases double, population_u15 double")


def summary_of(data, population=None, **options):
    return {(r.district, r.year): r for r in simple.simple_index(simple.simple_annual(data, population), **options).summary.collect()}


def test_simple_index_by_hand(spark):
    got = summary_of(annual_of(spark), first=2026)
    assert got["A", 2026].history_cases == 38 and got["A", 2026].history_pop == 430000 and got["A", 2026].expected == 120000 * 38 / 430000
    want = {"A": 0.6738006782, "B": 1.1341938326, "C": 2.3351049494, "D": 1.0157706527, "E": 1.1442014252}
    assert {d: pytest.approx(r.spi, abs=1e-9) for (d, _), r in got.items()} == want
    assert got["A", 2026].national_oe == pytest.approx(0.8396985815214895)
    total = sum(r.observed for r in got.values()) / sum(r.expected for r in got.values())
    assert total == pytest.approx(got["A", 2026].national_oe)


def test_simple_index_odd_histories(spark):
    zero = summary_of(annual_of(spark, lambda d, y, n, p: (0.0 if d == "C" and y < 2026 else n, p)), first=2026)["C", 2026]
    assert (zero.history_check, zero.history_rate, zero.expected, zero.oe, zero.spi) == ("no previous case", 0, 0, None, None)
    new = summary_of(annual_of(spark), first=2025, last=2025)["B", 2025]
    assert (new.history_check, new.expected, new.oe, new.spi) == ("no previous year", None, None, None)
    none = simple.simple_index(simple.simple_annual(annual_of(spark, lambda d, y, n, p: (0.0 if y == 2026 else n, p))), first=2026)
    assert none.national.first().national_oe == 0
    assert {(r.oe, r.national_oe, r.spi) for r in none.summary.collect()} == {(0, None, None)}
    whole = annual_of(spark)
    two = summary_of(whole.filter("not (district = 'C' and year = 2024)").drop("population_u15"), whole.drop("npafp_cases"), first=2026)["C", 2026]
    assert (two.history_cases, two.history_years) == (2, 4)
    one = summary_of(whole.filter("not (district = 'C' and year in (2022, 2023, 2024))"), first=2026)["C", 2026]
    assert (one.history_years, one.population_qc) == (1, "check_history")


def test_population_screen(spark):
    spike = summary_of(annual_of(spark, lambda d, y, n, p: (n, 600000.0 if d == "D" and y == 2024 else p)), first=2026)
    assert {d: r.population_qc for (d, _), r in spike.items()} == {"A": "ok", "B": "check_history", "C": "ok", "D": "check_spike", "E": "ok"}
    change = summary_of(annual_of(spark, lambda d, y, n, p: (n, p * 3 if d == "E" and y >= 2024 else p)), first=2026)
    assert change["E", 2026].population_qc == "check_change"


def test_explain_in_words(spark):
    rows = simple.explain(simple.simple_index(simple.simple_annual(annual_of(spark)), first=2025).summary, {"SPI": "Indice"})
    got = {r.component: r.value for r in rows.filter("district = 'A' and year = 2026").collect()}
    assert got["Observed NPAFP cases"] == "6" and got["Current population under 15"] == "120 000" and got["Expected NPAFP cases"] == "10.60" and got["Indice"] == "0.67" and got["Population check"] == "no flag"
    new = {r.component: r.value for r in rows.filter("district = 'B' and year = 2025").collect()}
    assert new["Reason"] == "no previous year of data" and new["Previous rate"] == "not available"


@pytest.fixture(scope="module")
def fitted(spark):
    cells = [("D1", 1, 1, 1e5, 1.0), ("D1", 2, 1, 1e5, 1.0), ("D2", 1, 2, 2e5, 2.0), ("D2", 2, 2, 2e5, 2.0), ("D3", 1, 0, 5e4, 0.5), ("D3", 2, 1, 5e4, 0.5)]
    panel = spark.createDataFrame([(d, D(2024, m, 1), n, p) for d, m, n, p, _ in cells], "district string, month date, count long, pop double")
    draws = spark.createDataFrame([(d, D(2024, m, 1), s, e) for d, m, _, _, e in cells for s in range(1, 5)], "district string, month date, draw int, expected double")
    return panel, draws


def test_window_summary_by_hand(spark, fitted):
    both = {r.unit: r for r in rolling.window_summary(*fitted, [D(2024, 1, 1), D(2024, 2, 1)]).collect()}
    assert {u: (r.observed, r.pop, r.expected_total, r.spi_median, r.national_oe) for u, r in both.items()} == {"D1": (2, 1e5, 2, 1, 1), "D2": (4, 2e5, 4, 1, 1), "D3": (1, 5e4, 1, 1, 1)}
    january = {r.unit: r.spi_median for r in rolling.window_summary(*fitted, [D(2024, 1, 1)]).collect()}
    assert january == {"D1": pytest.approx(3.5 / 3), "D2": pytest.approx(3.5 / 3), "D3": 0}
    parents = spark.createDataFrame([("D1", "P1"), ("D2", "P1")], "district string, parent string")
    rolled = {r.unit: (r.observed, r.pop, r.expected_total) for r in rolling.window_summary(*fitted, [D(2024, 1, 1), D(2024, 2, 1)], parents).collect()}
    assert rolled == {"P1": (6, 3e5, 6), None: (1, 5e4, 1)}


def test_classification_edges(spark):
    rows = [(3, 1e5, 5.0, 0.8, 0.9), (3, 1e5, 5.0, 0.79, 1.0), (3, 1e5, 5.0, 0.79, 0.99), (2, 1e5, 5.0, 0.79, 0.99), (2, 1e5, 5.0, 0.9, 0.95), (3, 1e5, 0.99, 0.5, 0.6), (3, 1e5, 1.0, None, None)]
    df = spark.createDataFrame([(i, *r, 12) for i, r in enumerate(rows)], "i int, observed long, pop double, expected_total double, spi_median double, spi_q95 double, months int")
    got = rolling.classify(df).orderBy("i").collect()
    assert [r.agreement for r in got] == ["both_pass", "both_pass", "spi_only", "both_flag", "rate_only", None, None]
    assert [r.focus_status for r in got] == ["other", "other", "focus", "other", "other", None, None] and [r.readable for r in got] == [True] * 5 + [False] * 2
    assert rolling.classify(df.withColumn("months", F.lit(6)), annualise=True).orderBy("i").first().rate == 6


def test_stool_adequacy_counts_recorded_cases(spark, cases):
    for unit, want in (("district", {"D1": (2, 50.0), "D3": (2, 100.0)}), ("parent", {"P1": (2, 50.0), "P2": (2, 100.0)})):
        got = prepare.stool_adequacy(prepare.case_records(cases, unit=unit), [D(2024, m, 1) for m in (1, 2, 3)])
        assert {r.unit: (r.n_stool, r.pct_adequate) for r in got.collect()} == want


def test_centring_cancels_what_draws_share(spark):
    shared = np.exp(np.linspace(-1, 1, 1001))
    draws = spark.createDataFrame([(u, 0, i, float(s * k)) for i, s in enumerate(shared) for u, k in (("A", 10), ("B", 20))], "unit string, period int, draw int, expected double")
    seen = spark.createDataFrame([("A", 0, 5, 1.0, 1), ("B", 0, 20, 1.0, 1)], "unit string, period int, observed long, pop double, n_months int")
    summary, nat = national.summarise(draws, seen)
    for r in summary.collect():
        assert {round(r[c], 12) for c in ("spi_q05", "spi_median", "spi_q95")} == {{"A": 0.6, "B": 1.2}[r.unit]}
    assert nat.first().national_observed == 25
    nothing, _ = national.summarise(draws, seen.withColumn("observed", F.lit(0).cast("long")))
    assert {r.spi_median for r in nothing.collect()} == {None}


def test_reporting_years(spark):
    months = spark.createDataFrame([(D(2015 + k // 12, k % 12 + 1, 1),) for k in range(24)], "month date")
    got = months.groupBy(expr.window_year(F.col("month"), 4).alias("y")).count().collect()
    assert {r.y: r["count"] for r in got} == {2015: 4, 2016: 12, 2017: 8}
    assert spark.range(1).select(expr.window_start(F.lit(2019), 4).alias("d")).first().d == D(2018, 5, 1)
    assert expected.windows(2019, 2019, 4) == [(2019, D(2018, 5, 1), D(2019, 4, 1))]
    with pytest.raises(ValueError):
        expected.windows(2016, 2018, panel_first=D(2015, 1, 1))


def test_comparison_categories_and_agreement(spark):
    rows = [(d, y, n, 1e5, 10.0, s, 0.4, 0.9) for y in (2015, 2016) for d, n, s in (("A", 10, 1.1), ("B", 1, 0.5), ("C", 10, 0.5), ("D", 1, 1.1))]
    index = spark.createDataFrame(rows, "district string, year int, observed long, pop double, expected_total double, spi_median double, spi_q05 double, spi_q95 double")
    got = compare.compare(index)
    assert {r.category: r.n for r in compare.counts_by_category(got).collect()} == dict.fromkeys(compare.CATEGORIES, 2)
    m = compare.metrics(got).first()
    assert (m.pct_agreement, m.cohens_kappa, m.mcnemar_p) == (50, 0, 1)
    same = compare.metrics(got.filter("district = 'A'")).first()
    assert same.cohens_kappa is None and same.mcnemar_p is None
    assert compare.metrics(got.limit(0)).first().n == 0
    assert [r.b for r in spark.createDataFrame([(0.4,), (0.5,), (2.0,), (None,)], "x double").select(compare.bins(F.col("x"), compare.SPI_BREAKS).alias("b")).collect()] == [0, 1, 5, None]
    with pytest.raises(ValueError):
        compare.compare(index, spi_rule="interval", simple=True)


def series(spark, values, first=2019):
    rows = [(d, first + i, float(v)) for d, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "district string, year int, spi_median double")


def test_runs_persistence_and_trend(spark):
    dy = series(spark, {"STALE": [0.5, 0.5, 0.5, 1.1, 1.05, 0.7], "VOLATILE": [0.95, 0.9, 0.3, 0.85, 0.3, 0.75], "LINE": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4]})
    last = guide.add_runs(guide.add_previous(dy, 0.8), 0.8).filter("district = 'STALE' and year = 2024").first()
    assert (last.previous_spi, last.persistence_concern, last.longest_run, last.trailing_run) == (1.05, False, 3, 1)
    plain = {r.district: r.trajectory for r in guide.add_trajectory(dy).filter("year = 2024").collect()}
    strict = {r.district: r for r in guide.add_trajectory(dy, alpha=0.1).filter("year = 2024").collect()}
    assert plain["VOLATILE"] == "falling" and strict["VOLATILE"].trajectory == "flat" and strict["LINE"].trajectory == "falling" and strict["LINE"].slope_p == 0


def test_process_and_noise(spark):
    dy = series(spark, {"FG1": [0.5], "FG2": [0.5], "FG3": [0.5], "FG4": [1.0]})
    process = spark.createDataFrame([("FG1", 2019, 8, 8, 8, 3), ("FG2", 2019, 3, 3, 3, 3), ("FG3", 2019, 10, 5, 10, 10)], "district string, year int, n_cases int, n_adequate int, n_transport int, n_transport_timely int")
    got = {r.district: r for r in guide.add_process(dy, process).collect()}
    assert got["FG1"].timeliness_concern and got["FG1"].adequacy_concern is False and got["FG3"].adequacy_concern
    assert got["FG2"].timeliness_concern is None and got["FG2"].adequacy_concern is None and got["FG4"].n_cases == 0
    tail = spark.createDataFrame([(0, 2.0), (5, 0.0), (1059, 1000.0), (None, 1.0)], "k int, e double").select(expr.poisson_lower(F.col("k"), F.col("e")).alias("p")).collect()
    assert tail[0].p == pytest.approx(math.exp(-2)) and tail[1].p is None and tail[3].p is None
    for k, rate in ((1059, 1000.0), (900, 1000.0), (6000, 6000.0), (3, 50.0)):
        assert expr.poisson_cdf(k, rate) == pytest.approx(math.fsum(math.exp(i * math.log(rate) - rate - math.lgamma(i + 1)) for i in range(k + 1)), rel=1e-9)


def test_verdict_rule(spark):
    rows = [("a", True, True, True, None, True), ("b", True, False, True, True, True), ("c", True, True, False, None, True), ("d", False, False, True, True, False), ("e", True, None, None, None, False)]
    df = spark.createDataFrame(rows, "district string, spi_below boolean, gate_pass boolean, extent_concern boolean, persistence_concern boolean, cri_excludes_1 boolean")
    assert [r.verdict for r in guide.add_verdict(df).orderBy("district").collect()] == ["Priority for review", "Monitor", "Monitor", "No SPI indication", "Monitor"]
    assert guide.add_verdict(df, "interval").filter("district = 'e'").first().verdict == "No SPI indication"


def test_serotypes(spark):
    dy = series(spark, {"A": [1, 1]}, 2023).drop("spi_median")
    found = spark.createDataFrame([("A", 2023, 1, "aVDPV2"), ("A", 2024, 2, "cVDPV2"), ("A", 2024, 0, "WPV1")], "district string, year int, n int, serotype string")
    last = lambda types=None: guide.detections(dy, found, "x", types).filter("year = 2024").first()
    assert (last().x_years, last().x_serotypes) == ("2023, 2024", "aVDPV2, cVDPV2") and last(["cVDPV2"]).x_years == "2024"
    assert (last(["WPV1"]).x_years, last(["WPV1"]).x_flag) == ("", False)


def test_seasonal_labels(spark):
    rows = [(d, D(2020, m, 1), n(m), 4.0 if 5 <= m <= 8 else 1.0) for d, n in (("blind", lambda m: 0 if 5 <= m <= 8 else 3), ("muted", lambda m: 1), ("present", lambda m: 4)) for m in range(1, 13)]
    rows += [("none", D(2020, 1, 1), 0, 0.0)]
    got = {r.district: r.seasonal for r in guide.seasonal(spark.createDataFrame(rows, "district string, month date, observed long, expected_total double")).collect()}
    assert got == {"blind": "blind", "muted": "muted", "present": "present", "none": "not assessed"}


def squares(spark, places):
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return spark.createDataFrame([(d, 0, 0, i, float(x + dx), float(y + dy)) for d, (x, y) in places.items() for i, (dx, dy) in enumerate(corners)], "district string, part int, ring int, seq int, x double, y double")


def test_graph_of_squares(spark):
    v = squares(spark, {"A": (0, 0), "B": (1, 0), "C": (10, 10), "D": (12, 10), "E": (1, 1)})
    queen = {tuple(r) for r in graph.contiguity(v).collect()}
    assert queen == {("A", "B"), ("B", "A"), ("B", "E"), ("E", "B"), ("A", "E"), ("E", "A")}
    assert {tuple(r) for r in graph.contiguity(v, "rook").collect()} == queen - {("A", "E"), ("E", "A")}
    edges = graph.attach_islands(graph.contiguity(v), graph.centroids(v))
    assert {tuple(r) for r in edges.collect()} - queen == {("C", "D"), ("D", "C")}
    nodes = v.select("district").distinct()
    assert {r.district: r.component for r in graph.components(nodes, edges).collect()} == {"A": "A", "B": "A", "E": "A", "C": "C", "D": "C"}
    assert outline.province_outline(v.filter("district in ('A', 'B')"), nodes.withColumn("province", F.lit("p"))).count() == 6


@pytest.mark.parametrize("snap", [1e-5, 3e-4, 0.0])
def test_snap_by_distance(spark, snap):
    """Vertices meet if and only if they are at most the snap apart, also across borders of the hash's cells."""
    rng = np.random.default_rng(4)
    side = 8 * (snap or 1e-5)
    base = rng.integers(-4, 4, (150, 2)) * side + rng.choice([0.0, 1e-7, -1e-7, side / 3], (150, 2))
    points = np.vstack([base, base + rng.uniform(-1.5, 1.5, (150, 2)) * snap, base + [snap, 0]])
    rows = [(f"d{i % 60}", 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate(points)] + [("far", 0, 0, 0, float("inf"), 0.0), ("nan", 0, 0, 0, float("nan"), 0.0)]
    n = {}
    once = {(r[0], r[4], r[5]) for r in rows if math.isfinite(r[4])}
    for a, x, y in once:
        for b, u, v in once:
            if a != b and (x - u) * (x - u) + (y - v) * (y - v) <= snap * snap:
                n[a, b] = n.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "district string, part int, ring int, seq int, x double, y double")
    assert {tuple(r) for r in graph.contiguity(df, "queen", snap).collect()} == set(n)
    assert {tuple(r) for r in graph.contiguity(df, "rook", snap).collect()} == {k for k, c in n.items() if c > 1}
    with pytest.raises(ValueError, match="not negative"):
        graph.contiguity(df, snap=-1.0)


def test_snap_joins_borders_that_lie_side_by_side(spark):
    v = squares(spark, {"A": (0, 0), "B": (1, 0)})
    for gap, linked in ((2e-9, True), (9e-6, True), (1.1e-5, False)):
        moved = v.withColumn("x", F.when(F.col("district") == "B", F.col("x") + gap).otherwise(F.col("x")))
        assert (graph.contiguity(moved).count() == 2) == linked


def test_wkb_polygons(spark):
    import struct

    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<II", 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
    polygon = struct.pack("<BI", 1, 3) + body
    multi = struct.pack("<BII", 1, 6, 2) + polygon * 2
    rows = graph.wkb_vertices(spark.createDataFrame([("p", polygon), ("m", multi), ("n", None)], "id string, geometry binary"), "id").collect()
    assert len(rows) == 12 and [(r.x, r.y) for r in rows if r.district == "p"] == ring and {r.part for r in rows if r.district == "m"} == {0, 1}


def test_checks_report_each_rule_once(spark):
    rows = [("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 1), 2.0), ("B", D(2020, 2, 1), -1.0), ("C", D(2020, 1, 1), 1.5), ("C", D(2020, 2, 1), None)]
    cases = spark.createDataFrame(rows, "district string, month date, count double")
    people = spark.createDataFrame([("A", 2020, 0.0), ("B", 2020, -5.0)], "district string, year int, pop double")
    got = {r.code: (r.severity, r.n, r["ids"]) for r in checks.check_model_inputs(cases, people).collect()}
    assert got["cases_duplicates"] == ("error", 1, ["A"]) and got["cases_negative"] == ("error", 1, ["B"]) and got["cases_invalid_count"] == ("error", 1, ["C"])
    assert got["panel_gaps"] == ("warning", 2, ["A", "B"]) and got["pop_zero"][2] == ["A"] and got["pop_negative"][2] == ["B"] and got["pop_coverage"][1] == 1
    with pytest.raises(ValueError, match="negative counts"):
        checks.abort_on_errors(checks.check_model_inputs(cases))
    codes = lambda df: {r.code for r in df.collect()}
    assert "cases_missing_cols" in codes(checks.check_model_inputs(cases.drop("count"))) and "cases_empty" in codes(checks.check_model_inputs(cases.limit(0)))
    assert "too_few_years" in codes(checks.check_simple_inputs(annual_of(spark).filter("year = 2026"))) and "few_years" in codes(checks.check_simple_inputs(annual_of(spark).filter("year > 2023")))
    assert checks.check_simple_inputs(annual_of(spark).filter("district in ('A', 'D', 'E')")).count() == 0


def simulated(spark, low=(3, 7)):
    rng = np.random.default_rng(0)
    names = [f"d{i:02d}" for i in range(12)]
    edges = [(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if abs(i - j) == 1]
    pop = rng.uniform(1e5, 4e5, 12)
    rows = []
    for y in range(2015, 2021):
        for m in range(1, 13):
            for i, n in enumerate(names):
                rate = pop[i] / 12 * 3e-5 * 4 * math.exp(0.3 * math.sin(2 * math.pi * m / 12)) * (0.3 if i in low and y == 2020 else 1)
                rows.append((n, D(y, m, 1), int(rng.poisson(rate)), float(pop[i])))
    return spark.createDataFrame(rows, "district string, month date, count long, pop double"), spark.createDataFrame(edges, "focal string, neighbour string"), [names[i] for i in low]


def test_fit_recovers_planted_shortfalls(spark):
    panel, edges, low = simulated(spark)
    masked = expected.masked(panel, expected.windows(2020, 2020))
    assert masked.filter("inside and count is not null").count() == 0
    model = expected.Model(n_draws=100)
    drawn = expected.fit(masked, edges, model).cache()
    assert drawn.count() == 12 * 12 * 100
    inside = panel.filter(F.year("month") == 2020)
    summary, _ = national.summarise(national.cells(drawn, F.year("month")), national.observed_of(inside, F.year("month")))
    got = {r.unit: r.spi_median for r in summary.collect()}
    assert sorted(got, key=got.get)[:2] == low and all(got[d] < 0.6 for d in low)
    # each index against the counts over what the planted rates expect
    seen = {r.district: r.n for r in inside.groupBy("district").agg(F.sum("count").alias("n")).collect()}
    pops = {r.district: r["pop"] for r in inside.select("district", "pop").distinct().collect()}
    true = {d: seen[d] / pops[d] for d in seen}
    level = np.median([true[d] / got[d] for d in true])
    assert all(abs(got[d] / (true[d] / level) - 1) < 0.2 for d in true if d not in low)
    again = expected.fit(masked.repartition(5), edges, model).agg(F.sum("expected")).first()[0]
    assert again == pytest.approx(drawn.agg(F.sum("expected")).first()[0], rel=1e-9)


def test_terms_of_the_likelihoods():
    """The log-normal term against a sum over a fine grid; gradients against differences."""
    y, eta = np.array([0, 1, 5, 50, 1000.0]), np.array([0.1, -1, 2, 3, 6.5])
    z = np.linspace(-9, 9, 100_001)
    for sd in (0.1, 0.5, 0.9):
        ll, g, w = expected._terms(y, eta, sd, "iid")
        for i in range(len(y)):
            logs = y[i] * (eta[i] + sd * z) - np.exp(eta[i] + sd * z) - math.lgamma(y[i] + 1) - z * z / 2 - 0.5 * math.log(2 * math.pi)
            assert ll[i] == pytest.approx(logs.max() + math.log(np.exp(logs - logs.max()).sum() * (z[1] - z[0])), abs=1e-4)
        for kind in ("iid", "nb", "none"):
            up, down = (expected._terms(y, eta + e, sd, kind)[0] for e in (1e-4, -1e-4))
            assert expected._terms(y, eta, sd, kind)[1] == pytest.approx((up - down) / 2e-4, abs=1e-3, rel=1e-4)
        assert (w > 0).all() and not np.allclose(ll, expected._terms(y, eta, sd, "nb")[0], atol=1e-3)


def test_design_by_codes_is_the_dense_one(spark):
    rng = np.random.default_rng(8)
    months = [D(y, m, 1) for y in (2019, 2020) for m in range(1, 13)]
    pdf = pd.DataFrame([(d, m, 3.0 if m.year < 2020 else np.nan, 1e5, rng.normal()) for d in "abc" for m in months], columns=["district", "month", "count", "pop", "x_a"])
    d = expected._Data(pdf, [("a", "b")], expected.Model())
    years, places = pd.to_datetime(pdf["month"]).dt.year - 2019, pdf["district"].map("abc".index)
    dense = np.hstack([d.dense, np.eye(2)[years], np.eye(3)[places]])
    x, w = rng.normal(size=(2, dense.shape[1])), rng.random(len(pdf))
    own = d.field.order  # the field has its own order of districts
    f, u = x[:, : d.size], x[:, d.size :][:, own]
    assert np.allclose(d.log_mean(f, u), x @ dense.T + d.offset) and np.allclose(np.concatenate(d.sums(w)), np.concatenate([(dense.T @ w)[: d.size], (dense.T @ w)[d.size :][own]]))
    whole, (h, cross, weight) = dense.T @ (dense * w[:, None]), d.curvature(w)
    assert np.allclose(h, whole[: d.size, : d.size]) and np.allclose(cross, whole[d.size :, : d.size][own]) and np.allclose(weight, np.diag(whole)[d.size :][own])
    assert [name for _, name in d.labels[d.size :]] == ["abc"[i] for i in own] and len(d.labels) == dense.shape[1]
    assert np.allclose(d.cells(d.seen).log_mean(f[0], u[0]), (x[0] @ dense.T + d.offset)[d.seen])


def test_criteria_tell_likelihoods_apart(spark):
    """Counts with a strong extra term: no term fits worst by DIC and WAIC, and the two kinds of term differ."""
    rng = np.random.default_rng(9)
    rows = [(f"d{i}", D(y, m, 1), int(rng.poisson(20 * math.exp(0.8 * rng.standard_normal()))), 1e6) for i in range(6) for y in range(2016, 2021) for m in range(1, 13)]
    panel = spark.createDataFrame(rows, "district string, month date, count long, pop double")
    edges = spark.createDataFrame([(f"d{i}", f"d{j}") for i in range(6) for j in (i - 1, i + 1) if 0 <= j < 6], "focal string, neighbour string")
    got = {r.spec: r for r in expected.compare_overdispersion(expected.masked(panel, expected.windows(2020, 2020)), edges).collect()}
    assert got["none"].dic > got["iid"].dic + 100 and got["none"].waic > got["nb"].waic + 100
    assert abs(got["iid"].waic - got["nb"].waic) > 1 and got["iid"].waic < got["nb"].waic
    assert got["none"].pit_ks > 2 * got["iid"].pit_ks and all(r.n_obs == 288 and r.cpo_valid > 0.9 for r in got.values()) and got["iid"].sd_extra > 0.5


def test_distance_from_uniform_by_group(spark):
    rng = np.random.default_rng(1)
    values = [(k, float(v)) for k in ("a", "b") for v in np.round(rng.random(500) ** (1 if k == "a" else 2), 2)]
    got = {r.k: r.pit_ks for r in expected.pit_distance(spark.createDataFrame(values, "k string, pit double"), keys=("k",)).collect()}
    assert got == {k: pytest.approx(expected.ks_uniform(np.array([v for g, v in values if g == k]))) for k in "ab"}


def test_overdispersion_rule(spark):
    rows = [(1, "none", 1000, 0.0, 0.0, 50.0, 0.1, 0.5, None, 0.9, 0.10), (1, "iid", 1000, 0.0, 0.0, 50.0, 0.1, 0.5, 0.1, 0.9, 0.05), (1, "nb", 1000, 0.0, 0.0, 500.0, 0.1, 0.99, 0.1, 0.3, 0.01), (2, "nb", 1000, 0.0, 0.0, 500.0, 0.1, 0.5, 0.1, 0.9, 0.01)]
    got = {(r.target, r.spec): (r.excluded, r.recommended) for r in expected.recommend(spark.createDataFrame(rows, expected.FIT)).collect()}
    assert got == {(1, "none"): ("", "iid"), (1, "iid"): ("", "iid"), (1, "nb"): ("cpo, p_eff, phi", "iid"), (2, "nb"): ("p_eff", None)}
    for bad in ({"season": "x"}, {"prior_phi": (2.0, 0.5)}, {"n_draws": 0}):
        with pytest.raises(ValueError):
            expected.Model(**bad)
    assert expected.ks_uniform((np.arange(1000) + 0.5) / 1000) == pytest.approx(0.0005) and expected.ks_uniform(np.zeros(5)) is None


def test_statistics():
    assert expr.student_tail(2.0, 3) == pytest.approx(0.139326, abs=1e-6) and expr.student_tail(0, 5) == pytest.approx(1)
    assert expr.binomial_two_sided(1, 9) == pytest.approx(0.021484375) and expr.binomial_two_sided(4, 4) == 1


def test_reports(spark, tmp_path):
    rows = [(f"D{i}", 2024, 5, 6.04, 0.5 + i / 10, 0.4, 0.9, 1.5, True, False, 80.0, 90.0, v, i + 1, True, True, 9) for i, v in enumerate(guide.VERDICTS)]
    schema = "district string, year int, observed long, expected_total double, spi_median double, spi_q05 double, spi_q95 double, npafp_rate double, extent_concern boolean, persistence_concern boolean, pct_transport_timely double, pct_adequate double, verdict string, verdict_order int, conventional_pass boolean, spi_below boolean, n_cases int"
    focal = spark.createDataFrame(rows, schema).withColumn("gate_pass", F.lit(True)).withColumn("name", F.concat(F.lit("Name <"), "district"))
    page = render.pager(focal, "name <d1", 2024, "name", file=str(tmp_path / "p.html"))
    assert "Name &lt;D1, 2024" in page and "Monitor" in page and (tmp_path / "p.html").exists()
    table = render.guide_table(focal)
    assert table.index("D0") < table.index("D1") < table.index("D2") and "Worked examples" in render.guide_table(focal, "worked")
    assert "more are left out" not in table and "; 2 more are left out" in render.guide_table(focal, max_rows=focal.count() - 2)
    told = render.help_text("example", focal)
    assert "Review label: " in told and " - " in told.splitlines()[0]
    for bad in (lambda: render.help_text("example"), lambda: render.pager(focal, "zz", 2024, "name"), lambda: render.pager(focal, "D1", 2000), lambda: render.save("x", "a.png"), lambda: render.help_text("x")):
        with pytest.raises(ValueError):
            bad()
    assert "persistence_concern" in render.help_text() and render.file_name("A / b", 2024) == "./a-b-2024.html"
    svg = render.map_svg(squares(spark, {"D0": (0, 0), "D1": (1, 0)}), spark.createDataFrame([("D0", 1)], "district string, b int"), "b", ("#000", "#111"))
    assert svg.count("<polygon") == 2 and "#111" in svg and "#ddd" in svg


def test_streaming_panel(spark, tmp_path):
    from survperf.streaming import panel

    src = str(tmp_path / "in")
    rows = [("A", D(2024, 1, d)) for d in (1, 1, 15)] + [("A", D(2024, 2, 1)), ("B", D(2024, 1, 31))]
    spark.createDataFrame(rows, "district string, case_date date").write.parquet(src)
    stream = spark.readStream.schema("district string, case_date date").parquet(src)
    q = panel.monthly_counts(stream).writeStream.outputMode("update").format("memory").queryName("daily").start()
    try:
        q.processAllAvailable()
        got = {(r.district, r.month): r["count"] for r in panel.closed_panel(spark.table("daily")).collect()}
    finally:
        q.stop()
    assert got == {("A", D(2024, 1, 1)): 3, ("A", D(2024, 2, 1)): 1, ("B", D(2024, 1, 1)): 1}


def test_invalid_geometries(spark):
    def wkb(*rings):
        return bytearray(b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[v for p in r for v in p]) for r in rings))

    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    hole = [(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 0.5)]
    many = [(math.cos(t), math.sin(t)) for t in np.linspace(0, 2 * math.pi, 1500, endpoint=False)]
    rows = {
        "ok": wkb(square, hole), "bow": wkb([(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]), "open": wkb(square[:-1]), "short": wkb([(0, 0), (1, 1), (0, 0)]), "touch": wkb([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]),
        "nan": wkb([(0, 0), (math.nan, 0), (1, 1), (0, 0)]), "none": None, "round": wkb([*many, many[0]]), "twisted": wkb([*many[:700], many[720], many[710], *many[730:], many[0]]), "twice": wkb([square[0], *square]),
    }
    df = spark.createDataFrame(list(rows.items()), "district string, geometry binary")
    got = dict(map(tuple, validity.invalid_geometries(df, "district").collect()))
    assert got == {"bow": "crossing", "open": "open", "short": "short", "touch": "crossing", "nan": "not finite", "none": "missing", "twisted": "crossing"}
    cases = spark.createDataFrame([("ok", D(2020, 1, 1), 1)], "district string, month date, count int")
    issue = {r.code: r for r in checks.check_model_inputs(cases, regions=df).collect()}["geometry_invalid"]
    assert issue.n == 7 and issue.ids == sorted(got)
