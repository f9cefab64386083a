"""One query for each operator, over the tables of a folder. Doubles are rounded to six decimals."""

from __future__ import annotations

from datetime import date
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survperf.functions.expr import window_year
from survperf.functions.session import cut
from survperf.operators import checks, compare, expected, graph, guide, national, outline, prepare, render, rolling, simple, validity
from survperf.sources import testdata as td
from survperf.streaming import panel as stream

AS_OF, START = date(2001, 9, 15), 1995
WINDOW = prepare.window(date(2000, 1, 20), 12, 1)
FIRST, N_DRAWS = 1998, td.DRAWS
#: Cut, target and year that split these tables.
CUT, TARGET, READ_YEAR = 1.0, 0.4, 2000
REGISTERED: dict = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f):
    """Register a function of (spark, folder) under its name, its doubles rounded."""

    @wraps(f)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(f(spark, folder))

    REGISTERED[f.__name__] = run
    return run


# preparation


def _records(spark: SparkSession, folder: str, unit: str = "district") -> DataFrame:
    return prepare.case_records(td.cases(spark, folder), polio_pattern=td.CLASS_PATTERN, surveillance_types=td.TYPES, unit=unit)


def _population(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly populations."""
    return td.annual(spark, folder).select(F.col("district").alias("adm2_guid"), "year", F.col("pop").alias("u15_pop"))


@query
def case_date(spark, folder):
    return td.cases(spark, folder).select("case_id", prepare.case_date().alias("date"))


@query
def case_records(spark, folder):
    return _records(spark, folder).select("unit", "polio", "month")


@query
def panel_months(spark, folder):
    """The panel at the last order of each customer: its first and last month and their number."""
    orders = td.table(spark, folder, "orders")
    last = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.to_date(F.max("o_orderdate")).alias("as_of"))
    months = last.withColumn("m", prepare.panel_months_of(F.col("as_of"), START))
    return months.select("custkey", "as_of", F.array_min("m").alias("first"), F.array_max("m").alias("last"), F.size("m").cast("long").alias("n"))


@query
def window_months(spark, folder):
    """How many orders have each month in the window that is closed at their day."""
    days = td.orders(spark, folder).select(F.explode(prepare.window_of(F.col("day"), 12, 1)).alias("month"))
    return days.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query
def case_panel(spark, folder):
    months = prepare.months_frame(spark, prepare.panel_months(AS_OF, START))
    return prepare.case_panel(td.cases(spark, folder), td.areas(spark, folder), months, polio_pattern=td.CLASS_PATTERN, surveillance_types=td.TYPES)


@query
def pop_observed(spark, folder):
    return prepare.pop_observed(_population(spark, folder), td.areas(spark, folder), list(range(1996, 2001)))


@query
def pop_index(spark, folder):
    return prepare.pop_index(prepare.pop_observed(td.annual(spark, folder).filter("not (district = '3' and year = 1997)"), None, None, "district", "year", "pop"))


@query
def pop_panel(spark, folder):
    annual = cut(td.annual(spark, folder))
    observed = prepare.pop_observed(annual.filter("not (district in ('3', '7') and year in (1996, 1998)) and district <> '9'"), None, None, "district", "year", "pop")
    return prepare.pop_panel(observed, td.areas(spark, folder), annual.select("year"))


@query
def stool_adequacy(spark, folder):
    return prepare.stool_adequacy(_records(spark, folder), WINDOW)


@query
def seasonal_features(spark, folder):
    months = td.orders(spark, folder).select("month").distinct()
    return months.select("month", *[v.alias(k) for k, v in prepare.seasonal_features(F.col("month")).items()])


@query
def covariate_standardise(spark, folder):
    rows = td.annual(spark, folder).withColumn("flat", F.lit(1.0))
    return expected.covariate_standardise(rows, ["observed", "pop", "flat"], ("pop",)).select("district", "year", "x_observed", "x_pop", "x_flat")


# simple index


@query
def simple_annual(spark, folder):
    return td.annual(spark, folder)


@query
def simple_index(spark, folder):
    return simple.simple_index(td.annual(spark, folder)).summary


@query
def simple_national(spark, folder):
    return simple.simple_index(td.annual(spark, folder)).national


@query
def simple_explain(spark, folder):
    return simple.explain(simple.simple_index(td.annual(spark, folder)).summary).filter(F.col("year") == READ_YEAR)


@query
def simple_by_year_report(spark, folder):
    return simple.by_year(simple.simple_index(td.annual(spark, folder)).summary)


@query
def population_qc(spark, folder):
    rows = td.annual(spark, folder).withColumn("pop", F.when(F.expr("district = '4' and year = 1999"), F.col("pop") * 4).when(F.expr("district = '5' and year >= 1999"), F.col("pop") * 5).otherwise(F.col("pop"))).filter("not (district = '6' and year = 1997)")
    rows = cut(rows)
    return simple.population_qc(rows, simple.targets(rows))


# checks


@query
def check_panel_gaps(spark, folder):
    return checks.panel_gaps(td.orders(spark, folder))


@query
def check_duplicates(spark, folder):
    return checks.duplicates(td.orders(spark, folder), "district", "month")


@query
def check_pop_coverage(spark, folder):
    population = _population(spark, folder).select(F.col("adm2_guid").alias("district"), "year")
    return checks.coverage(td.panel(spark, folder), population)


def _issues(found: DataFrame) -> DataFrame:
    return found.select("severity", "code", F.coalesce("n", F.lit(0)).alias("n"), F.array_join("ids", ",").alias("ids"))


def _spoiled(spark: SparkSession, folder: str) -> DataFrame:
    rows = cut(td.panel(spark, folder)).filter("not (district = '2' and month = date'1999-05-01')")
    rows = rows.withColumn("count", F.when(F.expr("district = '3' and month = date'1999-05-01'"), -1).otherwise(F.col("count")))
    return rows.unionByName(rows.filter("district = '4' and month = date'1999-06-01'"))


@query
def check_issues(spark, folder):
    population = cut(td.annual(spark, folder)).filter("not (district = '5' and year = 1997)").withColumn("pop", F.when(F.expr("district = '6'"), 0.0).otherwise(F.col("pop")))
    regions = td.areas(spark, folder).filter("district <> '7'").unionByName(spark.createDataFrame([("99", "9", "x")], "district string, area string, name string"))
    return _issues(checks.check_model_inputs(_spoiled(spark, folder), population, regions, regions, 2))


@query
def check_findings(spark, folder):
    """Each district that a rule finds in spoiled daily counts and populations, which grow with the tables."""
    daily = td.orders(spark, folder).select("district", F.to_date("day").alias("month"), F.when(F.col("orderkey") % 97 == 0, -1.0).when(F.col("orderkey") % 89 == 0, 0.5).otherwise(F.lit(1.0)).alias("count"))
    people = td.orders(spark, folder).select("district", F.year("day").alias("year"), F.when(F.col("orderkey") % 83 == 0, 0.0).when(F.col("orderkey") % 79 == 0, -1.0).otherwise(F.col("price")).alias("pop"))
    found = checks.model_findings(daily, people)
    return found.filter(F.col("code").isin("cases_invalid_count", "cases_negative", "pop_negative", "pop_zero", "cases_duplicates")).select("severity", "code", "id", "n")


@query
def check_id_reconcile(spark, folder):
    found = checks.check_model_inputs(td.panel(spark, folder), regions=td.areas(spark, folder).filter("area <> '1'"))
    return _issues(found.filter(F.col("code").isin("cases_id_not_in_shapefile", "shapefile_no_cases")))


@query
def check_simple_issues(spark, folder):
    annual = cut(td.annual(spark, folder))
    rows = annual.select("district", "year", F.when(F.expr("district = '1' and year = 1996"), -1.0).when(F.expr("district = '2' and year = 1996"), 0.5).otherwise(F.col("observed")).alias("npafp_cases")).filter("not (district = '8' and year = 1999)")
    people = annual.select("district", "year", F.when(F.expr("district = '3' and year = 1996"), 0.0).otherwise(F.col("pop")).alias("population_u15"))
    return _issues(checks.check_simple_inputs(rows, people))


# draws


def _index(spark: SparkSession, folder: str, period, pop: str = "avg", centre: bool = True):
    panel = cut(td.panel(spark, folder))
    return national.summarise(national.cells(td.draws(panel), period), td.observed(panel, period, pop=pop), centre)



@query
def spi_month(spark, folder):
    return _index(spark, folder, F.col("month"))[0]


@query
def spi_quarter(spark, folder):
    return _index(spark, folder, F.trunc("month", "quarter"))[0]


@query
def spi_year(spark, folder):
    return _index(spark, folder, F.year("month"))[0]


@query
def spi_year_end_april(spark, folder):
    return _index(spark, folder, window_year(F.col("month"), 4))[0]


@query
def spi_total(spark, folder):
    return _index(spark, folder, F.lit("all"))[0]


@query
def spi_uncentred(spark, folder):
    return _index(spark, folder, F.year("month"), centre=False)[0]


@query
def national_oe(spark, folder):
    return _index(spark, folder, F.year("month"))[1]


@query
def low_information(spark, folder):
    return national.low_information(_index(spark, folder, F.col("month"))[0], 7.0).select("unit", "period", "expected_total")


@query
def spi_totals(spark, folder):
    panel = cut(td.panel(spark, folder))
    return national.totals(national.cells(td.draws(panel), F.year("month")), td.observed(panel, F.year("month")))


@query
def spi_diagnostics(spark, folder):
    return national.diagnostics(_index(spark, folder, F.year("month"))[0])


# rolling windows


def _window(spark: SparkSession, folder: str, parents: bool = False) -> DataFrame:
    who = td.areas(spark, folder).filter("district <> '11'").select("district", F.col("area").alias("parent")) if parents else None
    panel = cut(td.panel(spark, folder))
    return rolling.window_summary(panel, td.draws(panel), WINDOW, who)


@query
def window_summary(spark, folder):
    return _window(spark, folder)


@query
def window_summary_parents(spark, folder):
    return _window(spark, folder, parents=True)


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.classify(_window(spark, folder), rate_target=TARGET, index_threshold=1.0)


@query
def window_classify(spark, folder):
    return _classified(spark, folder)


@query
def rolling_index(spark, folder):
    return rolling.rolling_table(_classified(spark, folder), prepare.stool_adequacy(_records(spark, folder), WINDOW))


# comparison


def _comparison(spark: SparkSession, folder: str, rule: str = "median") -> DataFrame:
    index = cut(_index(spark, folder, F.year("month"))[0]).withColumnRenamed("unit", "district").withColumnRenamed("period", "year")
    rows = compare.compare(index, CUT, rule, TARGET)
    areas = td.areas(spark, folder).select("district", "area")
    return rows.join(F.broadcast(areas), "district")


_SHOWN = ("district", "year", "observed", "expected_total", "spi_median", "spi_q05", "spi_q95", "npafp_rate", "npafp_adequate", "spi_below_threshold", "spi_pass", "category")


@query
def compare_npafp(spark, folder):
    return _comparison(spark, folder).select(*_SHOWN)


@query
def compare_interval_rule(spark, folder):
    return _comparison(spark, folder, "interval").select(*_SHOWN)


@query
def compare_simple(spark, folder):
    index = compare.from_simple(simple.simple_index(td.annual(spark, folder)).summary)
    return compare.compare(index, 1.0, "median", TARGET, simple=True).select("district", "year", "spi_median", "npafp_rate", "category")


@query
def compare_categories(spark, folder):
    return compare.counts_by_category(_comparison(spark, folder))


@query
def compare_crosstab(spark, folder):
    return compare.crosstab(_comparison(spark, folder))


@query
def compare_metrics(spark, folder):
    return compare.metrics(_comparison(spark, folder))


@query
def compare_by_stratum(spark, folder):
    return compare.metrics(_comparison(spark, folder), ["area"])


@query
def map_bins(spark, folder):
    return compare.map_bins(_comparison(spark, folder), READ_YEAR)


# field guide


def _edges(spark: SparkSession, folder: str, rule: str = "queen") -> DataFrame:
    return graph.contiguity(td.vertices(spark, folder), rule)


def _guide(spark: SparkSession, folder: str) -> DataFrame:
    rows = guide.add_strength(_comparison(spark, folder), CUT)
    rows = guide.add_extent(guide.add_previous(rows, CUT), CUT)
    return guide.add_verdict(guide.add_process(rows, td.process(spark, folder)))


@query
def fg_strength(spark, folder):
    rows = guide.add_strength(_comparison(spark, folder), CUT, noise_alpha=0.3)
    return rows.select("district", "year", "conventional_pass", "spi_below", "noise_plausible", "cri_excludes_1", "gate_pass", "s1_discordance")


@query
def fg_noise_tail(spark, folder):
    return guide.add_strength(_comparison(spark, folder), CUT).select("district", "year", "noise_tail")


@query
def fg_extent(spark, folder):
    return guide.add_extent(_comparison(spark, folder), CUT).select("district", "year", "others", "others_below", "extent_pct", "national_pct", "extent_concern")


@query
def fg_process(spark, folder):
    rows = guide.add_process(_comparison(spark, folder).select("district", "year"), td.process(spark, folder), target=50.0, min_cases=60)
    return rows


@query
def fg_persistence(spark, folder):
    return guide.add_previous(_comparison(spark, folder), CUT).select("district", "year", "previous_spi", "persistence_concern")


@query
def fg_runs(spark, folder):
    return guide.add_runs(_comparison(spark, folder), CUT).select("district", "year", "trailing_run", "longest_run")


@query
def fg_trajectory(spark, folder):
    return guide.add_trajectory(_comparison(spark, folder)).select("district", "year", "slope", "trajectory")


@query
def trajectory_pvalue(spark, folder):
    return guide.add_trajectory(_comparison(spark, folder), alpha=0.1).select("district", "year", "slope_p", "trajectory")


@query
def fg_neighbour(spark, folder):
    return guide.add_neighbour(_comparison(spark, folder), _edges(spark, folder, "rook"), CUT).select("district", "year", "neighbour_spi", "island", "neighbour_discordant", "neighbourhood_shortfall")


@query
def fg_seasonal(spark, folder):
    monthly = _index(spark, folder, F.col("month"))[0].select(F.col("unit").alias("district"), F.col("period").alias("month"), "observed", "expected_total")
    return guide.seasonal(monthly.withColumn("observed", F.when(F.expr("district = '3'"), 0).when(F.expr("district = '4'"), F.floor(F.col("observed") / 4)).otherwise(F.col("observed"))))


@query
def fg_detections(spark, folder):
    return guide.detections(_comparison(spark, folder).select("district", "year"), td.detections(spark, folder), "afp")


@query
def fg_es(spark, folder):
    return guide.detections(_comparison(spark, folder).select("district", "year"), td.environmental(spark, folder), "es")


@query
def fg_verdict(spark, folder):
    return _guide(spark, folder).select("district", "year", "verdict", "verdict_order")


@query
def fg_verdict_counts(spark, folder):
    return guide.verdict_counts(_guide(spark, folder).filter(F.col("year") == READ_YEAR))


@query
def fg_concerns(spark, folder):
    return guide.concern_counts(_guide(spark, folder).filter(F.col("year") == READ_YEAR))


@query
def fg_scan(spark, folder):
    return guide.scan_table(_guide(spark, folder).filter(F.col("year") == READ_YEAR), simple=True)


@query
def fg_worked(spark, folder):
    return guide.worked_examples(_guide(spark, folder).filter(F.col("year") == READ_YEAR))


# graph


@query
def adjacency_queen(spark, folder):
    return _edges(spark, folder)


@query
def adjacency_rook(spark, folder):
    return _edges(spark, folder, "rook")


@query
def adjacency_snap_queen(spark, folder):
    return graph.contiguity(td.parcels(spark, folder))


@query
def adjacency_snap_rook(spark, folder):
    return graph.contiguity(td.parcels(spark, folder), "rook")


@query
def adjacency_islands(spark, folder):
    corners = td.vertices(spark, folder, shift_from=23)
    return graph.attach_islands(graph.contiguity(corners), graph.centroids(corners))


@query
def adjacency_degree(spark, folder):
    return graph.degrees(td.areas(spark, folder), _edges(spark, folder))


@query
def adjacency_components(spark, folder):
    corners = td.vertices(spark, folder, shift_from=23)
    return graph.components(td.areas(spark, folder), graph.contiguity(corners))


@query
def adjacency_summary(spark, folder):
    return graph.graph_summary(td.areas(spark, folder), _edges(spark, folder))


@query
def centroids(spark, folder):
    return graph.centroids(td.vertices(spark, folder))


@query
def province_outline(spark, folder):
    areas = td.areas(spark, folder).select("district", F.col("area").alias("province"))
    return outline.province_outline(td.vertices(spark, folder), areas)


@query
def province_areas(spark, folder):
    rings = outline.province_rings(td.parcels(spark, folder, shake=0.0), td.parcel_provinces(spark, folder))
    return outline.province_measures(rings)


@query
def geometry_faults(spark, folder):
    return validity.geometry_faults(td.drawn_parcels(spark, folder))


@query
def adjacency_nearest(spark, folder):
    """Parcels far from all others, with their nearest ones."""
    parcels = td.parcels(spark, folder, apart=7)
    return graph.island_links(graph.contiguity(parcels), graph.centroids(parcels))


# labels and streams


@query
def labelled_years(spark, folder):
    names = td.areas(spark, folder).select("district", F.col("area").alias("adm1_name"), F.col("name").alias("adm2_name"))
    return checks.attach_labels(td.annual(spark, folder), names)


@query
def closed_panel(spark, folder):
    """The daily counts of a stream, here of all days at once, and the months made of them."""
    daily = stream.monthly_counts(td.orders(spark, folder).select("district", F.col("day").alias("case_date")))
    return stream.closed_panel(daily)


# plot data


@query
def plot_histogram(spark, folder):
    return render.histogram(_index(spark, folder, F.year("month"))[0], 10)


@query
def plot_caterpillar(spark, folder):
    rows = _index(spark, folder, F.year("month"))[0].filter(F.col("period") == READ_YEAR).withColumnRenamed("unit", "district")
    return render.caterpillar(rows, 5)


@query
def plot_calibration(spark, folder):
    return render.calibration(_index(spark, folder, F.year("month"))[0])


@query
def plot_funnel(spark, folder):
    return render.funnel(_comparison(spark, folder))


@query
def pit_ks(spark, folder):
    return expected.pit_distance(td.orders(spark, folder).select((F.dayofyear("day") / 366).alias("pit")))


# model


def _masked(spark: SparkSession, folder: str) -> DataFrame:
    """All years of the data that have the history a fit needs."""
    return expected.masked(td.panel(spark, folder), expected.windows(FIRST, AS_OF.year))


@query
def assessment_windows(spark, folder):
    rows = _masked(spark, folder)
    return rows.groupBy("target").agg(F.min("month").alias("training_start"), F.min(F.when(F.col("inside"), F.col("month"))).alias("opens"), F.max("month").alias("closes"), F.count("count").alias("known"), F.sum(F.col("inside").cast("long")).alias("hidden"))


@query
def expected_fit(spark, folder):
    drawn = expected.fit(_masked(spark, folder), _edges(spark, folder))
    return drawn.groupBy("target", "district", "month").agg(F.percentile("expected", F.lit(0.5)).alias("expected_median"), F.avg("expected").alias("expected_mean"))


@query
def expected_effects(spark, folder):
    return expected.effects(_masked(spark, folder), _edges(spark, folder))


@query
def spi_index_fitted(spark, folder):
    drawn = expected.fit(_masked(spark, folder), _edges(spark, folder))
    panel = td.panel(spark, folder).filter(F.year("month") >= FIRST)
    return national.summarise(national.cells(drawn, F.year("month")), national.observed_of(panel, F.year("month")))[0]


@query
def compare_overdispersion(spark, folder):
    rows = expected.compare_overdispersion(_masked(spark, folder), _edges(spark, folder))
    return expected.recommend(rows)
