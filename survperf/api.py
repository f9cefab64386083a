"""End-to-end calls: from panels and populations to an index, a comparison and a review guide.

Results are dataclasses of DataFrames. Fits are materialised once in the checkpoint folder, since
several tables are made from their draws; all else is lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.functions.expr import window_year
from survperf.functions.session import cut
from survperf.operators import checks, compare, expected, guide, national, prepare, rolling, simple

LEVELS = ("district_year", "district_month", "district_quarter", "district_total")


@dataclass
class Fit:
    """``data`` (district, month, count, pop), ``draws`` (target, district, month, draw, expected), ``criteria`` by likelihood."""

    data: DataFrame
    draws: DataFrame
    model: expected.Model
    criteria: DataFrame | None = None

    def summary(self) -> DataFrame:
        """(target, district, month, expected_median, expected_mean, expected_q05, q10, q90, q95)."""
        q = F.percentile("expected", F.array(*[F.lit(x) for x in (0.05, 0.1, 0.5, 0.9, 0.95)]))
        rows = self.draws.groupBy("target", "district", "month").agg(q.alias("q"), F.avg("expected").alias("expected_mean"))
        names = ("expected_q05", "expected_q10", "expected_median", "expected_q90", "expected_q95")
        return rows.select("target", "district", "month", "expected_mean", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])


@dataclass
class Index:
    summary: DataFrame
    national: DataFrame
    low_information: DataFrame
    totals: DataFrame
    windows: DataFrame
    draws: DataFrame


@dataclass
class Comparison:
    district_year: DataFrame
    counts: DataFrame
    crosstab: DataFrame
    metrics: DataFrame
    by_stratum: DataFrame | None
    rule: str
    simple: bool


@dataclass
class Guide:
    district_year: DataFrame
    focal: DataFrame
    read_year: int
    signals: dict[str, bool]


def model_panel(cases: DataFrame, population: DataFrame, covariates: DataFrame | None = None, log_covariates: tuple[str, ...] = ()) -> DataFrame:
    """(district, month, count, pop, fit_pop[, x_*]): cases joined to populations at the grain these have.

    ``fit_pop`` is a yearly population whatever the grain. Covariates join on the keys they share.
    A cell without a population is an error.
    """
    prepare.need_columns(cases, "district", "month", "count")
    monthly = "month" in population.columns
    keys = ["district", "month"] if monthly else ["district", "year"]
    rows = cases.select("district", "month", "count", F.year("month").alias("year"))
    panel = rows.join(population.select(*keys, F.col("pop").cast("double").alias("pop")), keys, "left")
    lacking = panel.filter("pop is null").select("district", "month").limit(3).collect()
    if lacking:
        raise ValueError("no population for " + ", ".join(f"{r.district} in {r.month:%Y-%m}" for r in lacking))
    panel = panel.withColumn("fit_pop", F.col("pop") * (12 if monthly else 1))
    if covariates is not None:
        shared = [c for c in ("district", "month", "year") if c in covariates.columns]
        names = [c for c in covariates.columns if c not in shared]
        panel = expected.covariate_standardise(panel.join(covariates, shared, "left"), names, log_covariates).drop(*names)
    return panel.drop("year")


def _masked(panel: DataFrame, years: list[tuple[int, date, date]]) -> DataFrame:
    return expected.masked(panel.drop("pop").withColumnRenamed("fit_pop", "pop"), years)


def expected_counts(panel: DataFrame, edges: DataFrame, years: list[tuple[int, date, date]], model: expected.Model = expected.Model(), overdispersion: str | None = None) -> Fit:
    """Draws of each assessment window. ``overdispersion="auto"`` first compares the likelihoods with few draws and takes the recommended one, "iid" if none is."""
    rows = _masked(panel, years)
    criteria = None
    if overdispersion == "auto":
        criteria = cut(expected.recommend(expected.compare_overdispersion(_masked(panel, years[-1:]), edges, model=replace(model, n_draws=min(200, model.n_draws)))))
        model = replace(model, extra=criteria.first().recommended or "iid")
    elif overdispersion is not None:
        model = replace(model, extra=overdispersion)
    return Fit(panel, cut(expected.fit(rows, edges, model)), model, criteria)


def _period(level: str, year_end_month: int) -> Column:
    if level not in LEVELS:
        raise ValueError(f"level is one of {', '.join(LEVELS)}")
    if level != "district_year" and year_end_month != 12:
        raise ValueError("year_end_month applies to district_year alone")
    return {"district_year": window_year(F.col("month"), year_end_month), "district_month": F.col("month"), "district_quarter": F.trunc("month", "quarter"), "district_total": F.lit("all")}[level]


def index_from(fit: Fit, level: str = "district_year", centre: bool = True, year_end_month: int = 12, min_expected: float = national.MIN_EXPECTED, labels: DataFrame | None = None) -> Index:
    """The index at any level from one fit's draws; observed counts come from the unmasked panel."""
    period = _period(level, year_end_month)
    inside = fit.data.join(fit.draws.select("district", "month").distinct(), ["district", "month"], "left_semi")
    observed = national.observed_of(inside, period)
    drawn = national.cells(fit.draws, period)
    summary, nat = national.summarise(drawn, observed, centre)
    summary = summary.withColumnRenamed("unit", "district")
    if labels is not None:
        summary = checks.attach_labels(summary, labels)
    spans = inside.groupBy(period.alias("period")).agg(F.min("month").alias("window_start"), F.max("month").alias("window_end"), F.count_distinct("month").alias("months"), F.count_distinct("district").alias("districts"))
    return Index(summary, nat, national.low_information(summary, min_expected), national.totals(drawn, observed), spans, fit.draws)


def assess(cases: DataFrame, population: DataFrame, edges: DataFrame, first: int, last: int, level: str = "district_year", centre: bool = True, year_end_month: int = 12, min_history: int = expected.MIN_HISTORY, model: expected.Model = expected.Model(), overdispersion: str | None = None, covariates: DataFrame | None = None, labels: DataFrame | None = None, check: bool = True) -> Index:
    """One fit for each assessment year on the months before its window, and the index of the windows."""
    _period(level, year_end_month)
    if check:
        checks.abort_on_errors(checks.check_model_inputs(cases, population))
    panel = model_panel(cases, population, covariates)
    start = cases.agg(F.min("month").alias("m")).first().m
    years = expected.windows(first, last, year_end_month, start, min_history)
    return index_from(expected_counts(panel, edges, years, model, overdispersion), level, centre, year_end_month, labels=labels)


def rolling_index(as_of: date, panel: DataFrame, edges: DataFrame | None = None, fit: Fit | None = None, records: DataFrame | None = None, parents: DataFrame | None = None, window_months: int = prepare.WINDOW_MONTHS, lag_months: int = prepare.LAG_MONTHS, person_time: str = "window", model: expected.Model = expected.Model(), adequate_values: tuple[str, ...] = ("Yes",), **rules: object) -> DataFrame:
    """The rolling table at ``as_of``, lowest index first: window summary, classes and stool adequacy.

    ``panel`` is (district, month, count, pop). A ``fit`` can be given again each month; else one is made whose
    window is hidden. ``records`` (unit, month, adequacy) come from ``prepare.case_records``.
    """
    months = prepare.window(as_of, window_months, lag_months)
    if fit is None:
        if edges is None:
            raise ValueError("give a fit or the graph to make one")
        full = panel if "fit_pop" in panel.columns else panel.withColumn("fit_pop", F.col("pop"))
        fit = expected_counts(full, edges, [(months[-1].year, months[0], months[-1])], model)
    summary = rolling.window_summary(panel, fit.draws, months, parents, person_time)
    table = rolling.classify(summary, **rules)
    if records is not None:
        table = rolling.rolling_table(table, prepare.stool_adequacy(records, months, adequate_values))
    return table.orderBy(F.col("spi_median").asc_nulls_last(), "unit")


def compare_rates(index: Index | simple.SimpleIndex, population: DataFrame | None = None, strata: DataFrame | None = None, spi_threshold: float = compare.SPI_THRESHOLD, rule: str = "median", npafp_target: float = compare.NPAFP_TARGET, multiplier: float = compare.NPAFP_MULTIPLIER) -> Comparison:
    """The yearly index against the rate target. ``population`` (district, year, pop) replaces the index's own; ``strata`` is (district, stratum)."""
    is_simple = isinstance(index, simple.SimpleIndex)
    rows = compare.from_simple(index.summary) if is_simple else index.summary.withColumnRenamed("period", "year")
    if population is not None:
        rows = rows.drop("pop").join(population.select("district", "year", "pop"), ["district", "year"])
    done = compare.compare(cut(rows), spi_threshold, rule, npafp_target, multiplier, is_simple)
    groups = None
    if strata is not None:
        done = done.join(strata.select("district", "stratum"), "district", "left")
        groups = compare.metrics(done, ["stratum"])
    return Comparison(done, compare.counts_by_category(done), compare.crosstab(done), compare.metrics(done), groups, rule, is_simple)


def field_guide(comparison: Comparison, areas: DataFrame | None = None, process: DataFrame | None = None, edges: DataFrame | None = None, monthly: DataFrame | None = None, afp: DataFrame | None = None, es: DataFrame | None = None, serotypes: list[str] | None = None, read_year: int | None = None, spi_cut: float | None = None, rule: str | None = None, noise_alpha: float | None = None, trend_years: int = guide.TREND_YEARS, trend_alpha: float | None = None, process_target: float = guide.PROCESS_TARGET, process_min_cases: int = guide.PROCESS_MIN_CASES) -> Guide:
    """Components, context and review labels of a comparison; what is not given is left out, never guessed.

    ``areas`` is (district, area), ``monthly`` (district, month, observed, expected_total), ``afp`` and ``es`` (district, year, n[, serotype]).
    The rule is the comparison's unless given; the cut is 0.5 for the simple index and 1 otherwise.
    """
    rule = rule or comparison.rule
    if comparison.simple and rule == "interval":
        raise ValueError("the simple index has no interval")
    if noise_alpha is not None and not 0 < noise_alpha < 1:
        raise ValueError("noise_alpha lies between 0 and 1")
    cut_at = spi_cut if spi_cut is not None else guide.SIMPLE_CUT if comparison.simple else guide.MODEL_CUT
    rows = guide.add_strength(comparison.district_year, cut_at, comparison.simple, noise_alpha)
    rows = guide.add_runs(guide.add_previous(rows, cut_at), cut_at)
    rows = guide.add_trajectory(rows, trend_years, alpha=trend_alpha)
    none = F.lit(None)
    if areas is not None:
        rows = guide.add_extent(rows.drop("area").join(areas.select("district", "area"), "district", "left"), cut_at)
    else:
        rows = rows.withColumns({"extent_pct": none.cast("double"), "national_pct": none.cast("double"), "extent_concern": none.cast("boolean")})
    if process is not None:
        rows = guide.add_process(rows, process, process_target, process_min_cases)
    else:
        rows = rows.withColumns({**{c: none.cast("double") for c in ("pct_transport_timely", "pct_adequate")}, **{c: none.cast("boolean") for c in ("timeliness_concern", "adequacy_concern")}})
    if edges is not None:
        rows = guide.add_neighbour(rows, edges, cut_at)
    if monthly is not None:
        rows = rows.join(guide.seasonal(monthly), ["district", "year"], "left")
    for name, found in (("afp", afp), ("es", es)):
        if found is not None:
            rows = guide.detections(rows, found, name, serotypes if "serotype" in found.columns else None)
    rows = guide.add_verdict(rows, rule)
    year = read_year if read_year is not None else comparison.district_year.agg(F.max("year").alias("y")).first().y
    given = {"timeliness": process, "extent": areas, "adequacy": process, "surroundings": edges, "seasonal": monthly, "detect_afp": afp, "detect_es": es}
    return Guide(rows, rows.filter(F.col("year") == year), year, {k: v is not None for k, v in given.items()})
