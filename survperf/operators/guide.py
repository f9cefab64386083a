"""Review components, context signals and the review label of each district-year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.expr import finite, isin_false, poisson_lower, safe_div, slope_p
from survperf.functions.session import cut

PROCESS_TARGET, PROCESS_MIN_CASES, NOISE_ALPHA = 80.0, 5, 0.05
TREND_YEARS, TREND_TOLERANCE, PEAK_QUANTILE, MUTED = 5, 0.01, 2 / 3, 0.5
SIMPLE_CUT, MODEL_CUT = 0.5, 1.0
#: Review labels, strongest first.
VERDICTS = ("Priority for review", "Monitor", "No SPI indication")


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def add_strength(dy: DataFrame, spi_cut: float, simple: bool = False, noise_alpha: float | None = None) -> DataFrame:
    """Strength of a shortfall: below the cut, the noise tail of the count, and the gate."""
    rows = dy.withColumns({"conventional_pass": F.col("npafp_adequate"), "spi_below": F.col("spi_median") < spi_cut, "noise_tail": poisson_lower(F.col("observed"), F.col("expected_total")), "cri_excludes_1": F.col("spi_q95") < 1})
    rows = rows.withColumn("noise_plausible", is_true(F.col("noise_tail") > (NOISE_ALPHA if noise_alpha is None else noise_alpha)))
    gate = F.col("spi_below") if simple else F.col("spi_q95") < 1
    rows = rows.withColumn("gate_pass", gate if noise_alpha is None else gate & ~F.col("noise_plausible"))
    return rows.withColumn("s1_discordance", F.col("conventional_pass") & F.col("spi_below") & F.col("gate_pass"))


def add_previous(dy: DataFrame, spi_cut: float) -> DataFrame:
    """Persistence: the index of exactly the year before."""
    before = dy.select("district", (F.col("year") + 1).alias("year"), F.col("spi_median").alias("previous_spi"))
    rows = dy.join(before, ["district", "year"], "left")
    return rows.withColumn("persistence_concern", F.col("previous_spi") < spi_cut)


def add_extent(dy: DataFrame, spi_cut: float, area: str = "area") -> DataFrame:
    """Extent: low indices among the area's other districts against the nation, itself included."""
    below = is_true(F.col("spi_median") < spi_cut).cast("long")
    own = Window.partitionBy("year", area)
    national = dy.groupBy("year").agg((100 * F.avg(below.cast("double"))).alias("national_pct"))
    rows = dy.withColumns({"others": F.count(F.lit(1)).over(own) - 1, "others_below": F.sum(below).over(own) - below})
    rows = rows.withColumn("extent_pct", safe_div(100.0 * F.col("others_below"), F.col("others"))).join(F.broadcast(national), "year")
    return rows.withColumn("extent_concern", F.col("extent_pct") > F.col("national_pct"))


def add_process(dy: DataFrame, process: DataFrame, target: float = PROCESS_TARGET, min_cases: int = PROCESS_MIN_CASES) -> DataFrame:
    """Timeliness and stool adequacy: assessed from ``min_cases`` on, a concern below ``target`` per cent."""
    counts = ("n_cases", "n_adequate", "n_transport", "n_transport_timely")
    rows = dy.drop(*counts).join(process.select("district", "year", *counts), ["district", "year"], "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in counts})
    rows = rows.withColumns({"pct_transport_timely": safe_div(100.0 * F.col("n_transport_timely"), F.col("n_transport")), "pct_adequate": safe_div(100.0 * F.col("n_adequate"), F.col("n_cases"))})
    rows = rows.withColumns({"transport_assessed": F.col("n_transport") >= min_cases, "adequacy_assessed": F.col("n_cases") >= min_cases})
    return rows.withColumns({"timeliness_concern": F.when(F.col("transport_assessed"), F.col("pct_transport_timely") < target), "adequacy_concern": F.when(F.col("adequacy_assessed"), F.col("pct_adequate") < target)})


def add_runs(dy: DataFrame, spi_cut: float) -> DataFrame:
    """trailing_run and longest_run of recorded years below the cut, up to each year."""
    order = Window.partitionBy("district").orderBy("year")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    below = is_true(F.col("spi_median") < spi_cut)
    rows = dy.withColumn("_island", F.sum((~below).cast("long")).over(upto))
    inside = Window.partitionBy("district", "_island").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("trailing_run", F.sum(below.cast("int")).over(inside).cast("int"))
    return rows.withColumn("longest_run", F.max("trailing_run").over(upto)).drop("_island")


def add_trajectory(dy: DataFrame, years: int = TREND_YEARS, tolerance: float = TREND_TOLERANCE, alpha: float | None = None) -> DataFrame:
    """Least-squares slope over the last ``years`` calendar years, its p, and falling, rising or flat."""
    frame = Window.partitionBy("district").orderBy("year").rangeBetween(1 - years, 0)
    y, x = finite(F.col("spi_median")), F.col("year").cast("double")
    rows = dy.withColumns({"_n": F.count(y).over(frame), "_sxx": F.regr_sxx(y, x).over(frame), "_syy": F.regr_syy(y, x).over(frame), "_sxy": F.regr_sxy(y, x).over(frame)})
    rows = rows.withColumn("slope", F.when(F.col("_n") >= 2, safe_div(F.col("_sxy"), F.col("_sxx"))))
    sure = F.lit(True)
    if alpha is not None:
        rows = rows.withColumn("slope_p", slope_p(F.col("_n"), F.col("_sxx"), F.col("_syy"), F.col("_sxy")))
        sure = is_true(F.col("slope_p") < alpha)
    label = F.when(F.col("slope").isNull(), None).when((F.col("slope") <= -tolerance) & sure, "falling").when((F.col("slope") >= tolerance) & sure, "rising").otherwise("flat")
    return rows.withColumn("trajectory", label).drop("_n", "_sxx", "_syy", "_sxy")


def add_neighbour(dy: DataFrame, edges: DataFrame, spi_cut: float) -> DataFrame:
    """Median index of the neighbours in the same year, and what it says of a shortfall."""
    near = edges.join(dy.select(F.col("district").alias("neighbour"), "year", "spi_median"), "neighbour")
    medians = near.groupBy(F.col("focal").alias("district"), "year").agg(F.percentile("spi_median", F.lit(0.5)).alias("neighbour_spi"))
    linked = edges.select(F.col("focal").alias("district")).distinct().withColumn("_linked", F.lit(True))
    rows = dy.join(medians, ["district", "year"], "left").join(linked, "district", "left")
    low, near_spi = F.col("spi_median") < spi_cut, F.col("neighbour_spi")
    return rows.withColumns({"island": F.col("_linked").isNull(), "neighbour_discordant": is_true((near_spi >= spi_cut) & low), "neighbourhood_shortfall": is_true((near_spi < spi_cut) & low)}).drop("_linked")


def seasonal(monthly: DataFrame) -> DataFrame:
    """(district, year, seasonal): counts through the months of highest expectation; ties belong to the peak."""
    rows = monthly.withColumn("year", F.year("month"))
    own = Window.partitionBy("district", "year")
    rows = rows.withColumn("_cut", F.percentile("expected_total", F.lit(PEAK_QUANTILE)).over(own))
    peak = is_true(F.col("expected_total") >= F.col("_cut"))
    sums = rows.groupBy("district", "year").agg(F.coalesce(F.sum("expected_total"), F.lit(0.0)).alias("e"), F.coalesce(F.sum(F.when(peak, F.col("observed"))), F.lit(0)).alias("op"), F.sum(F.when(peak, F.col("expected_total"))).alias("ep"))
    label = F.when(F.col("e") == 0, "not assessed").when(F.col("op") == 0, "blind").when(safe_div(F.col("op"), F.col("ep")) < MUTED, "muted").otherwise("present")
    return sums.select("district", "year", label.alias("seasonal"))


def detections(dy: DataFrame, found: DataFrame, name: str, serotypes: list[str] | None = None) -> DataFrame:
    """``dy`` with ``name``_years, ``name``_flag and ``name``_serotypes up to each year.

    ``found`` is (district, year, n[, serotype]); rows count where n > 0. No detection is '', a
    channel without a serotype column has null serotypes.
    """
    typed = "serotype" in found.columns
    rows = found.filter(is_true(F.col("n") > 0))
    if typed:
        rows = rows.withColumn("serotype", F.when(F.trim("serotype") != "", F.trim("serotype")))
        if serotypes is not None:
            rows = rows.filter(isin_false(F.col("serotype"), serotypes))
    distinct = rows.select("district", F.col("year").cast("int").alias("_seen"), *(["serotype"] if typed else [])).distinct()
    joined = dy.select("district", "year").join(distinct, "district").filter(F.col("_seen") <= F.col("year"))
    names = F.array_join(F.array_sort(F.collect_set("serotype")), ", ") if typed else F.lit(None).cast("string")
    lists = joined.groupBy("district", "year").agg(F.array_join(F.transform(F.array_sort(F.collect_set("_seen")), lambda y: y.cast("string")), ", ").alias("_years"), names.alias("_types"))
    out = dy.join(lists, ["district", "year"], "left")
    years = F.coalesce("_years", F.lit(""))
    types = F.coalesce("_types", F.lit("")) if typed else F.col("_types")
    return out.withColumns({f"{name}_years": years, f"{name}_flag": years != "", f"{name}_serotypes": types}).drop("_years", "_types")


def add_verdict(dy: DataFrame, spi_rule: str = "median") -> DataFrame:
    """The review label, and its place in the order of labels."""
    supported = is_true(F.col("extent_concern")) | is_true(F.col("persistence_concern"))
    labelled = F.col("spi_below")
    if spi_rule == "interval":
        labelled = labelled & is_true(F.col("cri_excludes_1"))
    verdict = F.when(is_true(F.col("spi_below") & F.col("gate_pass") & supported), VERDICTS[0]).when(is_true(labelled), VERDICTS[1]).otherwise(VERDICTS[2])
    order = F.when(verdict == VERDICTS[0], 1).when(verdict == VERDICTS[1], 2).otherwise(3)
    return dy.withColumns({"verdict": verdict, "verdict_order": order})


def scan_table(focal: DataFrame, simple: bool = False) -> DataFrame:
    """Compact columns of the review table; order by verdict_order, spi and district to rank."""
    pct = lambda c: F.bround(F.col(c), 0)
    cols = [F.col("district"), F.col("observed").alias("obs"), F.bround("expected_total", 1).alias("exp"), F.bround("spi_median", 2).alias("spi")]
    if not simple:
        cols.append(F.format_string("%.2f-%.2f", "spi_q05", "spi_q95").alias("cri"))
    return focal.select(*cols, F.bround("npafp_rate", 1).alias("npafp"), F.col("extent_concern").alias("extent"), F.col("persistence_concern").alias("persist"), pct("pct_transport_timely").alias("transport"), pct("pct_adequate").alias("adequacy"), "verdict", "verdict_order")


def worked_examples(focal: DataFrame) -> DataFrame:
    """(example, district): up to four teaching districts, each chosen among those not taken before.

    1 no indication and a passed target, of the largest expected count (else the highest index);
    2 below the cut with an interval over 1, both corroborators first; 3 priority with both
    corroborators and a passed target; 4 below, gate passed, persistent without extent; 2 to 4 the
    lowest index first. Ties go to the smaller district.
    """
    both = is_true(F.col("extent_concern")) & is_true(F.col("persistence_concern"))
    low = F.col("spi_median").asc_nulls_last()
    none = F.col("verdict") == VERDICTS[2]
    picks = (
        (none, [(~is_true(F.col("conventional_pass"))).cast("int"), F.when(is_true(F.col("conventional_pass")), -F.col("expected_total")).otherwise(-F.col("spi_median")).asc_nulls_last()]),
        (is_true(F.col("spi_below")) & is_true(F.col("spi_q95") >= 1), [(~both).cast("int"), low]),
        ((F.col("verdict") == VERDICTS[0]) & both & is_true(F.col("conventional_pass")), [low]),
        (is_true(F.col("spi_below")) & is_true(F.col("gate_pass")) & is_true(F.col("persistence_concern")) & ~is_true(F.col("extent_concern")), [low]),
    )
    rows = cut(focal.select("district", "verdict", "extent_concern", "persistence_concern", "conventional_pass", "expected_total", "spi_median", "spi_q95", "spi_below", "gate_pass"))
    taken: list[tuple[int, str]] = []
    for n, (condition, order) in enumerate(picks, 1):
        # at most three are taken before, so four candidates always suffice
        best = [r.district for r in rows.filter(condition).orderBy(*order, "district").limit(len(picks)).select("district").collect()]
        free = [d for d in best if d not in {t for _, t in taken}]
        if free:
            taken.append((n, free[0]))
    return focal.sparkSession.createDataFrame(taken, "example int, district string")


def verdict_counts(focal: DataFrame) -> DataFrame:
    """(verdict, n, pct) of each label, zeros included."""
    levels = focal.sparkSession.createDataFrame([(i, v) for i, v in enumerate(VERDICTS, 1)], "verdict_order int, verdict string")
    counted = focal.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
    full = F.broadcast(levels).join(counted, "verdict", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = full.agg(F.sum("n").alias("total"))
    return full.join(F.broadcast(total), F.lit(True)).select("verdict_order", "verdict", "n", safe_div(100.0 * F.col("n"), F.col("total")).alias("pct"))


def concern_counts(focal: DataFrame) -> DataFrame:
    """One row: how many districts below the cut carry each concern."""
    names = ("timeliness_concern", "extent_concern", "persistence_concern", "adequacy_concern")
    return focal.filter(is_true(F.col("spi_below"))).agg(F.count(F.lit(1)).alias("n_below"), *[F.coalesce(F.sum(is_true(F.col(c)).cast("long")), F.lit(0)).alias(c.replace("_concern", "")) for c in names])
