"""Graded data-quality findings: a row for each rule and id, and reports with a row for each rule that finds anything.

All rules about the rows of a table are worked out in one pass over it. The codes of rules are fixed values that callers match on. Rules never stop one another; ``abort_on_errors`` raises with all error messages at once. Rules that
need a column that is missing are left out, since the missing column is itself reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from survperf.functions.expr import safe_div
from survperf.operators import validity
from survperf.operators.simple import population_qc, targets

FOUND = "severity string, code string, message string, at int, id string, n long"
SEVERITIES = ("error", "warning", "note")
COVERAGE_ABORT, COVERAGE_WARN = 80.0, 100.0
#: Messages named by an error.
LISTED = 1000


def fact(spark: SparkSession, severity: str, code: str, message: str) -> DataFrame:
    """A finding that carries no ids."""
    return spark.createDataFrame([(severity, code, message, 0, None, None)], FOUND)


def told(rows: DataFrame, severity: str, code: str, message: str | Column, n: Column | None = None) -> DataFrame:
    """A finding without ids for each of ``rows``."""
    text = message if isinstance(message, Column) else F.lit(message)
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("message"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("id"), (F.lit(None) if n is None else n).cast("long").alias("n"))


def marked(df: DataFrame, key: Column, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """Findings of many rules (severity, code, message, condition) in one pass over ``df``: each id with the number of its rows that a rule finds.

    A row goes on once for each rule that finds it, as a number and an id; numbers are counted before they are shuffled.
    """
    hits = F.array_compact(F.array(*[F.when(condition, F.lit(i)) for i, (_, _, _, condition) in enumerate(rules)]))
    counted = df.select(key.cast("string").alias("id"), F.explode(hits).alias("at")).groupBy("at", "id").agg(F.count(F.lit(1)).alias("n"))
    name = lambda part: F.element_at(F.array(*[F.lit(r[part]) for r in rules]), F.col("at") + 1)
    return counted.select(name(0).alias("severity"), name(1).alias("code"), name(2).alias("message"), "at", "id", "n")


def rule(rows: DataFrame, severity: str, code: str, message: str, key: Column) -> DataFrame:
    """Findings of one rule: all of ``rows``."""
    return marked(rows, key, [(severity, code, message, F.lit(True))])


def findings(rules: list[DataFrame]) -> DataFrame:
    """(severity, code, message, rule, id, n): a row for each id that a rule finds, in no order and without a bound; ``rule`` has the order of rules."""
    numbered = [r.select("severity", "code", "message", (F.lit(1000 * i) + F.col("at")).alias("rule"), "id", "n") for i, r in enumerate(rules)]
    return reduce(DataFrame.unionByName, numbered)


def report(found: DataFrame) -> DataFrame:
    """One row for each rule that found anything: (severity, code, message, n, ids, rule), with ``severity_order`` for sorting errors first. ``ids`` is for reading; at scale use ``findings``."""
    rows = found.groupBy("severity", "code", "message", "rule").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.select("severity", "code", "message", "n", "ids", "rule", order.alias("severity_order"))


def abort_on_errors(issues: DataFrame) -> None:
    found = issues.filter("severity = 'error'").select("message").distinct().limit(LISTED).collect()
    if found:
        raise ValueError("; ".join(r.message for r in found))


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def bad_count(x: Column) -> Column:
    """Neither missing nor a finite whole number."""
    d = x.cast("double")
    return F.coalesce(F.isnan(d) | (F.abs(d) == float("inf")) | (F.floor(d) != d), F.lit(False))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def panel_gaps(df: DataFrame, id_col: str = "district", time_col: str = "month") -> DataFrame:
    """(id, time): cells of the full grid of occurring ids and times that have no row."""
    times = df.select(time_col).distinct().groupBy().agg(F.collect_set(time_col).alias("_t"))
    grid = df.select(id_col).distinct().join(F.broadcast(times), F.lit(True)).select(id_col, F.explode("_t").alias(time_col))
    return grid.join(df.select(id_col, time_col).distinct(), [id_col, time_col], "left_anti")


def coverage(cases: DataFrame, population: DataFrame, id_col: str = "district") -> DataFrame:
    """(cells, covered, pct): case cells that have a population, at the population's grain, to one decimal."""
    if "month" in population.columns:
        grain = F.col("month")
        cells, known = cases.select(id_col, grain.alias("t")), population.select(id_col, grain.alias("t"))
    else:
        cells, known = cases.select(id_col, F.year("month").alias("t")), population.select(id_col, F.col("year").cast("int").alias("t"))
    cells, known = cells.distinct(), known.distinct().withColumn("known", F.lit(1))
    both = cells.join(known, [id_col, "t"], "left").agg(F.count(F.lit(1)).alias("cells"), F.count("known").alias("covered"))
    return both.withColumn("pct", F.bround(safe_div(100.0 * F.col("covered"), F.col("cells")), 1))


def model_findings(cases: DataFrame, population: DataFrame | None = None, regions: DataFrame | None = None, covariates: DataFrame | None = None, n_components: int | None = None, id_col: str = "district", pop_col: str = "pop", invalid_geometry: DataFrame | None = None) -> DataFrame:
    """``findings`` about the inputs of the model: cases (id, month, count), population, regions (id), covariates."""
    spark, rules = cases.sparkSession, []
    if regions is not None and id_col not in regions.columns:
        rules.append(fact(spark, "error", "shapefile_no_id", f"the boundaries have no column {id_col}"))
        regions = None
    if invalid_geometry is None and regions is not None and "geometry" in regions.columns:
        invalid_geometry = validity.invalid_geometries(regions, id_col)
    if invalid_geometry is not None:
        rules.append(rule(invalid_geometry, "warning", "geometry_invalid", "invalid geometries", F.col(id_col)))
    missing = [c for c in (id_col, "month", "count") if c not in cases.columns]
    if missing:
        rules.append(fact(spark, "error", "cases_missing_cols", f"cases lack {', '.join(missing)}"))
        return findings(rules)
    rules.append(told(cases.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), "error", "cases_empty", "cases have no rows"))
    dated = isinstance(cases.schema["month"].dataType, T.DateType)
    if not dated:
        rules.append(fact(spark, "error", "cases_month_class", "month is not a date"))
    if _numeric(cases, "count"):
        count = F.col("count")
        rules.append(marked(cases, F.col(id_col), [("error", "cases_invalid_count", "counts that are not finite whole numbers", bad_count(count)), ("error", "cases_negative", "negative counts", count < 0)]))
    else:
        rules.append(fact(spark, "error", "cases_count_type", "count is not a number"))
    rules.append(rule(duplicates(cases, id_col, "month"), "error", "cases_duplicates", "more than one row for a district and month", F.col(id_col)))
    if regions is not None:
        a, b = cases.select(F.col(id_col).cast("string").alias("k")).distinct(), regions.select(F.col(id_col).cast("string").alias("k")).distinct()
        rules += [rule(a.join(b, "k", "left_anti"), "error", "cases_id_not_in_shapefile", "districts of cases without a boundary", F.col("k")), rule(b.join(a, "k", "left_anti"), "warning", "shapefile_no_cases", "boundaries without cases", F.col("k"))]
    rules.append(rule(panel_gaps(cases, id_col), "warning", "panel_gaps", "districts and months without a row", F.col(id_col)))
    if population is not None:
        if id_col not in population.columns:
            rules.append(fact(spark, "error", "pop_missing_id", f"population lacks {id_col}"))
        elif pop_col not in population.columns:
            rules.append(fact(spark, "error", "pop_missing_denominator", f"population lacks {pop_col}"))
        elif not {"year", "month"} & set(population.columns):
            rules.append(fact(spark, "error", "pop_no_grain", "population has neither year nor month"))
        else:
            people = F.col(pop_col)
            rules.append(marked(population, F.col(id_col), [("error", "pop_negative", "negative populations", people < 0), ("warning", "pop_zero", "populations of zero, floored at a half by the fit", people == 0)]))
            if dated:
                short = coverage(cases, population, id_col).filter(F.col("pct") < COVERAGE_WARN)
                rules.append(told(short, "warning", "pop_coverage", F.concat(F.format_string("%.1f", "pct"), F.lit(" % of case cells have a population")), F.col("cells") - F.col("covered")))
    if covariates is not None:
        inside = cases.select(F.col(id_col).cast("string").alias("k")).distinct()
        rules.append(rule(covariates.select(F.col(id_col).cast("string").alias("k")).distinct().join(inside, "k", "left_anti"), "warning", "covariate_off_panel", "districts of covariates without cases", F.col("k")))
    if n_components is not None and n_components > 1:
        rules.append(fact(spark, "note", "adjacency_components", f"the graph has {n_components} components"))
    return findings(rules)


def check_model_inputs(*args, **named) -> DataFrame:
    """The report of ``model_findings``, which has the arguments."""
    return report(model_findings(*args, **named))


def simple_findings(data: DataFrame, population: DataFrame | None = None, id_col: str = "district", year_col: str = "year", count_col: str = "npafp_cases", pop_col: str = "population_u15") -> DataFrame:
    """``findings`` about the inputs of the simple index, in one table or two."""
    spark, rules = data.sparkSession, []
    people = data if population is None else population
    for name, df, cols in (("cases", data, (id_col, year_col, count_col)), ("pop", people, (id_col, year_col, pop_col))):
        if missing := [c for c in cols if c not in df.columns]:
            rules.append(fact(spark, "error", f"{name}_missing_cols", f"{name} lack {', '.join(missing)}"))
    if rules:
        return findings(rules)
    key, year, count, pop = F.col(id_col), F.col(year_col), F.col(count_col), F.col(pop_col)
    rules.append(told(data.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), "error", "cases_empty", "cases have no rows"))
    own = [("error", "cases_year", "years that are not whole numbers", year.isNull() | bad_count(year))]
    if _numeric(data, count_col):
        own += [("error", "cases_invalid_count", "counts that are not finite whole numbers", bad_count(count)), ("error", "cases_negative", "negative counts", count < 0), ("warning", "cases_missing_count", "missing counts, taken as zero", count.isNull())]
    else:
        rules.append(fact(spark, "error", "cases_count_type", "the count is not a number"))
    theirs = [] if population is None else [("error", "pop_year", "years that are not whole numbers", year.isNull() | bad_count(year))]
    if _numeric(people, pop_col):
        theirs += [("error", "pop_negative", "negative populations", pop < 0), ("warning", "pop_missing_or_zero", "missing populations or zero, left out", pop.isNull() | (pop == 0))]
    rules += [marked(data, key, own + theirs)] if population is None else [marked(data, key, own), marked(people, key, theirs)]
    rules.append(rule(duplicates(data, id_col, year_col), "error", "cases_duplicates", "more than one row for a district and year", key))
    if population is not None:
        rules.append(rule(duplicates(people, id_col, year_col), "error", "pop_duplicates", "more than one population for a district and year", key))
    if not _numeric(people, pop_col):
        rules.append(fact(spark, "error", "pop_type", "the population is not a number"))
        return findings(rules)
    usable = people.filter(pop > 0).select(key.cast("string").alias("district"), year.cast("int").alias("year"), pop.cast("double").alias("pop"))
    cells = data.select(key.cast("string").alias("district"), year.cast("int").alias("year")).distinct()
    if population is None:
        rules.append(rule(panel_gaps(usable, "district", "year"), "warning", "panel_gaps", "districts and years without a row", F.col("district")))
    else:
        rules += [rule(cells.join(usable, ["district", "year"], "left_anti"), "warning", "cases_no_population", "case rows without a population, left out", F.col("district")), rule(usable.join(cells, ["district", "year"], "left_anti"), "note", "zero_filled", "population rows without cases, counted as zero", F.col("district"))]
    annual = usable.withColumn("observed", F.lit(0.0))
    last = targets(annual).select(F.col("last").alias("first"), "last")
    qc = population_qc(annual.dropDuplicates(["district", "year"]), last)
    unusual = (("check_spike", "populations that jump and fall back"), ("check_change", "unusual population changes"), ("check_history", "districts with fewer years than the data"))
    rules.append(marked(qc, F.col("district"), [("warning", f"pop_{status}", what, F.col("population_qc") == status) for status, what in unusual]))
    n = usable.agg(F.count_distinct("year").alias("n"))
    rules.append(told(n.filter("n < 2"), "error", "too_few_years", "fewer than two years", F.col("n")))
    rules.append(told(n.filter("n between 2 and 3"), "warning", "few_years", "fewer than four years", F.col("n")))
    return findings(rules)


def check_simple_inputs(*args, **named) -> DataFrame:
    """The report of ``simple_findings``, which has the arguments."""
    return report(simple_findings(*args, **named))


def attach_labels(df: DataFrame, labels: DataFrame, id_col: str = "district") -> DataFrame:
    """``df`` with the admin names of ``labels`` that it lacks, in front of its id."""
    names = [c for c in ("adm0_name", "adm1_name", "adm2_name") if c in labels.columns and c not in df.columns]
    joined = df.join(F.broadcast(labels.select(id_col, *names).dropDuplicates([id_col])), id_col, "left") if labels.limit(100_001).count() <= 100_000 else df.join(labels.select(id_col, *names).dropDuplicates([id_col]), id_col, "left")
    at = df.columns.index(id_col)
    return joined.select(*df.columns[:at], *names, *df.columns[at:])


def validate_population(cases: DataFrame, population: DataFrame, id_col: str = "district") -> float:
    """Coverage in per cent; raises below ``COVERAGE_ABORT``."""
    pct = coverage(cases, population, id_col).first().pct
    if pct is None or pct < COVERAGE_ABORT:
        raise ValueError(f"{pct} % of case cells have a population; {COVERAGE_ABORT} % are needed")
    return pct
