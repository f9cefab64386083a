"""From case line lists and population tables to complete panels."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from survperf.functions.expr import isin_false, month_of

#: Classes whose upper-case names match are polio, not counted.
POLIO_PATTERN = "WPV|VDPV|COMPATIBLE"
PANEL_START, LAG_MONTHS, WINDOW_MONTHS = 2016, 1, 12


@dataclass(frozen=True)
class ColumnMap:
    """Columns of a case line list; any of them can be renamed."""

    district: str = "adm2_guid"
    parent: str = "adm1_guid"
    classification: str = "classification_all"
    surveillance: str = "surveillance_type_name"
    onset: str = "paralysis_onset_date"
    case_date: str = "case_date"
    stool1: str = "stool1collection_date"
    adequacy: str = "adequate_stool_with_condition"

    @classmethod
    def of(cls, renamed: dict[str, str] | None) -> ColumnMap:
        known = {f.name for f in fields(cls)}
        if unknown := set(renamed or {}) - known:
            raise ValueError(f"unknown columns {sorted(unknown)}; known are {sorted(known)}")
        return cls(**(renamed or {}))


def need_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def need_count(name: str, value: int, least: int = 0) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")


def _floor(d: date) -> date:
    return d.replace(day=1)


def _shift(d: date, months: int) -> date:
    years, month = divmod(d.year * 12 + d.month - 1 + months, 12)
    return date(years, month + 1, 1)


def last_month(as_of: date, lag_months: int = LAG_MONTHS) -> date:
    """The last closed month at ``as_of``."""
    need_count("lag_months", lag_months)
    return _shift(_floor(as_of), -lag_months)


def window(as_of: date, window_months: int = WINDOW_MONTHS, lag_months: int = LAG_MONTHS) -> list[date]:
    """The last ``window_months`` closed months."""
    need_count("window_months", window_months, 1)
    last = last_month(as_of, lag_months)
    return [_shift(last, k - window_months + 1) for k in range(window_months)]


def panel_months(as_of: date, start_year: int = PANEL_START, lag_months: int = LAG_MONTHS) -> list[date]:
    """January of ``start_year`` to the last closed month."""
    first, last = date(start_year, 1, 1), last_month(as_of, lag_months)
    if first > last:
        raise ValueError(f"the panel would start in {first:%Y-%m}, after its last month {last:%Y-%m}")
    return [_shift(first, k) for k in range((last.year - first.year) * 12 + last.month)]


def window_of(as_of: Column, window_months: int = WINDOW_MONTHS, lag_months: int = LAG_MONTHS) -> Column:
    """``window`` of each row's date, as an array of months; null for a null date."""
    need_count("lag_months", lag_months)
    need_count("window_months", window_months, 1)
    last = F.add_months(F.trunc(as_of, "MM"), -lag_months)
    return F.sequence(F.add_months(last, 1 - window_months), last, F.expr("interval 1 month"))


def panel_months_of(as_of: Column, start_year: int = PANEL_START, lag_months: int = LAG_MONTHS) -> Column:
    """``panel_months`` of each row's date, as an array of months; empty where the panel would start after its last month."""
    need_count("lag_months", lag_months)
    first, last = F.make_date(F.lit(start_year), F.lit(1), F.lit(1)), F.add_months(F.trunc(as_of, "MM"), -lag_months)
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).when(last.isNotNull(), F.array().cast("array<date>"))


def months_frame(spark: SparkSession, months: list[date]) -> DataFrame:
    """(month): the months as rows, made by Spark."""
    return spark.createDataFrame([(m,) for m in months], "month date").distinct()


def case_date(columns: ColumnMap = ColumnMap()) -> Column:
    """Date of a case: onset, else case date, else first stool."""
    return F.coalesce(*[F.to_date(F.col(c)) for c in (columns.onset, columns.case_date, columns.stool1)])


def case_records(cases: DataFrame, columns: ColumnMap = ColumnMap(), polio_pattern: str = POLIO_PATTERN, surveillance_types: tuple[str, ...] = ("AFP",), unit: str = "district") -> DataFrame:
    """(unit, polio, month, adequacy?) of dated cases that have a district and a wanted surveillance type.

    ``unit`` is "district" or "parent"; a case without a district is left out for either.
    """
    names = [columns.district, columns.classification, columns.surveillance, columns.onset, columns.case_date, columns.stool1]
    need_columns(cases, *names)
    kept = cases.filter(F.col(columns.district).isNotNull() & isin_false(F.col(columns.surveillance), surveillance_types))
    polio = F.coalesce(F.upper(columns.classification).rlike(polio_pattern), F.lit(False))
    more = [F.col(columns.adequacy).alias("adequacy")] if columns.adequacy in cases.columns else []
    return kept.select(F.col(getattr(columns, unit)).cast("string").alias("unit"), polio.alias("polio"), month_of(case_date(columns)).alias("month"), *more).filter("month is not null")


def case_panel(cases: DataFrame, districts: DataFrame, months: DataFrame, columns: ColumnMap = ColumnMap(), polio_pattern: str = POLIO_PATTERN, surveillance_types: tuple[str, ...] = ("AFP",)) -> DataFrame:
    """(district, month, count): non-polio cases of every district and month, zero where there are none.

    ``districts`` has a column district and ``months`` a column month; counts are made before the
    grid is joined, so only one row for each occupied cell is shuffled.
    """
    records = case_records(cases, columns, polio_pattern, surveillance_types).filter("not polio")
    counts = records.groupBy(F.col("unit").alias("district"), "month").agg(F.count(F.lit(1)).cast("int").alias("count"))
    places, times = districts.select(F.col("district").cast("string").alias("district")).distinct(), months.select("month").distinct()
    grid = places.join(F.broadcast(times.groupBy().agg(F.array_sort(F.collect_set("month")).alias("m"))), F.lit(True)).select("district", F.explode("m").alias("month"))
    return grid.join(counts, ["district", "month"], "left").select("district", "month", F.coalesce("count", F.lit(0)).alias("count"))


def pop_observed(population: DataFrame, districts: DataFrame | None = None, years: list[int] | None = None, id_col: str = "adm2_guid", year_col: str = "year", pop_col: str = "u15_pop") -> DataFrame:
    """(district, year, pop): positive populations, summed over duplicates, of the wanted districts and years."""
    need_columns(population, id_col, year_col, pop_col)
    rows = population.select(F.col(id_col).cast("string").alias("district"), F.col(year_col).cast("int").alias("year"), F.col(pop_col).cast("double").alias("pop")).filter("pop > 0 and district is not null")
    if years is not None:
        rows = rows.filter(F.col("year").isin(*sorted(set(years))))
    if districts is not None:
        rows = rows.join(districts.select(F.col("district").cast("string").alias("district")).distinct(), "district", "left_semi")
    return rows.groupBy("district", "year").agg(F.sum("pop").alias("pop"))


def pop_index(observed: DataFrame, n_years: int | None = None) -> DataFrame:
    """(year, total): population of the districts that have every year."""
    if n_years is None:
        wanted = observed.agg(F.count_distinct("year").alias("wanted"))
        complete = observed.groupBy("district").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(wanted), F.col("n") == F.col("wanted"))
    else:
        complete = observed.groupBy("district").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n_years)
    return observed.join(complete.select("district"), "district", "left_semi").groupBy("year").agg(F.sum("pop").alias("total"))


def pop_panel(observed: DataFrame, districts: DataFrame, years: DataFrame) -> DataFrame:
    """(district, year, pop, carried): gaps filled from the district's first year by the index of complete districts.

    Without an index for either year the first population is carried unchanged; a district
    without any population stays null.
    """
    index = pop_index(observed)
    base = observed.groupBy("district").agg(F.min("year").alias("base_year"), F.min_by("pop", "year").alias("base_pop"))
    span = F.broadcast(years.select("year").distinct().groupBy().agg(F.array_sort(F.collect_set("year")).alias("y")))
    grid = districts.select("district").distinct().join(span, F.lit(True)).select("district", F.explode("y").alias("year"))
    full = grid.join(observed, ["district", "year"], "left").join(base, "district", "left").join(F.broadcast(index), "year", "left")
    full = full.join(F.broadcast(index.select(F.col("year").alias("base_year"), F.col("total").alias("base_total"))), "base_year", "left")
    scaled = F.try_divide(F.col("base_pop") * F.col("total"), F.col("base_total"))
    return full.select("district", "year", F.coalesce("pop", scaled, "base_pop").alias("pop"), F.col("pop").isNull().alias("carried"))


def stool_adequacy(records: DataFrame, months: list[date], adequate_values: tuple[str, ...] = ("Yes",)) -> DataFrame:
    """(unit, n_stool, n_adequate, pct_adequate) over the window's cases with a recorded adequacy."""
    inside = records.filter(F.col("month").isin(*months) & (F.trim("adequacy") != ""))
    good = isin_false(F.col("adequacy"), adequate_values).cast("long")
    counted = inside.groupBy("unit").agg(F.count(F.lit(1)).alias("n_stool"), F.sum(good).alias("n_adequate"))
    return counted.withColumn("pct_adequate", 100.0 * F.col("n_adequate") / F.col("n_stool"))


def seasonal_features(month: Column) -> dict[str, Column]:
    """Two harmonics of the calendar month."""
    m = F.month(month)
    return {f"{name}{12 // k}": f(F.lit(2 * 3.141592653589793 * k) * m / 12) for k in (1, 2) for name, f in (("sin", F.sin), ("cos", F.cos))}


def running(partition: str, order: str) -> Window:
    """All rows of ``partition`` before the current one in ``order``."""
    return Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
