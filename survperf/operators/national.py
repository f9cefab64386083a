"""The national ratio of observed to expected counts, and centring on it draw by draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.functions.expr import QUANTILES, array_quantile, finite, median, percentiles, safe_div, strict_sum
from survperf.functions.session import cut

LEVELS = ("month", "quarter", "year", "total")
MIN_EXPECTED = 1.0


def scored(observed: Column, expected: Column) -> Column:
    """Whether a row counts towards the national ratio."""
    return F.coalesce(finite(observed.cast("double")).isNotNull() & (finite(expected) > 0), F.lit(False))


def national_ratio(df: DataFrame, by: list[str], observed: str = "observed", expected: str = "expected", district: str = "district") -> DataFrame:
    """(by, national_observed, national_expected, national_oe, districts) over the rows that count; ``by`` may be empty."""
    rows = df.filter(scored(F.col(observed), F.col(expected)))
    sums = rows.groupBy(*by).agg(F.sum(observed).alias("national_observed"), F.sum(expected).alias("national_expected"), F.count_distinct(district).alias("districts"))
    return sums.withColumn("national_oe", safe_div(F.col("national_observed"), F.col("national_expected")))


def cells(draws: DataFrame, period: Column, unit: str = "district") -> DataFrame:
    """(unit, period, draw, expected): expected counts of each draw, summed over the months of a period."""
    return draws.groupBy(F.col(unit).alias("unit"), period.alias("period"), "draw").agg(F.sum("expected").alias("expected"))


def observed_of(panel: DataFrame, period: Column, unit: str = "district", pop: str = "avg", missing_zero: bool = True) -> DataFrame:
    """(unit, period, observed, pop, n_months): counts are summed once for each month, never for each draw.

    A missing count is zero if ``missing_zero``; otherwise it makes the sum missing.
    """
    count = F.coalesce("count", F.lit(0)) if missing_zero else F.col("count")
    people = F.avg("pop") if pop == "avg" else F.sum("pop")
    return panel.groupBy(F.col(unit).alias("unit"), period.alias("period")).agg(strict_sum(count).alias("observed"), people.alias("pop"), F.count_distinct("month").alias("n_months"))


def packed(cell_draws: DataFrame) -> DataFrame:
    """(unit, period, draws): one row for each cell, its draws as an array of (draw, expected) in draw order."""
    return cell_draws.groupBy("unit", "period").agg(F.sort_array(F.collect_list(F.struct("draw", "expected"))).alias("draws"))


def summarise(cell_draws: DataFrame, observed: DataFrame, centre: bool = True) -> tuple[DataFrame, DataFrame]:
    """Index of each (unit, period) and the national figures of each period.

    Within a draw the index is (observed / expected) over the same ratio of all units that
    count; its quantiles are taken last, so what all units share within a draw cancels. A cell's
    draws are one array, as long as there are draws: after packing them, only the national sum of each
    draw is shuffled, and all quantiles are taken inside rows. The packed cells are made once, since the
    national sums and the rows both read them.
    """
    values = F.array_sort(F.col("draws.expected"))
    base = observed.join(packed(cell_draws), ["unit", "period"], "left").withColumn("expected_total", array_quantile(values, 0.5))
    base = cut(base.withColumn("ok", scored(F.col("observed"), F.col("expected_total"))))
    counted = base.filter("ok")
    nat_draws = counted.select("period", F.explode("draws").alias("d")).groupBy("period", "d.draw").agg(F.sum("d.expected").alias("e"))
    nat_arrays = nat_draws.groupBy("period").agg(F.sort_array(F.collect_list(F.struct("draw", "e"))).alias("nat"))
    seen = counted.groupBy("period").agg(F.sum("observed").alias("national_observed"), F.count_distinct("unit").alias("districts"))
    nat = seen.join(nat_arrays, "period").withColumn("national_expected", array_quantile(F.array_sort(F.col("nat.e")), 0.5))
    nat = nat.withColumn("national_oe", safe_div(F.col("national_observed"), F.col("national_expected")))
    joined = base.join(F.broadcast(nat.select("period", "nat", "national_observed", "national_oe")), "period", "left")
    if centre:
        same = F.col("draws.draw") == F.col("nat.draw")
        ratios = F.zip_with("draws", "nat", lambda d, n: safe_div(F.col("observed") * n["e"], d["expected"] * F.col("national_observed")))
        ratios = F.when(F.col("nat").isNull(), None).when(same, ratios).otherwise(F.raise_error(F.lit("districts of a period have different draws")).cast("array<double>"))
    else:
        ratios = F.transform("draws", lambda d: safe_div(F.col("observed"), d["expected"]))
    rows = joined.withColumn("spi", F.array_sort(F.filter(ratios, lambda x: finite(x).isNotNull())))
    names = ("spi_q05", "spi_q10", "spi_median", "spi_q90", "spi_q95")
    mean = F.when(F.size("spi") > 0, F.aggregate("spi", F.lit(0.0), lambda acc, x: acc + x) / F.size("spi"))
    out = rows.select("unit", "period", "observed", "pop", "n_months", "expected_total", *[array_quantile(F.col("spi"), q).alias(n) for q, n in zip(QUANTILES, names, strict=True)], mean.alias("spi_mean"), "national_oe")
    return out, nat.select("period", "national_observed", "districts", "national_expected", "national_oe")


def low_information(summary: DataFrame, min_expected: float = MIN_EXPECTED) -> DataFrame:
    """Rows whose expected count is too small to read."""
    return summary.filter(F.col("expected_total") < min_expected)


def totals(cell_draws: DataFrame, observed: DataFrame) -> DataFrame:
    """One row: observed, the median over draws of the expected total, and the numbers of units and cells."""
    per_draw = cell_draws.groupBy("draw").agg(F.sum("expected").alias("e"), F.count_distinct("unit").alias("n_units"), F.count(F.lit(1)).alias("n_cells"))
    drawn = per_draw.agg(median(F.col("e")).alias("expected"), F.max("n_units").alias("n_units"), F.max("n_cells").alias("n_cells"))
    seen = observed.agg(F.sum("observed").alias("observed"))
    return seen.join(F.broadcast(drawn), F.lit(True)).select("observed", F.round("expected", 1).alias("expected"), "n_units", "n_cells")


def diagnostics(summary: DataFrame) -> DataFrame:
    """One row of figures by which an index is judged."""
    s, width = F.col("spi_median"), F.col("spi_q95").isNotNull()
    logs = F.when(s > 0, F.log("spi_median"))
    sums = summary.select("*", logs.alias("lg")).agg(
        F.count(s).alias("n"), F.sum("observed").alias("observed"), F.sum("expected_total").alias("expected"), percentiles(s, (0.05, 0.25, 0.5, 0.75, 0.95)).alias("q"),
        F.avg((s < 0.5).cast("double")).alias("below_half"), F.avg((s > 1.5).cast("double")).alias("above_1_5"), F.avg(F.when(width, ((F.col("spi_q95") < 1) | (F.col("spi_q05") > 1)).cast("double"))).alias("excludes_1"),
        F.sum((s < 0.5).cast("long")).alias("band_low"), F.sum(((s >= 0.5) & (s < 0.8)).cast("long")).alias("band_mid"), F.sum(((s >= 0.8) & (s <= 1.2)).cast("long")).alias("band_near"), F.sum((s > 1.2).cast("long")).alias("band_high"),
        F.count("lg").alias("k"), F.avg("lg").alias("m1"), F.avg(F.col("lg") ** 2).alias("m2"), F.avg(F.col("lg") ** 3).alias("m3"),
    )
    var = F.col("m2") - F.col("m1") ** 2
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.col("m1") ** 3
    skew = safe_div(third, F.pow(var * F.col("k") / (F.col("k") - 1), F.lit(1.5)))
    return sums.select(
        "n", "observed", "expected", safe_div(F.col("observed"), F.col("expected")).alias("calibration"), *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))],
        (100 * F.col("below_half")).alias("pct_below_half"), (100 * F.col("above_1_5")).alias("pct_above_1_5"), (100 * F.col("excludes_1")).alias("pct_excludes_1"), "band_low", "band_mid", "band_near", "band_high", skew.alias("log_skewness"),
    )
