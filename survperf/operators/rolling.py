"""Rolling-window index, classification and the end-to-end rolling table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survperf.functions.expr import safe_div
from survperf.operators import national

RATE_TARGET, INDEX_THRESHOLD, RATE_MULTIPLIER = 3.0, 0.8, 1e5
AGREEMENT = ("both_pass", "both_flag", "spi_only", "rate_only")
FOCUS = ("focus", "other")


def window_summary(panel: DataFrame, draws: DataFrame, window: list[date], parents: DataFrame | None = None, person_time: str = "window") -> DataFrame:
    """(unit, observed, pop, months, expected_total, spi_*, national_oe) over the months of ``window``.

    ``panel`` is (district, month, count, pop), ``draws`` (district, month, draw, expected). With
    ``parents`` (district, parent) the roll-up happens inside each draw; a district without a parent
    belongs to the unit null. Person-time divides summed populations by the window's months, or
    by those observed.
    """
    inside = panel.filter(F.col("month").isin(*window))
    drawn = draws.filter(F.col("month").isin(*window))
    if parents is not None:
        small = parents.select("district", F.col("parent").alias("unit"))
        inside, drawn = (x.join(small, "district", "left") for x in (inside, drawn))
    else:
        inside, drawn = (x.withColumn("unit", F.col("district")) for x in (inside, drawn))
    # nulls of unit are a unit: a marker stands for them inside joins
    mark = lambda x: x.withColumn("unit", F.coalesce("unit", F.lit("\0")))
    inside, drawn = mark(inside), mark(drawn)
    every = F.lit("window")
    observed = national.observed_of(inside, every, "unit", pop="sum", missing_zero=False)
    summary, _ = national.summarise(national.cells(drawn, every, "unit"), observed)
    over = F.lit(len(window)) if person_time == "window" else F.col("n_months")
    out = summary.withColumn("pop", F.col("pop") / over).drop("period").withColumnRenamed("n_months", "months")
    return out.withColumn("unit", F.nullif("unit", F.lit("\0")))


def classify(summary: DataFrame, rate_target: float = RATE_TARGET, index_threshold: float = INDEX_THRESHOLD, min_expected: float = national.MIN_EXPECTED, rate_multiplier: float = RATE_MULTIPLIER, annualise: bool = False, months_per_year: int = 12, agreement: tuple[str, ...] = AGREEMENT, focus: tuple[str, ...] = FOCUS) -> DataFrame:
    """``summary`` with rate, readable, rate_pass, index_pass, agreement and focus_status.

    A row is readable with an expected count of at least ``min_expected`` and an index; the index fails if it
    is below the threshold and its interval lies below 1. Unreadable rows have no agreement.
    """
    years = F.lit(months_per_year) / F.col("months") if annualise else F.lit(1.0)
    rate = safe_div(F.col("observed") * years, F.col("pop")) * rate_multiplier
    rows = summary.withColumn("rate", rate)
    readable = F.coalesce(F.col("expected_total") >= min_expected, F.lit(False)) & F.col("spi_median").isNotNull()
    rows = rows.withColumns({"readable": readable, "rate_pass": F.col("rate") >= rate_target, "index_pass": ~((F.col("spi_median") < index_threshold) & (F.col("spi_q95") < 1))})
    ok, a, b = F.col("readable"), F.col("rate_pass"), F.col("index_pass")
    verdict = F.when(ok & a & b, agreement[0]).when(ok & ~a & ~b, agreement[1]).when(ok & a & ~b, agreement[2]).when(ok & ~a & b, agreement[3])
    rows = rows.withColumn("agreement", verdict)
    return rows.withColumn("focus_status", F.when(F.col("agreement") == agreement[2], focus[0]).when(F.col("agreement").isNotNull(), focus[1]))


def rolling_table(classified: DataFrame, adequacy: DataFrame) -> DataFrame:
    """``classified`` with stool adequacy (unit, n_stool, n_adequate, pct_adequate)."""
    stool = adequacy.withColumnRenamed("unit", "_unit")
    return classified.join(stool, F.col("unit").eqNullSafe(F.col("_unit")), "left").drop("_unit")
