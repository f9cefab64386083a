"""The index against the conventional rate target: categories and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.functions.expr import finite, mcnemar_p, safe_div

NPAFP_TARGET, NPAFP_MULTIPLIER, SPI_THRESHOLD = 3.0, 100_000.0, 1.0
#: Categories in display order.
CATEGORIES = ("Neither below", "SPI below threshold only", "NPAFP below target only", "Both below")
#: Breaks of the maps' classes.
NPAFP_BREAKS = (1.0, 2.0, 3.0, 6.0, 12.0, 24.0)
SPI_BREAKS = (0.5, 0.75, 1.0, 1.33, 2.0)


def compare(index: DataFrame, spi_threshold: float = SPI_THRESHOLD, spi_rule: str = "median", npafp_target: float = NPAFP_TARGET, npafp_multiplier: float = NPAFP_MULTIPLIER, simple: bool = False) -> DataFrame:
    """``index`` (district, year, observed, pop, expected_total, spi_median, spi_q05, spi_q95, ...) with its category.

    The interval rule also asks that the interval lie below 1; the simple index has no interval.
    """
    if spi_rule not in ("median", "interval"):
        raise ValueError("spi_rule is 'median' or 'interval'")
    if simple and spi_rule == "interval":
        raise ValueError("the simple index has no interval")
    below = F.col("spi_median") < spi_threshold
    if spi_rule == "interval":
        below = below & (F.col("spi_q95") < 1)
    rows = index.withColumn("npafp_rate", safe_div(F.col("observed"), F.col("pop")) * npafp_multiplier)
    rows = rows.withColumns({"npafp_adequate": F.col("npafp_rate") >= npafp_target, "spi_below_threshold": below}).withColumn("spi_pass", ~F.col("spi_below_threshold"))
    a, b = F.col("npafp_adequate"), F.col("spi_below_threshold")
    names = dict(zip(((True, False), (True, True), (False, False), (False, True)), CATEGORIES, strict=True))
    category = None
    for (x, y), name in names.items():
        hit = (a if x else ~a) & (b if y else ~b)
        category = F.when(hit, name) if category is None else category.when(hit, name)
    return rows.withColumn("category", category)


def from_simple(summary: DataFrame) -> DataFrame:
    """The simple index in the columns that ``compare`` reads, rows without an index left out."""
    rows = summary.filter(finite(F.col("spi")).isNotNull())
    none = F.lit(None).cast("double")
    return rows.select("district", "year", "observed", "pop", F.col("expected").alias("expected_total"), F.col("spi").alias("spi_median"), none.alias("spi_q05"), none.alias("spi_q95"))


def counts_by_category(rows: DataFrame) -> DataFrame:
    """(category, n, pct) of every category, zeros included."""
    levels = rows.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "ord int, category string")
    counted = rows.filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count("category").alias("total"))
    full = F.broadcast(levels).join(counted, "category", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return full.select("ord", "category", n.cast("long").alias("n"), safe_div(100.0 * n, F.col("total")).alias("pct"))


def _cell(adequate: bool, below: bool) -> Column:
    a, b = F.col("npafp_adequate"), F.col("spi_below_threshold")
    return F.sum(((a if adequate else ~a) & (b if below else ~b)).cast("long"))


def metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, pct_agreement, cohens_kappa, mcnemar_p and the four cells, overall or by strata."""
    kept = rows.filter("category is not null")
    cells = kept.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(_cell(True, False), F.lit(0)).alias("n_neither"), F.coalesce(_cell(True, True), F.lit(0)).alias("n_spi_only"),
        F.coalesce(_cell(False, False), F.lit(0)).alias("n_npafp_only"), F.coalesce(_cell(False, True), F.lit(0)).alias("n_both"),
    )
    n, a, b, c, d = (F.col(x) for x in ("n", "n_neither", "n_spi_only", "n_npafp_only", "n_both"))
    po = safe_div((a + d).cast("double"), n)
    pe = safe_div(((a + b) * (a + c) + (c + d) * (b + d)).cast("double"), n * n)
    kappa = F.when(F.abs(1 - pe) > 1e-12, (po - pe) / (1 - pe))
    return cells.select(*(by or []), "n", (100 * po).alias("pct_agreement"), kappa.alias("cohens_kappa"), mcnemar_p(F.col("n_spi_only"), F.col("n_npafp_only")).alias("mcnemar_p"), "n_neither", "n_spi_only", "n_npafp_only", "n_both")


def crosstab(rows: DataFrame) -> DataFrame:
    """(npafp_adequate, spi_pass, n, row_pct, col_pct, total_pct): the 2 x 2 table, empty cells left out."""
    from pyspark.sql import Window

    cells = rows.filter("category is not null").groupBy("npafp_adequate", "spi_pass").agg(F.count(F.lit(1)).alias("n"))
    share = lambda *by: F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 1)
    return cells.select("npafp_adequate", "spi_pass", "n", share("npafp_adequate").alias("row_pct"), share("spi_pass").alias("col_pct"), share(F.lit(1)).alias("total_pct"))


def bins(x: Column, breaks: tuple[float, ...]) -> Column:
    """Index of the left-closed bin of ``x`` among ``breaks`` from minus to plus infinity; null for null."""
    out = F.when(x < breaks[0], 0)
    for i, b in enumerate(breaks[1:], 1):
        out = out.when(x < b, i)
    return out.when(x.isNotNull(), len(breaks))


def map_bins(rows: DataFrame, year: int | None = None) -> DataFrame:
    """(district, year, npafp_bin, spi_bin, category): what the three maps of a year show."""
    some = rows if year is None else rows.filter(F.col("year") == year)
    return some.select("district", "year", bins(F.col("npafp_rate"), NPAFP_BREAKS).alias("npafp_bin"), bins(F.col("spi_median"), SPI_BREAKS).alias("spi_bin"), "category")
