"""The simple annual index: each district against its own reporting history."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from survperf.functions.expr import finite, safe_div
from survperf.functions.session import cut
from survperf.operators.national import national_ratio
from survperf.operators.prepare import need_columns, running

MIN_HISTORY, PER = 3, 100_000
#: Far-out fences of population changes, in interquartile ranges, and the least change screened.
FENCE, LEAST_CHANGE, LEAST_FENCED = 3.0, math.log(1.1), 4


@dataclass
class SimpleIndex:
    """``summary`` by district and year, ``national`` by year, ``population_qc`` by district."""

    summary: DataFrame
    national: DataFrame
    population_qc: DataFrame


def simple_annual(data: DataFrame, population: DataFrame | None = None, id_col: str = "district", year_col: str = "year", count_col: str = "npafp_cases", pop_col: str = "population_u15") -> DataFrame:
    """(district, year, observed, pop): rows with a population; a missing count of such a row is zero.

    With a second table its rows drive the result, so that years without any case keep a row.
    Duplicate keys are an error of the caller's data; ``checks`` reports them.
    """
    need_columns(data, id_col, year_col, count_col)
    people = data if population is None else population
    need_columns(people, id_col, year_col, pop_col)
    key = lambda: [F.col(id_col).cast("string").alias("district"), F.col(year_col).cast("int").alias("year")]
    pop = people.select(*key(), F.col(pop_col).cast("double").alias("pop"), *([F.col(count_col).alias("observed")] if population is None else [])).filter("pop > 0")
    if population is not None:
        counts = data.select(*key(), F.col(count_col).alias("observed"))
        pop = pop.join(counts, ["district", "year"], "left")
    return pop.select("district", "year", F.coalesce(F.col("observed").cast("double"), F.lit(0.0)).alias("observed"), "pop")


def with_expected(annual: DataFrame) -> DataFrame:
    """``annual`` with each row's own history before its year and the count expected from it.

    One prefix window gives all target years at once; filter targets after it, not before.
    """
    before = running("district", "year")
    hist = annual.select(
        "*", F.count(F.lit(1)).over(before).cast("int").alias("history_years"),
        F.coalesce(F.sum("observed").over(before), F.lit(0.0)).alias("history_cases"), F.coalesce(F.sum("pop").over(before), F.lit(0.0)).alias("history_pop"),
    )
    check = F.when(F.col("history_years") == 0, "no previous year").when(F.col("history_cases") == 0, "no previous case").otherwise("ok")
    known = F.col("history_years") > 0
    hist = hist.select(
        "*", check.alias("history_check"), safe_div(F.col("observed"), F.col("pop")).alias("npafp_rate"), F.when(known, safe_div(F.col("history_cases"), F.col("history_pop"))).alias("history_rate"),
        F.when(known, safe_div(F.col("pop") * F.col("history_cases"), F.col("history_pop"))).alias("expected"),
    )
    return hist.withColumn("oe", F.when(F.col("history_check") == "ok", safe_div(F.col("observed"), F.col("expected"))))


def targets(annual: DataFrame, first: int | None = None, last: int | None = None, min_history: int = MIN_HISTORY) -> DataFrame:
    """(first, last): the assessed years; by default those with ``min_history`` recorded years before."""
    bounds = annual.agg((F.min("year") + min_history).alias("first"), F.max("year").alias("last"))
    if first is not None:
        bounds = bounds.withColumn("first", F.lit(first))
    return bounds.withColumn("last", F.lit(last)) if last is not None else bounds


def simple_index(annual: DataFrame, first: int | None = None, last: int | None = None, min_history: int = MIN_HISTORY, per: float = PER) -> SimpleIndex:
    """The index of every district and assessed year, centred on the national ratio of that year.

    The annual table, a row for each district and year, is made once and read by all parts.
    """
    annual = cut(annual)
    bounds = targets(annual, first, last, min_history)
    rows = with_expected(annual).join(F.broadcast(bounds), F.col("year").between(F.col("first"), F.col("last"))).drop("first", "last")
    national = national_ratio(rows.filter("history_check = 'ok'"), ["year"])
    usable = F.when(F.col("national_oe") > 0, F.col("national_oe"))
    qc = population_qc(annual, bounds)
    summary = rows.join(F.broadcast(national.select("year", usable.alias("national_oe"))), "year", "left").join(qc.select("district", "year", "population_qc"), ["district", "year"], "left")
    summary = summary.select(
        "district", "year", "observed", "pop", (F.col("npafp_rate") * per).alias("npafp_rate"), "history_years", "history_cases", "history_pop", (F.col("history_rate") * per).alias("history_rate"), "history_check",
        "expected", "oe", "national_oe", safe_div(F.col("oe"), F.col("national_oe")).alias("spi"), "population_qc",
    )
    latest = qc.join(F.broadcast(bounds.select("last")), F.col("year") == F.col("last")).drop("last", "year")
    return SimpleIndex(summary, national, latest)


def population_changes(annual: DataFrame) -> DataFrame:
    """(district, year, slot, lc, dev, unusual): log change from the previous recorded year, against that year's median.

    A change across a gap in years is null but keeps its slot. Fences come from all changes.
    """
    order = Window.partitionBy("district").orderBy("year")
    steps = annual.select("district", "year", "pop", F.lag("pop").over(order).alias("p"), F.lag("year").over(order).alias("y"), F.row_number().over(order).alias("slot")).filter("y is not null")
    steps = steps.select("district", "year", "slot", F.when(F.col("year") - F.col("y") == 1, F.log(F.col("pop") / F.col("p"))).alias("lc"))
    medians = steps.groupBy("year").agg(F.percentile("lc", F.lit(0.5)).alias("mid"))
    dev = steps.join(F.broadcast(medians), "year").withColumn("dev", F.col("lc") - F.coalesce("mid", F.lit(0.0)))
    q = dev.agg(F.count("dev").alias("n"), F.percentile("dev", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.lit(FENCE) * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))
    low = F.when(F.col("n") >= LEAST_FENCED, F.least(F.get("q", F.lit(0)) - spread, F.lit(-LEAST_CHANGE))).otherwise(F.lit(-math.inf))
    high = F.when(F.col("n") >= LEAST_FENCED, F.greatest(F.get("q", F.lit(1)) + spread, F.lit(LEAST_CHANGE))).otherwise(F.lit(math.inf))
    fences = q.select(low.alias("low"), high.alias("high"))
    odd = F.coalesce((F.col("dev") < F.col("low")) | (F.col("dev") > F.col("high")), F.lit(False))
    return dev.join(F.broadcast(fences), F.lit(True)).select("district", "year", "slot", "lc", "dev", odd.alias("unusual"))


def population_qc(annual: DataFrame, bounds: DataFrame) -> DataFrame:
    """(district, year, population_qc, unusual_changes, largest_change, years) up to each assessed year.

    Assessed years are all recorded years between the bounds. A spike is an unusual change
    followed, within the next two recorded ones up to that year, by an unusual one of the other sign.
    """
    ahead = Window.partitionBy("district").orderBy("slot")
    steps = population_changes(annual)
    for k in (1, 2):
        steps = steps.withColumns({f"y{k}": F.lead("year", k).over(ahead), f"d{k}": F.lead("dev", k).over(ahead), f"u{k}": F.lead("unusual", k).over(ahead)})
    years = annual.select("year").distinct()
    wanted = years.join(F.broadcast(bounds), F.col("year").between(F.col("first"), F.col("last"))).select(F.col("year").alias("upto"))
    recorded = annual.join(F.broadcast(wanted), F.col("year") <= F.col("upto")).groupBy("district", "upto").agg(F.count(F.lit(1)).cast("int").alias("years"))
    dataset = years.join(F.broadcast(wanted), F.col("year") <= F.col("upto")).groupBy("upto").agg(F.count(F.lit(1)).alias("all_years"))
    up = steps.join(F.broadcast(wanted), F.col("year") <= F.col("upto"))

    def answers(k: int) -> Column:
        return F.coalesce((F.col(f"y{k}") <= F.col("upto")) & F.col(f"u{k}") & (F.signum(f"d{k}") != F.signum("dev")), F.lit(False))

    spike = F.col("unusual") & (answers(1) | answers(2))
    first_largest = F.max(F.when(F.col("lc").isNotNull(), F.struct(F.abs("lc").alias("size"), (-F.col("slot")).alias("s"), "lc")))
    seen = up.groupBy("district", "upto").agg(F.max(spike).alias("spike"), F.sum(F.col("unusual").cast("int")).cast("int").alias("unusual_changes"), first_largest.alias("top"))
    # a district without a record up to a year is screened with none
    grid = annual.select("district").distinct().join(F.broadcast(wanted.groupBy().agg(F.collect_set("upto").alias("t"))), F.lit(True)).select("district", F.explode("t").alias("upto"))
    full = grid.join(recorded, ["district", "upto"], "left").join(seen, ["district", "upto"], "left").join(F.broadcast(dataset), "upto")
    n = F.coalesce("years", F.lit(0))
    status = F.when(F.col("spike"), "check_spike").when(F.col("unusual_changes") > 0, "check_change").when(n < F.col("all_years"), "check_history").otherwise("ok")
    return full.select("district", F.col("upto").alias("year"), status.alias("population_qc"), F.coalesce("unusual_changes", F.lit(0)).alias("unusual_changes"), (F.exp("top.lc") - 1).alias("largest_change"), n.alias("years"))


def by_year(summary: DataFrame) -> DataFrame:
    """(year, districts, available, median, below_1, below_0_8, below_0_6)."""
    spi = finite(F.col("spi"))
    below = {f"below_{n}": F.sum(F.coalesce(spi < x, F.lit(False)).cast("long")) for n, x in (("1", 1.0), ("0_8", 0.8), ("0_6", 0.6))}
    return summary.groupBy("year").agg(F.count(F.lit(1)).alias("districts"), F.count(spi).alias("available"), F.percentile(spi, F.lit(0.5)).alias("median_spi"), *[v.alias(k) for k, v in below.items()])


def _number(x: Column, digits: int, missing: str = "NA") -> Column:
    text = F.regexp_replace(F.format_number(x, digits), ",", " ")
    return F.coalesce(text, F.lit(missing))


def explain(summary: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """(district, year, position, section, component, value): each row of the index in words.

    ``labels`` replaces section and component names and worded values, for another language.
    """
    words = labels or {}
    ok, available = F.col("history_check") == "ok", finite(F.col("spi")).isNotNull()
    none, uncounted = words.get("not available", "not available"), words.get("not calculated", "not calculated")
    reason = F.when(F.col("history_check") == "no previous case", words.get("no previous NPAFP case", "no previous NPAFP case")).when(F.col("history_check") == "no previous year", words.get("no previous year of data", "no previous year of data"))
    reason = reason.otherwise(words.get("national observed / expected is unavailable or zero", "national observed / expected is unavailable or zero"))
    # fixed values: sections and components, in display order
    lines = [
        ("Current reporting", "Observed NPAFP cases", _number(F.col("observed"), 0)),
        ("Current reporting", "Current population under 15", _number(F.col("pop"), 0)),
        ("Current reporting", "NPAFP rate", _number(F.col("npafp_rate"), 2)),
        ("Previous reporting", "Previous years", F.col("history_years").cast("string")),
        ("Previous reporting", "Previous NPAFP cases", _number(F.col("history_cases"), 0)),
        ("Previous reporting", "Previous child-years", _number(F.col("history_pop"), 0)),
        ("Previous reporting", "Previous rate", _number(F.col("history_rate"), 2, none)),
        ("Expected reporting", "Expected NPAFP cases", _number(F.col("expected"), 2, none)),
        ("SPI", "District observed / expected", F.when(ok, _number(F.col("oe"), 2)).otherwise(uncounted)),
        ("SPI", "National observed / expected", _number(F.col("national_oe"), 2)),
        ("SPI", "SPI", F.when(available, _number(F.col("spi"), 2)).otherwise(uncounted)),
        ("SPI", "Reason", F.when(~available, reason)),
        ("Data checks", "Population check", F.when(F.col("population_qc") == "ok", words.get("no flag", "no flag")).otherwise(F.col("population_qc"))),
    ]
    rows = [F.struct(F.lit(i).alias("position"), F.lit(words.get(s, s)).alias("section"), F.lit(words.get(c, c)).alias("component"), v.alias("value")) for i, (s, c, v) in enumerate(lines, 1)]
    return summary.select("district", "year", F.inline(F.array(*rows))).filter("value is not null")
