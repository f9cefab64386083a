"""Printed summaries of results, each made from one small aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survperf.operators import compare, graph, guide, national, simple

#: Bands in which a figure passes.
CALIBRATION, P_EFF, CPO, PIT = 0.1, 0.2, 0.5, 0.3


def _num(x: float | None, digits: int = 3) -> str:
    return "-" if x is None else f"{x:.{digits}g}"


def _flag(ok: bool | None) -> str:
    return "-" if ok is None else "pass" if ok else "check"


def index_text(summary: DataFrame) -> str:
    """Quantiles, bands and diagnostics of an index."""
    d = national.diagnostics(summary).first()
    near = d.calibration is not None and abs(d.calibration - 1) < CALIBRATION
    return "\n".join([
        f"{d.n} values; observed {d.observed}, expected {_num(d.expected, 6)}",
        "quantiles 5/25/50/75/95 %: " + ", ".join(_num(v) for v in (d.q05, d.q25, d.q50, d.q75, d.q95)),
        f"below 0.5: {d.band_low}, 0.5 to 0.8: {d.band_mid}, 0.8 to 1.2: {d.band_near}, above 1.2: {d.band_high}",
        f"observed / expected {_num(d.calibration)} [{_flag(near)}]; interval excludes 1 in {_num(d.pct_excludes_1)} %; log skewness {_num(d.log_skewness)}",
    ])


def fit_text(criteria: DataFrame) -> str:
    """Criteria of fitted likelihoods with what passes, and the recommended one."""
    lines = []
    for r in criteria.orderBy("target", "spec").collect():  # one row for each fit
        share = r.p_eff / r.n_obs if r.n_obs else None
        lines.append(
            f"{r.target} {r.spec}: DIC {_num(r.dic, 6)}, WAIC {_num(r.waic, 6)}, p_eff / n {_num(share)} [{_flag(share is not None and share < P_EFF)}], CPO {_num(r.cpo_valid)} [{_flag(r.cpo_valid > CPO)}], PIT {_num(r.pit_ks)} [{_flag(None if r.pit_ks is None else r.pit_ks < PIT)}]"
            + (f"; excluded: {r.excluded}" if "excluded" in r and r.excluded else "") + (" (recommended)" if "recommended" in r and r.recommended == r.spec else "")
        )
    return "\n".join(lines)


def simple_text(summary: DataFrame) -> str:
    """Each assessed year's districts below 1, 0.8 and 0.6."""
    rows = simple.by_year(summary).orderBy("year").collect()  # one row for each year
    return "\n".join(f"{r.year}: {r.available} of {r.districts} districts, median {_num(r.median_spi)}; below 1: {r.below_1}, 0.8: {r.below_0_8}, 0.6: {r.below_0_6}" for r in rows)


def comparison_text(district_year: DataFrame) -> str:
    """Categories and agreement."""
    m = compare.metrics(district_year).first()
    lines = [f"{r.category}: {r.n} ({_num(r.pct)} %)" for r in compare.counts_by_category(district_year).orderBy("ord").collect()]
    return "\n".join([*lines, f"agreement {_num(m.pct_agreement)} %, kappa {_num(m.cohens_kappa)}, McNemar p {_num(m.mcnemar_p)}"])


def guide_text(focal: DataFrame, top: int = 10) -> str:
    """Labels, concerns among districts below the cut, and the first districts to review."""
    lines = [f"{r.verdict}: {r.n} ({_num(r.pct)} %)" for r in guide.verdict_counts(focal).orderBy("verdict_order").collect()]
    c = guide.concern_counts(focal).first()
    first = focal.filter(F.col("verdict") == guide.VERDICTS[0]).orderBy(F.col("spi_median").asc_nulls_last(), "district").limit(top).collect()
    lines.append(f"of {c.n_below} below the cut: timeliness {c.timeliness}, extent {c.extent}, persistence {c.persistence}, adequacy {c.adequacy}")
    return "\n".join([*lines, *[f"  {r.district} {_num(r.spi_median)}" for r in first]])


def checks_text(issues: DataFrame) -> str:
    """Findings, errors first."""
    rows = issues.withColumn("ids", F.slice("ids", 1, 5)).orderBy("severity_order", "rule").collect()  # one row for each rule
    return "\n".join(f"{r.severity}: {r.message}" + (f" ({r.n}): {', '.join(r.ids[:5])}" if r.n else "") for r in rows) or "no issues"


def graph_text(nodes: DataFrame, edges: DataFrame) -> str:
    g = graph.graph_summary(nodes, edges).first()
    n = graph.components(nodes, edges).select("component").distinct().count()
    return f"{g.regions} regions, {g.links} links ({_num(g.pct_nonzero)} %), {_num(g.mean_links)} on average, {n} components, {g.islands} without links"
