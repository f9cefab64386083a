"""Plot data as DataFrames, and tables, maps and one-page reports as text made from few rows."""

from __future__ import annotations

import html
import math
import os
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survperf.operators.compare import NPAFP_TARGET
from survperf.operators.guide import VERDICTS, scan_table, worked_examples
from survperf.operators.maps import locator_svg

HISTOGRAM_BINS, ENDS, MAX_ROWS, THIN = 50, 20, 50, 5
#: Colours of the review labels.
COLOURS = dict(zip(VERDICTS, ("#b2182b", "#ef8a62", "#67a9cf"), strict=True))


def histogram(summary: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, lower, upper, n) of log10 of the positive indices; empty bins are left out."""
    logs = summary.filter("spi_median > 0").select(F.log10("spi_median").alias("v"))
    ends = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("w") > 0, F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(bins - 1))).otherwise(0).cast("int")
    rows = logs.join(F.broadcast(ends), F.lit(True)).select(at.alias("bin"), "lo", "w")
    return rows.groupBy("bin").agg(F.min("lo").alias("lo"), F.min("w").alias("w"), F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"), "n")


def dropped_zeros(summary: DataFrame) -> DataFrame:
    """One row: how many indices are zero and so not on a log scale."""
    return summary.agg(F.coalesce(F.sum((F.col("spi_median") == 0).cast("long")), F.lit(0)).alias("n_zero"))


def funnel(comparison: DataFrame, seed: int = 1) -> DataFrame:
    """(district, year, expected_total, expected_jittered, spi_median, npafp_adequate): jitter hashed from the key."""
    key = F.concat_ws("|", F.lit(seed).cast("string"), "district", F.col("year").cast("string"))
    unit = F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("long") / float(1 << 24) - 0.5
    return comparison.filter("expected_total > 0").select("district", "year", "expected_total", (F.col("expected_total") * (1 + 0.1 * unit)).alias("expected_jittered"), "spi_median", "npafp_adequate")


def caterpillar(summary: DataFrame, ends: int = ENDS) -> DataFrame:
    """(district, spi_median, spi_q05, spi_q95, side): the lowest and highest indices, a row once; ties by district."""
    rows = summary.filter("spi_median is not null")
    low = rows.orderBy("spi_median", "district").limit(ends).withColumn("side", F.lit("low"))
    high = rows.orderBy(F.desc("spi_median"), "district").limit(ends).join(F.broadcast(low.select("district")), "district", "left_anti").withColumn("side", F.lit("high"))
    return low.unionByName(high).select("district", "spi_median", "spi_q05", "spi_q95", "side")


def calibration(summary: DataFrame) -> DataFrame:
    """(unit, period, expected_total, observed) of rows with cases, for log axes."""
    return summary.filter("observed > 0").select("unit", "period", "expected_total", "observed")


def _text(value: object, missing: str = "–") -> str:
    if value is None:
        return missing
    if isinstance(value, bool):
        return "yes" if value else "no"
    return html.escape(f"{value:g}" if isinstance(value, float) else str(value))


def table_html(rows: list[dict], columns: list[str], shade: str | None = None, caption: str = "") -> str:
    """An HTML table of a few rows; ``shade`` names the column whose label colours its row."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = []
    for r in rows:
        colour = COLOURS.get(r.get(shade)) if shade else None
        style = f' style="border-left:4px solid {colour}"' if colour else ""
        body.append(f"<tr{style}>" + "".join(f"<td>{_text(r.get(c))}</td>" for c in columns) + "</tr>")
    return f"<table><caption>{html.escape(caption)}</caption><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table>"


def guide_table(focal: DataFrame, layout: str = "scan", max_rows: int = MAX_ROWS, simple: bool = False, file: str | None = None) -> str:
    """The ranked table of a year, or the worked examples side by side; at most ``max_rows`` rows are fetched, and the caption says how many are left out."""
    if layout not in ("scan", "worked"):
        raise ValueError("layout is 'scan' or 'worked'")
    table = scan_table(focal, simple)
    if layout == "scan":
        rows = [r.asDict() for r in table.orderBy("verdict_order", F.col("spi").asc_nulls_last(), "district").limit(max_rows).collect()]
        left = focal.count() - len(rows) if len(rows) == max_rows else 0
        out = table_html(rows, [c for c in table.columns if c != "verdict_order"], "verdict", "Districts by review label" + (f"; {left} more are left out" if left else ""))
    else:
        picked = worked_examples(focal).join(table, "district").orderBy("example").collect()
        facts = [c for c in table.columns if c not in ("district", "verdict_order")]
        rows = [{"": f, **{p.district: p[f] for p in picked}} for f in facts]
        out = table_html(rows, ["", *[p.district for p in picked]], None, "Worked examples")
    if file is not None:
        save(out, file)
    return out


def save(text: str, file: str) -> Path:
    """Write a report; the ending must be .html."""
    path = Path(file)
    if path.suffix.lower() not in (".html", ".htm"):
        raise ValueError("reports are written as .html")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def line_svg(points: list[tuple[int, float | None]], cut: float | None = None, width: int = 320, height: int = 90) -> str:
    """A small line chart; gaps where values are missing."""
    known = [v for _, v in points if v is not None and math.isfinite(v)]
    if not known:
        return f'<svg width="{width}" height="{height}"></svg>'
    lo, hi = min([*known, cut or 0.0]), max([*known, cut or 0.0]) or 1.0
    x = lambda i: 10 + i * (width - 20) / max(1, len(points) - 1)
    y = lambda v: height - 10 - (v - lo) / ((hi - lo) or 1) * (height - 20)
    runs, run = [], []
    for i, (_, v) in enumerate(points):
        if v is None or not math.isfinite(v):
            runs, run = [*runs, run], []
        else:
            run.append(f"{x(i):.1f},{y(v):.1f}")
    lines = "".join(f'<polyline fill="none" stroke="#333" points="{" ".join(r)}"/>' for r in [*runs, run] if r)
    rule = f'<line x1="10" x2="{width - 10}" y1="{y(cut):.1f}" y2="{y(cut):.1f}" stroke="#b2182b" stroke-dasharray="4"/>' if cut is not None else ""
    return f'<svg width="{width}" height="{height}">{rule}{lines}</svg>'


def resolve(guide: DataFrame, district: str, name_col: str | None = None) -> str:
    """The id that ``district`` names: an id, else a unique name in any case."""
    cols = ["district", *([name_col] if name_col else [])]
    if not guide.filter(F.col("district") == district).limit(1).isEmpty():
        return district
    if name_col:
        found = [r.district for r in guide.filter(F.lower(name_col) == district.lower()).select("district").distinct().limit(2).collect()]
        if len(found) == 1:
            return found[0]
        if found:
            raise ValueError(f"{district} names more than one district")
    near = [" ".join(map(str, r)) for r in guide.filter(F.lower(F.col(cols[-1])).startswith(district[:3].lower())).select(*cols).distinct().orderBy(*cols).limit(5).collect()]
    raise ValueError(f"no district {district}" + (f"; near are {', '.join(near)}" if near else ""))


def series_svg(rows: list[dict], cut: float = 1.0, width: int = 360, height: int = 130) -> str:
    """A district's index by year with its interval, the cut, and years with detections: filled diamonds of cases, open circles of the environment."""
    usable = lambda v: v is not None and math.isfinite(v)
    held = [r[c] for r in rows for c in ("spi_median", "spi_q95") if usable(r.get(c))]
    if not held:
        return f'<svg width="{width}" height="{height}"></svg>'
    first, last, top = rows[0]["year"], rows[-1]["year"], 1.05 * max([*held, cut])
    x = lambda year: 30 + (year - first) * (width - 50) / max(1, last - first)
    y = lambda v: 10 + (1 - v / top) * (height - 40)
    out, runs = [], [[]]
    for i, r in enumerate(rows):
        if runs[-1] and (not usable(r["spi_median"]) or r["year"] != rows[i - 1]["year"] + 1):
            runs.append([])
        if usable(r["spi_median"]):
            runs[-1].append(r)
    for run in filter(None, runs):
        if all(usable(r.get("spi_q05")) and usable(r.get("spi_q95")) for r in run):
            there, back = [f"{x(r['year']):.1f},{y(r['spi_q95']):.1f}" for r in run], [f"{x(r['year']):.1f},{y(r['spi_q05']):.1f}" for r in reversed(run)]
            out.append(f'<polygon class="interval" points="{" ".join(there + back)}" fill="#ccc" stroke="#ccc"/>')
        out.append(f'<polyline fill="none" stroke="#333" points="{" ".join(f"{x(r["year"]):.1f},{y(r["spi_median"]):.1f}" for r in run)}"/>')
        out.extend(f'<circle cx="{x(r["year"]):.1f}" cy="{y(r["spi_median"]):.1f}" r="2"/>' for r in run)
    out.append(f'<line class="rule" x1="30" x2="{width - 20}" y1="{y(cut):.1f}" y2="{y(cut):.1f}" stroke="#b2182b" stroke-dasharray="4"/>')
    for column, mark in (("afp_years", '<path class="afp" d="M{0:.1f},{1}l4,4l-4,4l-4,-4Z" fill="#333"/>'), ("es_years", '<circle class="es" cx="{0:.1f}" cy="{2}" r="3.5" fill="none" stroke="#333"/>')):
        # each row tells the years up to its own, so the last one tells all
        seen = {int(v) for r in rows for v in re.findall("[0-9]{4}", str(r.get(column) or ""))}
        out.extend(mark.format(x(v), height - 29, height - 25) for v in sorted(seen) if first <= v <= last)
    out.extend(f'<text x="{x(v):.1f}" y="{height - 6}" font-size="9" text-anchor="middle">{v}</text>' for v in sorted({first, last}))
    return f'<svg class="series" width="{width}" height="{height}">{"".join(out)}</svg>'


def probability_text(probability: float) -> str:
    """The probability of an index under 1, no finer than draws tell it."""
    if not 0 <= probability <= 1:
        raise ValueError("a probability lies between 0 and 1")
    told = "over 99%" if probability > 0.99 else "under 1%" if probability < 0.01 else f"{100 * probability:.0f}%"
    return f"Probability of an index under 1: {told}"


def region_text(region: dict) -> str:
    """The region's name, index and rank, as far as they are given."""
    parts = [f"Region {region['name']}"] if region.get("name") is not None else []
    if region.get("spi") is not None:
        parts.append(f"index {region['spi']:.2f}")
    if region.get("rank") is not None:
        parts.append(f"rank {region['rank']}" + (f" of {region['n']}" if region.get("n") is not None else "") + ", lowest first")
    return "; ".join(parts)


def share_text(pct: float | None, n: int | None = None) -> str:
    """A percentage with its number of cases; of few cases a fraction, as it is not assessed."""
    if pct is None or n == 0:
        return "no case to assess" if n == 0 else "–"
    if n is None:
        return f"{pct:.0f}%"
    return f"{pct:.0f}% of {n}" if n >= THIN else f"{round(pct * n / 100)} of {n}, not assessed"


def indicator_strip(rows: list[dict], year: int, target: float) -> str:
    """The conventional rate over the years against its target, and a tile for each percentage of the year; ``x_pct`` is of ``x_n`` cases."""
    own = next((r for r in rows if r["year"] == year), {})
    shares = [c[: -len("_pct")] for c in own if c.endswith("_pct")]
    tiles = "".join(f"<li><b>{html.escape(c.replace('_', ' ').capitalize())}</b> {share_text(own[c + '_pct'], own.get(c + '_n'))}</li>" for c in shares)
    rate = ""
    if any(r.get("npafp_rate") is not None for r in rows):
        now = own.get("npafp_rate")
        told = "no rate this year" if now is None else f"{now:.1f}, {'at or above' if now >= target else 'below'} the target of {target:g}"
        rate = f"<p>Rate per 100 000: {told}</p>{line_svg([(r['year'], r.get('npafp_rate')) for r in rows], target)}"
    return f'<section class="indicators">{rate}<ul>{tiles}</ul></section>'


def pager(
    guide: DataFrame, district: str, year: int, name_col: str | None = None, note: str | None = None, file: str | None = None, outlines: DataFrame | None = None, province_of: DataFrame | None = None,
    prob_under: float | None = None, region: dict | None = None, indicators: DataFrame | None = None, npafp_target: float = NPAFP_TARGET, spi_cut: float = 1.0, year_label: str | None = None,
) -> str:
    """One district's page: the label, its components, its series, and what they do not say.

    ``outlines`` (district, part, ring, seq, x, y) of the whole country adds a map of where the district lies, ``province_of`` (district,
    province) the provinces in it; ``region`` has any of name, spi, rank and n; ``indicators`` is (district, year) with npafp_rate and
    percentages. None of these changes the label.
    """
    own = resolve(guide, district, name_col)
    rows = sorted((r.asDict() for r in guide.filter(F.col("district") == own).collect()), key=lambda r: r["year"])  # one district's years
    focal = next((r for r in rows if r["year"] == year), None)
    if focal is None:
        raise ValueError(f"no row for district {own} in {year}")
    title, period = html.escape(str(focal.get(name_col) or own)), html.escape(year_label or str(year))
    verdict, colour = focal["verdict"], COLOURS[focal["verdict"]]
    thin = focal.get("n_cases") is not None and focal["n_cases"] < THIN
    names = {"spi_median": "Index", "observed": "Observed", "expected_total": "Expected", "npafp_rate": "Rate per 100 000", "extent_concern": "Extent", "persistence_concern": "Persistence", "pct_transport_timely": "Timely transport, %", "pct_adequate": "Adequate stools, %", "neighbour_spi": "Neighbours' index", "seasonal": "Seasonal", "trajectory": "Trend"}
    tiles = "".join(f"<li><b>{html.escape(label)}</b> {_text(focal[c])}</li>" for c, label in names.items() if c in focal)
    told = [t for t in (region_text(region) if region else "", probability_text(prob_under) if prob_under is not None else "") if t]
    head = "".join(f'<p class="context">{html.escape(t)}</p>' for t in told)
    where = locator_svg(outlines, own, province_of, colour) if outlines is not None else ""
    strip = indicator_strip(sorted((r.asDict() for r in indicators.filter(F.col("district") == own).collect()), key=lambda r: r["year"]), year, npafp_target) if indicators is not None else ""
    more = "<p>Fewer than five cases: percentages are not assessed.</p>" if thin else ""
    remark = f"<p>{html.escape(note)}</p>" if note else ""
    page = (
        f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title} {period}</title></head><body><h1>{title}, {period}</h1>{where}'
        f'<p style="border-left:6px solid {colour};padding-left:8px">{html.escape(verdict)}</p>{head}<ul>{tiles}</ul>{series_svg(rows, spi_cut)}{strip}{more}{remark}'
        "<p>A low index is a relative shortfall of reports; it does not tell why, nor whether cases were missed.</p></body></html>"
    )
    if file is not None:
        save(page, file)
    return page


def file_name(district: str, year: int, folder: str = ".") -> str:
    """A safe path for a district's page."""
    return os.path.join(folder, f"{re.sub('[^a-z0-9]+', '-', district.lower()).strip('-') or 'district'}-{year}.html")


def map_svg(outlines: DataFrame, values: DataFrame, column: str, colours: tuple[str, ...], size: int = 400, most: int = 200_000) -> str:
    """A choropleth of one bin column: vertices (district, part, ring, seq, x, y) and bins by district."""
    if outlines.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} vertices; simplify the boundaries first")
    pts = outlines.orderBy("district", "part", "ring", "seq").collect()
    fill = {r.district: r[column] for r in values.select("district", column).collect()}
    if not pts:
        return "<svg></svg>"
    x0, x1, y0, y1 = min(p.x for p in pts), max(p.x for p in pts), min(p.y for p in pts), max(p.y for p in pts)
    scale = size / max(x1 - x0, y1 - y0, 1e-9)
    paths: dict[tuple, list[str]] = {}
    for p in pts:
        paths.setdefault((p.district, p.part, p.ring), []).append(f"{(p.x - x0) * scale:.1f},{(y1 - p.y) * scale:.1f}")
    shapes = "".join(f'<polygon points="{" ".join(v)}" fill="{colours[fill[k[0]]] if fill.get(k[0]) is not None else "#ddd"}" stroke="#fff"/>' for k, v in paths.items())
    return f'<svg width="{size}" height="{size}">{shapes}</svg>'


#: What the columns of a guide are worked out from, what its labels take into account, and what no column can say.
HELP = {
    "signals": {
        "spi_below, cri_excludes_1": "The district's median index is under the cut of the call; the upper end of its interval is under 1.",
        "extent_pct, national_pct": "Shares of districts under the cut: in the same area without the district itself, and in the whole year.",
        "persistence_concern": "The row of the calendar year before exists and is under the cut too; a gap of a year gives none.",
        "process columns": "Shares of cases with an adequate specimen or timely transport against their target; null below the least number of cases. They change no label.",
    },
    "verdict": dict(zip(VERDICTS, ("spi_below, the gate, and at least one of extent and persistence.", "spi_below, but not all of that.", "The index is not under the cut."), strict=True)),
    "misreadings": {
        "An index of 1": "equals the country's own ratio of reported to expected, whatever that ratio is.",
        "A small index": "is a ratio; how many reports it stands for is in expected_total.",
        "A wide interval": "leaves both sides of the cut open, and the label does not tell them apart.",
        "Two districts' ranks": "may differ by less than either interval.",
    },
}


#: What each worked example shows.
EXAMPLES = ("a passed rate target without indication", "a low index whose interval reaches 1", "a priority that passes the rate target", "a low index that persists without extent")


def example_text(focal: DataFrame) -> str:
    """The worked examples of a guide's year in words; up to four districts."""
    out = []
    for r in worked_examples(focal).join(focal, "district").orderBy("example").collect():
        got = r.asDict().get  # a guide may lack the parts that it was given no data for
        facts = [f"its index was {_text(got('spi_median'))}, {'below' if got('spi_below') else 'not below'} the cut"]
        if got("spi_previous") is None:
            facts.append("there is no index of the year before")
        else:
            facts.append(f"the year before it was {_text(got('spi_previous'))}, {'also below' if got('persistence_concern') else 'at or above'} the cut")
        area, national = got("extent_pct"), got("national_pct")
        if area is not None and national is not None:
            digits = 1 if round(area) == round(national) else 0  # never the same number on either side
            facts.append(f"{area:.{digits}f}% of the area's other districts were low against {national:.{digits}f}% nationally")
        out.append(f"{r.district} - {EXAMPLES[r.example - 1]}\n  {'; '.join(facts)}.\n  Review label: {r.verdict}")
    return "\n".join(out)


def help_text(topic: str = "all", focal: DataFrame | None = None) -> str:
    """The guide's words on a topic: signals, verdict, misreadings, all, or the worked examples of a guide's rows ``focal`` ("example")."""
    if topic == "example":
        if focal is None:
            raise ValueError("topic 'example' needs the rows of a guide")
        return example_text(focal)
    if topic != "all" and topic not in HELP:
        raise ValueError(f"topic is all, example or one of {', '.join(HELP)}")
    parts = HELP if topic == "all" else {topic: HELP[topic]}
    return "\n".join(f"{name.capitalize()}\n" + "\n".join(f"  {k}: {v}" for k, v in lines.items()) for name, lines in parts.items())
