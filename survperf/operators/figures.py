"""The index's five plots as SVG: distribution, funnel, caterpillar, calibration and quadrants, on linear and logarithmic scales.

Scales come from aggregates, and points are put on a grid of half pixels by Spark: points that fall on one place are drawn once, so what is
fetched is bounded by the picture, whatever the number of districts and years.
"""

from __future__ import annotations

import html
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.operators import render
from survperf.operators.compare import NPAFP_TARGET, SPI_THRESHOLD

WIDTH, HEIGHT, LEFT, TOP = 420, 260, 56, 24
PASS, FAIL, PLAIN = "#2b6cb0", "#c05621", "#4a5568"


def linear_ticks(lo: float, hi: float, about: int = 5) -> list[float]:
    """Multiples of 1, 2 or 5 times a power of ten inside [lo, hi]; about so many."""
    if not hi > lo:
        return [lo]
    raw = (hi - lo) / about
    power = 10.0 ** math.floor(math.log10(raw))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= raw * (1 - 1e-9))
    first, last = math.ceil(lo / step - 1e-9), math.floor(hi / step + 1e-9)
    return [round(k * step, 12) for k in range(first, last + 1)]


def log_ticks(lo: float, hi: float, about: int = 6) -> list[float]:
    """Ticks of a logarithmic axis over [lo, hi], both positive: powers of ten, with 2 and 5 times them where few fit, or linear ticks inside one power."""
    decades = range(math.floor(math.log10(lo)), math.ceil(math.log10(hi)) + 1)
    for steps in ((1,), (1, 5), (1, 2, 5)):
        found = [m * 10.0**k for k in decades for m in steps if lo * (1 - 1e-9) <= m * 10.0**k <= hi * (1 + 1e-9)]
        if len(found) >= 3:
            every = math.ceil(len(found) / about) if steps == (1,) else 1
            return found[::every]
    return linear_ticks(lo, hi)


@dataclass(frozen=True)
class Scale:
    """A scale from values to pixels; ``flip`` for the vertical one."""

    lo: float
    hi: float
    log: bool = False
    length: float = WIDTH
    flip: bool = False

    def _of(self, v: float) -> float:
        return math.log10(v) if self.log else v

    def at(self, value: float) -> float:
        low, high = self._of(self.lo), self._of(self.hi)
        part = (self._of(value) - low) / (high - low) if high > low else 0.5
        return self.length * (1 - part if self.flip else part)

    def place(self, value: Column) -> Column:
        """``at`` for a column, to half a pixel."""
        low, high = self._of(self.lo), self._of(self.hi)
        part = ((F.log10(value) if self.log else value) - low) / (high - low) if high > low else F.lit(0.5)
        return F.round((1 - part if self.flip else part) * self.length * 2) / 2

    @property
    def ticks(self) -> list[float]:
        return log_ticks(self.lo, self.hi) if self.log else linear_ticks(self.lo, self.hi)


def usable(value: Column, log: bool) -> Column:
    return F.coalesce((F.abs(value) < float("inf")) & ~F.isnan(value) & ((value > 0) if log else F.lit(True)), F.lit(False))


def scale_of(df: DataFrame, columns: list[str], log: bool = False, length: float = WIDTH, flip: bool = False, also: tuple[float, ...] = ()) -> Scale:
    """A scale that holds the usable values of ``columns`` and ``also``, with a small margin."""
    values = [F.when(usable(F.col(c).cast("double"), log), F.col(c).cast("double")) for c in columns]
    ends = df.agg(F.min(F.array_min(F.array(*values))).alias("lo"), F.max(F.array_max(F.array(*values))).alias("hi")).first()
    held = [v for v in (ends.lo, ends.hi, *also) if v is not None and (v > 0 or not log)] or [1.0, 10.0]
    lo, hi = min(held), max(held)
    if log:
        return Scale(lo / 1.05, hi * 1.05, True, length, flip)
    margin = 0.03 * (hi - lo) or 0.5
    return Scale(lo - margin, hi + margin, False, length, flip)


def number(v: float) -> str:
    return f"{v:g}"


def frame(x: Scale | None, y: Scale | None, title: str, x_label: str, y_label: str, body: list[str], height: float = HEIGHT) -> str:
    """An SVG of ``body`` with axes, their ticks and labels; an axis that is None has none."""
    out = [f'<svg width="{LEFT + WIDTH + 20}" height="{TOP + height + 44}" font-size="10" font-family="sans-serif"><text x="{LEFT}" y="14" font-size="12">{html.escape(title)}</text><g transform="translate({LEFT},{TOP})">']
    out.append(f'<path d="M0,0V{height:g}H{WIDTH}" fill="none" stroke="#000"/>')
    for v in x.ticks if x else []:
        out.append(f'<line class="tick" x1="{x.at(v):.1f}" x2="{x.at(v):.1f}" y1="{height:g}" y2="{height + 4:g}" stroke="#000"/><text x="{x.at(v):.1f}" y="{height + 15:g}" text-anchor="middle">{number(v)}</text>')
    for v in y.ticks if y else []:
        out.append(f'<line class="tick" x1="-4" x2="0" y1="{y.at(v):.1f}" y2="{y.at(v):.1f}" stroke="#000"/><text x="-7" y="{y.at(v) + 3:.1f}" text-anchor="end">{number(v)}</text>')
    out.append(f'<text x="{WIDTH / 2:g}" y="{height + 32:g}" text-anchor="middle">{html.escape(x_label)}</text><text transform="translate(-42,{height / 2:g}) rotate(-90)" text-anchor="middle">{html.escape(y_label)}</text>')
    return "".join([*out, *body, "</g></svg>"])


def rule(scale: Scale, value: float, length: float = HEIGHT) -> list[str]:
    """A dashed line across the plot at a value of its scale, if that lies on it."""
    if not scale.lo <= value <= scale.hi:
        return []
    p = scale.at(value)
    ends = f'x1="0" x2="{WIDTH}" y1="{p:.1f}" y2="{p:.1f}"' if scale.flip else f'x1="{p:.1f}" x2="{p:.1f}" y1="0" y2="{length:g}"'
    return [f'<line class="rule" {ends} stroke="#999" stroke-dasharray="4 3"/>']


def dots(df: DataFrame, x: str, y: str, scale_x: Scale, scale_y: Scale, colour: Column) -> list[str]:
    """A circle for each occupied place and colour; its title counts the rows on it. Rows without a usable value are left out."""
    rows = df.filter(usable(F.col(x).cast("double"), scale_x.log) & usable(F.col(y).cast("double"), scale_y.log))
    placed = rows.select(scale_x.place(F.col(x)).alias("px"), scale_y.place(F.col(y)).alias("py"), colour.alias("c")).groupBy("px", "py", "c").agg(F.count(F.lit(1)).alias("n"))
    return [f'<circle cx="{r.px:g}" cy="{r.py:g}" r="2.5" fill="{r.c}" fill-opacity="0.6"><title>{r.n}</title></circle>' for r in placed.orderBy("px", "py", "c").collect()]


def distribution_svg(summary: DataFrame, bins: int = render.HISTOGRAM_BINS) -> str:
    """The histogram of positive indices on a log scale; the title tells how many are zero."""
    rows = render.histogram(summary, bins).orderBy("bin").collect()  # at most so many bins
    zero = render.dropped_zeros(summary).first().n_zero
    if not rows:
        return frame(None, None, "No positive index", "index", "rows", [])
    x = Scale(10 ** min(r.lower for r in rows) / 1.05, 10 ** max(r.upper for r in rows) * 1.05, True)
    y = Scale(0.0, 1.05 * max(r.n for r in rows), False, HEIGHT, True)
    bars = []
    for r in rows:
        left, right = x.at(10**r.lower), x.at(10**r.upper)
        bars.append(f'<rect x="{left:.1f}" y="{y.at(r.n):.1f}" width="{max(right - left, 1):.1f}" height="{y.at(0) - y.at(r.n):.1f}" fill="{PLAIN}" stroke="#fff"><title>{r.n}</title></rect>')
    return frame(x, y, f"Distribution of the index ({zero} of zero left out)" if zero else "Distribution of the index", "index", "rows", bars + rule(x, 1.0))


def funnel_svg(comparison: DataFrame, threshold: float = SPI_THRESHOLD, seed: int = 1) -> str:
    """The index against expected cases, jittered along the log axis so that equal ones part; colours tell the rate target."""
    rows = render.funnel(comparison, seed)
    x, y = scale_of(rows, ["expected_jittered"], True), scale_of(rows, ["spi_median"], False, HEIGHT, True, (threshold,))
    colour = F.when(F.col("npafp_adequate"), PASS).when(~F.col("npafp_adequate"), FAIL).otherwise(PLAIN)
    return frame(x, y, "Index by expected cases", "expected cases", "index", rule(y, threshold) + dots(rows, "expected_jittered", "spi_median", x, y, colour))


def caterpillar_svg(summary: DataFrame, ends: int = render.ENDS) -> str:
    """The lowest and highest indices of a year with their intervals, lowest first."""
    rows = render.caterpillar(summary, ends).orderBy("spi_median", "district").collect()  # at most twice ``ends``
    height = max(14 * len(rows), 28)
    x = scale_of(summary, ["spi_median", "spi_q05", "spi_q95"], False, WIDTH, False, (1.0,))
    body = []
    for i, r in enumerate(rows):
        at = 14 * i + 7
        if r.spi_q05 is not None and r.spi_q95 is not None:
            body.append(f'<line class="interval" x1="{x.at(r.spi_q05):.1f}" x2="{x.at(r.spi_q95):.1f}" y1="{at}" y2="{at}" stroke="{PLAIN}"/>')
        body.append(f'<circle cx="{x.at(r.spi_median):.1f}" cy="{at}" r="3" fill="{FAIL if r.side == "low" else PASS}"/><text x="-7" y="{at + 3}" text-anchor="end">{html.escape(str(r.district))}</text>')
    return frame(x, None, "Lowest and highest indices", "index with its 5 to 95 % interval", "", rule(x, 1.0, height) + body, height)


def calibration_svg(summary: DataFrame) -> str:
    """Observed against expected cases on log axes of one range, with the line where they are equal."""
    rows = render.calibration(summary)
    both = scale_of(rows, ["expected_total", "observed"], True)
    x, y = both, Scale(both.lo, both.hi, True, HEIGHT, True)
    line = [f'<line class="rule" x1="{x.at(x.lo):.1f}" y1="{y.at(y.lo):.1f}" x2="{x.at(x.hi):.1f}" y2="{y.at(y.hi):.1f}" stroke="#999" stroke-dasharray="4 3"/>']
    return frame(x, y, "Observed and expected cases", "expected", "observed", line + dots(rows, "expected_total", "observed", x, y, F.lit(PLAIN)))


def quadrants_svg(comparison: DataFrame, target: float = NPAFP_TARGET, threshold: float = SPI_THRESHOLD) -> str:
    """The index against the conventional rate, parted at their thresholds; each quarter tells its number of rows."""
    known = comparison.filter("npafp_rate is not null and spi_median is not null")
    x, y = scale_of(known, ["npafp_rate"], False, WIDTH, False, (target,)), scale_of(known, ["spi_median"], False, HEIGHT, True, (threshold,))
    right, above = F.col("npafp_rate") >= target, F.col("spi_median") >= threshold
    counted = {(r.right, r.above): r.n for r in known.groupBy(right.alias("right"), above.alias("above")).agg(F.count(F.lit(1)).alias("n")).collect()}
    words = [f'<text class="quarter" x="{WIDTH - 4 if r else 4}" y="{12 if a else HEIGHT - 4}" text-anchor="{"end" if r else "start"}">{counted.get((r, a), 0)}</text>' for r in (False, True) for a in (False, True)]
    colour = F.when(above & right, PASS).when(~above & ~right, FAIL).otherwise(PLAIN)
    return frame(x, y, "Index and rate", "rate", "index", rule(x, target) + rule(y, threshold) + dots(known, "npafp_rate", "spi_median", x, y, colour) + words)
