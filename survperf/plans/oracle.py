"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

SQL: dict[str, str] = {}

WINDOW = "month BETWEEN DATE '1999-01-01' AND DATE '1999-12-01'"
FIRST = "year(month) >= 1998"

PARCELS = """SELECT CAST(k AS VARCHAR) AS district, seq, k % 40 + dx + OFF + 6e-6 * sin(k * 12.9898 + (seq % 4) * 78.233) AS x, k // 40 + dy + 2 * OFF + 6e-6 * cos(k * 12.9898 + (seq % 4) * 78.233) AS y
        FROM (SELECT c_custkey AS k FROM customer), (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(seq, dx, dy)"""

CTE: dict[str, str] = {
    "parcels": PARCELS.replace("OFF", "0"),
    "corners": "SELECT DISTINCT district, x, y FROM parcels",
    "snapped": """SELECT a.district AS focal, b.district AS neighbour, count(*) AS n FROM corners a JOIN corners b
        ON abs(a.x - b.x) <= 1e-5 AND a.district <> b.district AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1e-5 * 1e-5 GROUP BY 1, 2""",
    "ord": """SELECT CAST(c_nationkey AS VARCHAR) AS district, o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
        o_totalprice AS price, o_orderstatus AS status FROM orders JOIN customer ON o_custkey = c_custkey""",
    "areas": "SELECT CAST(n_nationkey AS VARCHAR) AS district, CAST(n_regionkey AS VARCHAR) AS area FROM nation",
    "annual": "SELECT district, CAST(year(day) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS observed, round(sum(price), 2) AS pop FROM ord GROUP BY 1, 2",
    "cases": """SELECT o_orderkey AS case_id, CAST(n_regionkey AS VARCHAR) AS parent, CAST(c_nationkey AS VARCHAR) AS unit, o_orderpriority AS class, o_orderstatus AS kind,
        coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END, CASE WHEN o_orderkey % 20 <> 0 THEN CAST(o_orderdate AS DATE) END, stool) AS date,
        CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 3 = 0 THEN 'No' ELSE 'Yes' END AS adequacy
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS stool FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "records": """SELECT unit, upper(class) LIKE '%URGENT%' AS polio, CAST(date_trunc('month', date) AS DATE) AS month, adequacy FROM cases
        WHERE kind IN ('F', 'O') AND date IS NOT NULL""",
    "allmonths": "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS month",
    "stool": f"""SELECT unit, count(*) AS n_stool, CAST(sum(CASE WHEN adequacy = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS n_adequate FROM records
        WHERE {WINDOW} AND trim(adequacy) <> '' GROUP BY 1""",
    "months": "SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT min(month) AS a, max(month) AS b FROM ord)",
    "panel": """SELECT n.district, m.month, CAST(coalesce(c.count, 0) AS BIGINT) AS count, a.pop FROM areas n CROSS JOIN months m
        LEFT JOIN (SELECT district, month, count(*) AS count FROM ord GROUP BY 1, 2) c ON c.district = n.district AND c.month = m.month
        LEFT JOIN annual a ON a.district = n.district AND a.year = year(m.month)""",
    "draws": f"""SELECT p.district, month, draw, base * exp(0.2 * sin(draw * 1.7 + CAST(p.district AS INTEGER) + month(month))) AS expected
        FROM panel p JOIN (SELECT district, avg(count) AS base FROM panel GROUP BY 1) b ON p.district = b.district, (SELECT unnest(generate_series(1, 20)) AS draw) WHERE {FIRST}""",
    "hist": """SELECT *, CAST(count(*) OVER w AS INTEGER) AS history_years, coalesce(sum(observed) OVER w, 0) AS history_cases, coalesce(sum(pop) OVER w, 0) AS history_pop
        FROM annual WINDOW w AS (PARTITION BY district ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "exp": """SELECT *, CASE WHEN history_years = 0 THEN 'no previous year' WHEN history_cases = 0 THEN 'no previous case' ELSE 'ok' END AS history_check,
        CASE WHEN history_years > 0 THEN pop * history_cases / nullif(history_pop, 0) END AS expected FROM hist WHERE year >= (SELECT min(year) + 3 FROM annual)""",
    "nat": """SELECT year, sum(observed) AS national_observed, sum(expected) AS national_expected, count(DISTINCT district) AS districts, sum(observed) / nullif(sum(expected), 0) AS national_oe
        FROM exp WHERE history_check = 'ok' AND expected > 0 GROUP BY 1""",
    "steps": """SELECT district, year, slot, CASE WHEN year - y = 1 THEN ln(pop / p) END AS lc FROM (SELECT *, lag(pop) OVER w AS p, lag(year) OVER w AS y, row_number() OVER w AS slot
        FROM annual WINDOW w AS (PARTITION BY district ORDER BY year)) WHERE y IS NOT NULL""",
    "devs": "SELECT s.*, lc - coalesce(mid, 0) AS dev FROM steps s JOIN (SELECT year, median(lc) AS mid FROM steps GROUP BY 1) m ON s.year = m.year",
    "fences": """SELECT CASE WHEN n >= 4 THEN least(q1 - 3 * (q3 - q1), -ln(1.1)) ELSE -1e300 END AS low, CASE WHEN n >= 4 THEN greatest(q3 + 3 * (q3 - q1), ln(1.1)) ELSE 1e300 END AS high
        FROM (SELECT count(dev) AS n, quantile_cont(dev, 0.25) AS q1, quantile_cont(dev, 0.75) AS q3 FROM devs)""",
    "flagged": "SELECT d.*, coalesce(dev < low OR dev > high, FALSE) AS unusual FROM devs d, fences",
    "ahead": """SELECT *, lead(year, 1) OVER w AS y1, lead(dev, 1) OVER w AS d1, lead(unusual, 1) OVER w AS u1, lead(year, 2) OVER w AS y2, lead(dev, 2) OVER w AS d2, lead(unusual, 2) OVER w AS u2
        FROM flagged WINDOW w AS (PARTITION BY district ORDER BY slot)""",
    "upto": "SELECT DISTINCT year AS upto FROM annual WHERE year >= (SELECT min(year) + 3 FROM annual)",
    "screened": """SELECT district, upto, bool_or(unusual AND (coalesce(y1 <= upto AND u1 AND sign(d1) <> sign(dev), FALSE) OR coalesce(y2 <= upto AND u2 AND sign(d2) <> sign(dev), FALSE))) AS spike,
        CAST(sum(CASE WHEN unusual THEN 1 ELSE 0 END) AS INTEGER) AS unusual_changes, arg_max(lc, struct_pack(a := abs(lc), b := -slot)) FILTER (lc IS NOT NULL) AS lc
        FROM ahead JOIN upto ON year <= upto GROUP BY 1, 2""",
    "qc": """SELECT g.district, g.upto AS year, CASE WHEN spike THEN 'check_spike' WHEN unusual_changes > 0 THEN 'check_change' WHEN coalesce(r.years, 0) < y.all_years THEN 'check_history' ELSE 'ok' END AS population_qc,
        coalesce(unusual_changes, 0) AS unusual_changes, exp(lc) - 1 AS largest_change, CAST(coalesce(r.years, 0) AS INTEGER) AS years
        FROM (SELECT DISTINCT district, upto FROM annual, upto) g LEFT JOIN screened s ON s.district = g.district AND s.upto = g.upto
        LEFT JOIN (SELECT district, upto, count(*) AS years FROM annual JOIN upto ON year <= upto GROUP BY 1, 2) r ON r.district = g.district AND r.upto = g.upto
        JOIN (SELECT upto, count(DISTINCT year) AS all_years FROM annual JOIN upto ON year <= upto GROUP BY 1) y ON y.upto = g.upto""",
    "simple": """SELECT e.district, e.year, e.observed, e.pop, 100000 * e.observed / e.pop AS npafp_rate, history_years, history_cases, history_pop,
        CASE WHEN history_years > 0 THEN 100000 * history_cases / nullif(history_pop, 0) END AS history_rate, history_check, expected, CASE WHEN history_check = 'ok' THEN e.observed / nullif(expected, 0) END AS oe,
        CASE WHEN national_oe > 0 THEN national_oe END AS national_oe, CASE WHEN history_check = 'ok' THEN e.observed / nullif(expected, 0) END / CASE WHEN national_oe > 0 THEN national_oe END AS spi, population_qc
        FROM exp e LEFT JOIN nat ON nat.year = e.year LEFT JOIN qc ON qc.district = e.district AND qc.year = e.year""",
    "process": """SELECT district, CAST(year(day) AS INTEGER) AS year, CAST(count(*) AS INTEGER) AS n_cases, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS INTEGER) AS n_adequate, CAST(count(ship) AS INTEGER) AS n_transport,
        CAST(sum(CASE WHEN ship - day <= -640 THEN 1 ELSE 0 END) AS INTEGER) AS n_transport_timely
        FROM ord LEFT JOIN (SELECT l_orderkey, CAST(min(l_shipdate) AS DATE) AS ship FROM lineitem GROUP BY 1) ON orderkey = l_orderkey GROUP BY 1, 2""",
    "verts": "SELECT CAST(n_nationkey AS VARCHAR) AS district, seq, n_nationkey % 5 + dx AS x, n_nationkey // 5 + dy AS y FROM nation, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(seq, dx, dy)",
    "shared": "SELECT a.district AS focal, b.district AS neighbour, count(DISTINCT (a.x, a.y)) AS n FROM verts a JOIN verts b ON a.x = b.x AND a.y = b.y AND a.district <> b.district GROUP BY 1, 2",
    "queen": "SELECT focal, neighbour FROM shared",
    "rook": "SELECT focal, neighbour FROM shared WHERE n >= 2",
}
NEEDS = {"corners": ["parcels"], "snapped": ["corners"], 
    "annual": ["ord"], "records": ["cases"], "stool": ["records"], "months": ["ord"], "panel": ["areas", "months", "annual"], "draws": ["panel"], "hist": ["annual"], "exp": ["hist"], "nat": ["exp"], "steps": ["annual"], "devs": ["steps"],
    "fences": ["devs"], "flagged": ["devs", "fences"], "ahead": ["flagged"], "upto": ["annual"], "screened": ["ahead", "upto"], "qc": ["screened", "upto", "annual"], "simple": ["exp", "nat", "qc"], "process": ["ord"], "shared": ["verts"], "queen": ["shared"], "rook": ["shared"],
}


def build(select: str, *uses: str, extra: dict[str, str] | None = None, replace: dict[str, str] | None = None) -> str:
    """``select`` after the common tables it uses, in order of need, ``extra`` ones last."""
    bodies, ordered = CTE | (replace or {}), []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in uses:
        visit(name)
    parts = [f"{n} AS ({bodies[n]})" for n in ordered] + [f"{n} AS ({b})" for n, b in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


# preparation
POP = "SELECT district, year, pop FROM annual"
SQL["case_date"] = build("SELECT case_id, date FROM cases", "cases")
SQL["case_records"] = build("SELECT unit, polio, month FROM records", "records")
SQL["panel_months"] = """
WITH l AS (SELECT o_custkey AS custkey, CAST(max(o_orderdate) AS DATE) AS as_of FROM orders GROUP BY 1),
m AS (SELECT *, CAST(date_trunc('month', as_of) - INTERVAL 1 MONTH AS DATE) AS closed FROM l)
SELECT custkey, as_of, CASE WHEN closed >= DATE '1995-01-01' THEN DATE '1995-01-01' END AS first, CASE WHEN closed >= DATE '1995-01-01' THEN closed END AS last,
  CAST(greatest(date_diff('month', DATE '1995-01-01', closed) + 1, 0) AS BIGINT) AS n FROM m"""
SQL["window_months"] = build("SELECT CAST(date_trunc('month', day) - to_months(CAST(k AS INTEGER)) AS DATE) AS month, count(*) AS n FROM ord, range(1, 13) r(k) GROUP BY 1", "ord")
SQL["case_panel"] = build(
    """SELECT a.district, m.month, CAST(coalesce(n, 0) AS INTEGER) AS count FROM areas a CROSS JOIN allmonths m
    LEFT JOIN (SELECT unit, month, count(*) AS n FROM records WHERE NOT polio GROUP BY 1, 2) c ON c.unit = a.district AND c.month = m.month""",
    "areas", "allmonths", "records",
)
SQL["pop_observed"] = build(f"SELECT district, year, round(sum(pop), 6) AS pop FROM ({POP}) WHERE year BETWEEN 1996 AND 2000 AND pop > 0 GROUP BY 1, 2", "annual")
SQL["pop_index"] = build(
    "SELECT year, round(sum(pop), 6) AS total FROM seen WHERE district IN (SELECT district FROM seen GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT year) FROM seen)) GROUP BY 1",
    "annual", extra={"seen": "SELECT * FROM annual WHERE NOT (district = '3' AND year = 1997) AND pop > 0"},
)
SQL["pop_panel"] = build(
    """SELECT g.district, g.year, round(coalesce(s.pop, base_pop * i.total / b.total, base_pop), 6) AS pop, s.pop IS NULL AS carried
    FROM (SELECT district, year FROM areas, (SELECT DISTINCT year FROM annual)) g LEFT JOIN seen s ON s.district = g.district AND s.year = g.year
    LEFT JOIN (SELECT district, min(year) AS base_year, arg_min(pop, year) AS base_pop FROM seen GROUP BY 1) f ON f.district = g.district LEFT JOIN idx i ON i.year = g.year LEFT JOIN idx b ON b.year = base_year""",
    "areas", "annual",
    extra={"seen": "SELECT * FROM annual WHERE NOT (district IN ('3', '7') AND year IN (1996, 1998)) AND district <> '9' AND pop > 0", "idx": "SELECT year, sum(pop) AS total FROM seen WHERE district IN (SELECT district FROM seen GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT year) FROM seen)) GROUP BY 1"},
)
SQL["stool_adequacy"] = build("SELECT unit, n_stool, n_adequate, round(100.0 * n_adequate / n_stool, 6) AS pct_adequate FROM stool", "stool")
SQL["seasonal_features"] = build("SELECT month, " + ", ".join(f"round({f}(2 * pi() * {k} * month(month) / 12), 6) + 0.0 AS {f}{12 // k}" for k in (1, 2) for f in ("sin", "cos")) + " FROM (SELECT DISTINCT month FROM ord)", "ord")
SQL["covariate_standardise"] = build(
    "SELECT district, year, round((observed - avg(observed) OVER ()) / stddev_samp(observed) OVER (), 6) AS x_observed, round((ln(1 + pop) - avg(ln(1 + pop)) OVER ()) / stddev_samp(ln(1 + pop)) OVER (), 6) AS x_pop, CAST(NULL AS DOUBLE) AS x_flat FROM annual", "annual"
)

# simple index
SQL["simple_annual"] = build(f"SELECT district, year, {r('observed', 'pop')} FROM annual", "annual")
SQL["simple_index"] = build(f"SELECT district, year, history_years, history_check, population_qc, {r('observed', 'pop', 'npafp_rate', 'history_cases', 'history_pop', 'history_rate', 'expected', 'oe', 'national_oe', 'spi')} FROM simple", "simple")
SQL["simple_national"] = build(f"SELECT year, districts, {r('national_observed', 'national_expected', 'national_oe')} FROM nat", "nat")
SQL["simple_by_year_report"] = build(
    """SELECT year, count(*) AS districts, count(spi) AS available, round(median(spi), 6) AS median_spi, CAST(sum(CASE WHEN spi < 1 THEN 1 ELSE 0 END) AS BIGINT) AS below_1,
    CAST(sum(CASE WHEN spi < 0.8 THEN 1 ELSE 0 END) AS BIGINT) AS below_0_8, CAST(sum(CASE WHEN spi < 0.6 THEN 1 ELSE 0 END) AS BIGINT) AS below_0_6 FROM simple GROUP BY 1""", "simple"
)
_WHOLE, _TWO = "replace(format('{{:,.0f}}', {x}), ',', ' ')", "replace(format('{{:,.2f}}', {x}), ',', ' ')"
_LINES = [
    ("Current reporting", "Observed NPAFP cases", _WHOLE.format(x="observed")), ("Current reporting", "Current population under 15", _WHOLE.format(x="pop")), ("Current reporting", "NPAFP rate", _TWO.format(x="npafp_rate")),
    ("Previous reporting", "Previous years", "CAST(history_years AS VARCHAR)"), ("Previous reporting", "Previous NPAFP cases", _WHOLE.format(x="history_cases")), ("Previous reporting", "Previous child-years", _WHOLE.format(x="history_pop")),
    ("Previous reporting", "Previous rate", f"coalesce({_TWO.format(x='history_rate')}, 'not available')"), ("Expected reporting", "Expected NPAFP cases", f"coalesce({_TWO.format(x='expected')}, 'not available')"),
    ("SPI", "District observed / expected", f"CASE WHEN history_check = 'ok' THEN {_TWO.format(x='oe')} ELSE 'not calculated' END"), ("SPI", "National observed / expected", f"coalesce({_TWO.format(x='national_oe')}, 'NA')"),
    ("SPI", "SPI", f"coalesce({_TWO.format(x='spi')}, 'not calculated')"),
    ("SPI", "Reason", "CASE WHEN spi IS NULL THEN CASE history_check WHEN 'no previous case' THEN 'no previous NPAFP case' WHEN 'no previous year' THEN 'no previous year of data' ELSE 'national observed / expected is unavailable or zero' END END"),
    ("Data checks", "Population check", "CASE WHEN population_qc = 'ok' THEN 'no flag' ELSE population_qc END"),
]
SQL["simple_explain"] = build("SELECT * FROM (" + " UNION ALL ".join(f"SELECT district, year, {i} AS position, '{s}' AS section, '{c}' AS component, {v} AS value FROM simple" for i, (s, c, v) in enumerate(_LINES, 1)) + ") WHERE value IS NOT NULL AND year = 2000", "simple")
_CHANGED = """SELECT district, year, observed, CASE WHEN district = '4' AND year = 1999 THEN pop * 4 WHEN district = '5' AND year >= 1999 THEN pop * 5 ELSE pop END AS pop
    FROM (SELECT district, CAST(year(day) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS observed, round(sum(price), 2) AS pop FROM ord GROUP BY 1, 2) WHERE NOT (district = '6' AND year = 1997)"""
SQL["population_qc"] = build(f"SELECT district, year, population_qc, unusual_changes, years, {r('largest_change')} FROM qc", "qc", replace={"annual": _CHANGED})

# checks
SQL["check_panel_gaps"] = build("SELECT district, month FROM (SELECT DISTINCT district FROM ord), (SELECT DISTINCT month FROM ord) EXCEPT SELECT district, month FROM ord", "ord")
SQL["check_duplicates"] = build("SELECT district, month, count(*) AS n FROM ord GROUP BY 1, 2 HAVING count(*) > 1", "ord")
SQL["check_pop_coverage"] = build(
    f"""SELECT count(*) AS cells, count(p.year) AS covered, round_even(100.0 * count(p.year) / count(*), 1) AS pct
    FROM (SELECT DISTINCT district, CAST(year(month) AS INTEGER) AS year FROM panel) c LEFT JOIN (SELECT DISTINCT district, year FROM ({POP})) p ON p.district = c.district AND p.year = c.year""", "panel"
)
_RULE = "SELECT '{sev}' AS severity, '{code}' AS code, count(*) AS n, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') AS ids FROM ({rows}) HAVING count(*) > 0"


def _rules(*rules: tuple[str, str, str]) -> str:
    return " UNION ALL ".join(_RULE.format(sev=s, code=c, rows=q) for s, c, q in rules)


SQL["check_id_reconcile"] = build(_rules(("error", "cases_id_not_in_shapefile", "SELECT district AS k FROM areas WHERE area = '1'"), ("warning", "shapefile_no_cases", "SELECT district AS k FROM areas WHERE area <> '1' AND district NOT IN (SELECT district FROM panel)")), "areas", "panel")
SQL["check_issues"] = build(
    _rules(
        ("error", "cases_negative", "SELECT district AS k FROM bad WHERE count < 0"), ("error", "cases_duplicates", "SELECT district AS k FROM bad GROUP BY district, month HAVING count(*) > 1"),
        ("error", "cases_id_not_in_shapefile", "SELECT DISTINCT district AS k FROM bad WHERE district NOT IN (SELECT district FROM reg)"), ("warning", "shapefile_no_cases", "SELECT DISTINCT district AS k FROM reg WHERE district NOT IN (SELECT district FROM bad)"),
        ("warning", "panel_gaps", "SELECT district AS k FROM (SELECT district, month FROM (SELECT DISTINCT district FROM bad), (SELECT DISTINCT month FROM bad) EXCEPT SELECT district, month FROM bad)"), ("warning", "pop_zero", "SELECT district AS k FROM people WHERE pop = 0"),
        ("warning", "covariate_off_panel", "SELECT DISTINCT district AS k FROM reg WHERE district NOT IN (SELECT district FROM bad)"),
    )
    + """ UNION ALL SELECT 'warning', 'pop_coverage', count(*), '' FROM (SELECT DISTINCT district, CAST(year(month) AS INTEGER) AS year FROM bad EXCEPT SELECT district, year FROM people) HAVING count(*) > 0
    UNION ALL SELECT 'note', 'adjacency_components', CAST(0 AS BIGINT), ''""",
    "panel",
    extra={
        "spoiled": "SELECT district, month, CASE WHEN district = '3' AND month = DATE '1999-05-01' THEN -1 ELSE count END AS count FROM panel WHERE NOT (district = '2' AND month = DATE '1999-05-01')",
        "bad": "SELECT * FROM spoiled UNION ALL SELECT * FROM spoiled WHERE district = '4' AND month = DATE '1999-06-01'",
        "people": "SELECT district, year, CASE WHEN district = '6' THEN 0 ELSE pop END AS pop FROM annual WHERE NOT (district = '5' AND year = 1997)", "reg": "SELECT district FROM areas WHERE district <> '7' UNION ALL SELECT '99'",
    },
)
SQL["check_simple_issues"] = build(
    _rules(
        ("error", "cases_invalid_count", "SELECT district AS k FROM given WHERE n <> floor(n)"), ("error", "cases_negative", "SELECT district AS k FROM given WHERE n < 0"), ("warning", "pop_missing_or_zero", "SELECT district AS k FROM people WHERE pop = 0"),
        ("warning", "cases_no_population", "SELECT district AS k FROM given g WHERE NOT EXISTS (FROM people p WHERE p.district = g.district AND p.year = g.year AND p.pop > 0)"),
        ("note", "zero_filled", "SELECT district AS k FROM people p WHERE pop > 0 AND NOT EXISTS (FROM given g WHERE p.district = g.district AND p.year = g.year)"),
        *[("warning", f"pop_{c}", f"SELECT district AS k FROM qc WHERE population_qc = '{c}' AND year = (SELECT max(year) FROM qc)") for c in ("check_spike", "check_change", "check_history")],
    ),
    "qc",
    replace={"annual": "SELECT district, CAST(year(day) AS INTEGER) AS year, 0.0 AS observed, round(sum(price), 2) AS pop FROM ord GROUP BY 1, 2 HAVING NOT (district = '3' AND CAST(year(any_value(day)) AS INTEGER) = 1996)"},
    extra={
        "whole": "SELECT district, CAST(year(day) AS INTEGER) AS year, CAST(count(*) AS DOUBLE) AS n, round(sum(price), 2) AS pop FROM ord GROUP BY 1, 2",
        "given": "SELECT district, year, CASE WHEN district = '1' AND year = 1996 THEN -1 WHEN district = '2' AND year = 1996 THEN 0.5 ELSE n END AS n FROM whole WHERE NOT (district = '8' AND year = 1999)",
        "people": "SELECT district, year, CASE WHEN district = '3' AND year = 1996 THEN 0 ELSE pop END AS pop FROM whole",
    },
)

# draws
_COLS = ("expected_total", "spi_q05", "spi_q10", "spi_median", "spi_q90", "spi_q95", "spi_mean", "national_oe")


def index_ctes(period: str, unit: str = "district", where: str = FIRST, pop: str = "avg(pop)", centre: bool = True, source: str = "panel", drawn: str = "draws") -> dict[str, str]:
    ratio = "observed * ne / nullif(expected * national_observed, 0)" if centre else "observed / nullif(expected, 0)"
    quantiles = ", ".join(f"quantile_cont(s, {q}) AS {n}" for n, q in (("spi_q05", 0.05), ("spi_q10", 0.1), ("spi_median", 0.5), ("spi_q90", 0.9), ("spi_q95", 0.95)))
    return {
        "cells": f"SELECT {unit} AS unit, {period} AS period, draw, sum(expected) AS expected FROM {drawn} WHERE {where} GROUP BY 1, 2, 3",
        "obs": f"SELECT {unit} AS unit, {period} AS period, CAST(sum(count) AS BIGINT) AS observed, {pop} AS pop, count(DISTINCT month) AS n_months FROM {source} WHERE {where} GROUP BY 1, 2",
        "base": "SELECT o.*, expected_total FROM obs o JOIN (SELECT unit, period, median(expected) AS expected_total FROM cells GROUP BY 1, 2) e ON o.unit = e.unit AND o.period = e.period",
        "natd": "SELECT c.period, draw, sum(expected) AS ne FROM cells c JOIN base b ON b.unit = c.unit AND b.period = c.period WHERE expected_total > 0 GROUP BY 1, 2",
        "natl": """SELECT b.period, national_observed, b.districts, national_expected, national_observed / nullif(national_expected, 0) AS national_oe
            FROM (SELECT period, CAST(sum(observed) AS BIGINT) AS national_observed, count(DISTINCT unit) AS districts FROM base WHERE expected_total > 0 GROUP BY 1) b JOIN (SELECT period, median(ne) AS national_expected FROM natd GROUP BY 1) d ON d.period = b.period""",
        "q": f"""SELECT unit, period, {quantiles}, avg(s) AS spi_mean FROM (SELECT c.unit, c.period, {ratio} AS s FROM cells c JOIN base b ON b.unit = c.unit AND b.period = c.period
            JOIN natd d ON d.period = c.period AND d.draw = c.draw JOIN natl n ON n.period = c.period) GROUP BY 1, 2""",
        "idx": "SELECT b.unit, b.period, b.observed, b.pop, b.n_months, b.expected_total, q.* EXCLUDE (unit, period), n.national_oe FROM base b JOIN q ON q.unit = b.unit AND q.period = b.period JOIN natl n ON n.period = b.period",
    }


YEAR = "CAST(year(month) AS INTEGER)"
for _name, _period in (("spi_month", "month"), ("spi_quarter", "CAST(date_trunc('quarter', month) AS DATE)"), ("spi_year", YEAR), ("spi_year_end_april", "CAST(year(month + INTERVAL 8 MONTH) AS INTEGER)"), ("spi_total", "'all'")):
    SQL[_name] = build(f"SELECT unit, period, observed, n_months, {r('pop', *_COLS)} FROM idx", "draws", extra=index_ctes(_period))
SQL["spi_uncentred"] = build(f"SELECT unit, period, observed, n_months, {r('pop', *_COLS)} FROM idx", "draws", extra=index_ctes(YEAR, centre=False))
SQL["national_oe"] = build(f"SELECT period, national_observed, districts, {r('national_expected', 'national_oe')} FROM natl", "draws", extra=index_ctes(YEAR))
SQL["low_information"] = build(f"SELECT unit, period, {r('expected_total')} FROM idx WHERE expected_total < 7", "draws", extra=index_ctes("month"))
SQL["spi_totals"] = build("SELECT (SELECT CAST(sum(observed) AS BIGINT) FROM obs) AS observed, round(median(e), 1) AS expected, max(u) AS n_units, max(k) AS n_cells FROM (SELECT draw, sum(expected) AS e, count(DISTINCT unit) AS u, count(*) AS k FROM cells GROUP BY 1)", "draws", extra=index_ctes(YEAR))
_Q = ", ".join(f"round(quantile_cont(spi_median, {q}), 6) AS {n}" for n, q in (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95)))
SQL["spi_diagnostics"] = build(
    f"""SELECT count(spi_median) AS n, CAST(sum(observed) AS BIGINT) AS observed, round(sum(expected_total), 6) AS expected, round(sum(observed) / sum(expected_total), 6) AS calibration, {_Q},
    round(100 * avg(CASE WHEN spi_median < 0.5 THEN 1.0 ELSE 0 END), 6) AS pct_below_half, round(100 * avg(CASE WHEN spi_median > 1.5 THEN 1.0 ELSE 0 END), 6) AS pct_above_1_5, round(100 * avg(CASE WHEN spi_q95 < 1 OR spi_q05 > 1 THEN 1.0 ELSE 0 END), 6) AS pct_excludes_1,
    count(*) FILTER (spi_median < 0.5) AS band_low, count(*) FILTER (spi_median >= 0.5 AND spi_median < 0.8) AS band_mid, count(*) FILTER (spi_median >= 0.8 AND spi_median <= 1.2) AS band_near, count(*) FILTER (spi_median > 1.2) AS band_high,
    round((SELECT avg(pow(ln(spi_median) - m, 3)) / pow(any_value(s), 3) FROM idx, (SELECT avg(ln(spi_median)) AS m, stddev_samp(ln(spi_median)) AS s FROM idx WHERE spi_median > 0) WHERE spi_median > 0), 6) AS log_skewness FROM idx""",
    "draws", extra=index_ctes(YEAR),
)

# rolling windows
_WIN = index_ctes("'window'", where=WINDOW, pop="sum(pop) / 12")
_PARENTS = {
    "par": "SELECT district, area AS parent FROM areas WHERE district <> '11'", "ppanel": "SELECT p.*, coalesce(parent, '?') AS parent FROM panel p LEFT JOIN par ON par.district = p.district", "pdraws": "SELECT d.*, coalesce(parent, '?') AS parent FROM draws d LEFT JOIN par ON par.district = d.district",
} | index_ctes("'window'", unit="parent", where=WINDOW, pop="sum(pop) / 12", source="ppanel", drawn="pdraws")
SQL["window_summary"] = build(f"SELECT unit, observed, n_months AS months, {r('pop', *_COLS)} FROM idx", "draws", extra=_WIN)
SQL["window_summary_parents"] = build(f"SELECT nullif(unit, '?') AS unit, observed, n_months AS months, {r('pop', *_COLS)} FROM idx", "draws", extra=_PARENTS)
_CLASSED = {
    "rated": "SELECT *, 1e5 * observed / nullif(pop, 0) AS rate, coalesce(expected_total >= 1, FALSE) AND spi_median IS NOT NULL AS readable FROM idx",
    "passed": "SELECT *, rate >= 0.4 AS rate_pass, NOT (spi_median < 1.0 AND spi_q95 < 1) AS index_pass FROM rated",
    "agreed": """SELECT *, CASE WHEN readable THEN CASE WHEN rate_pass AND index_pass THEN 'both_pass' WHEN NOT rate_pass AND NOT index_pass THEN 'both_flag' WHEN rate_pass AND NOT index_pass THEN 'spi_only' WHEN NOT rate_pass AND index_pass THEN 'rate_only' END END AS agreement FROM passed""",
}
_CLASS_COLS = f"unit, observed, n_months AS months, {r('pop', *_COLS, 'rate')}, readable, rate_pass, index_pass, agreement, CASE WHEN agreement = 'spi_only' THEN 'focus' WHEN agreement IS NOT NULL THEN 'other' END AS focus_status"
SQL["window_classify"] = build(f"SELECT {_CLASS_COLS} FROM agreed", "draws", extra=_WIN | _CLASSED)
SQL["rolling_index"] = build(f"SELECT a.*, n_stool, n_adequate, round(100.0 * n_adequate / n_stool, 6) AS pct_adequate FROM (SELECT {_CLASS_COLS} FROM agreed) a LEFT JOIN stool s ON s.unit = a.unit", "draws", "stool", extra=_WIN | _CLASSED)

# comparison


def comparison(rule: str = "") -> dict[str, str]:
    return index_ctes(YEAR) | {
        "cmp0": f"SELECT unit AS district, period AS year, *, 1e5 * observed / nullif(pop, 0) AS npafp_rate, spi_median < 1{rule} AS spi_below_threshold FROM idx",
        "cmp": """SELECT c.*, area, npafp_rate >= 0.4 AS npafp_adequate, NOT spi_below_threshold AS spi_pass, CASE WHEN npafp_rate >= 0.4 AND NOT spi_below_threshold THEN 'Neither below' WHEN npafp_rate >= 0.4 AND spi_below_threshold THEN 'SPI below threshold only'
            WHEN npafp_rate < 0.4 AND NOT spi_below_threshold THEN 'NPAFP below target only' WHEN npafp_rate < 0.4 AND spi_below_threshold THEN 'Both below' END AS category FROM cmp0 c JOIN areas a ON a.district = c.district""",
    }


CMP = comparison()
_SHOWN = f"district, year, observed, {r('expected_total', 'spi_median', 'spi_q05', 'spi_q95', 'npafp_rate')}, npafp_adequate, spi_below_threshold, spi_pass, category"
SQL["compare_npafp"] = build(f"SELECT {_SHOWN} FROM cmp", "draws", extra=CMP)
SQL["compare_interval_rule"] = build(f"SELECT {_SHOWN} FROM cmp", "draws", extra=comparison(" AND spi_q95 < 1"))
SQL["compare_simple"] = build(
    """SELECT district, year, round(spi, 6) AS spi_median, round(npafp_rate, 6) AS npafp_rate, CASE WHEN npafp_rate >= 0.4 AND NOT spi < 1 THEN 'Neither below' WHEN npafp_rate >= 0.4 THEN 'SPI below threshold only' WHEN NOT spi < 1 THEN 'NPAFP below target only' ELSE 'Both below' END AS category
    FROM simple WHERE spi IS NOT NULL""", "simple"
)
SQL["compare_categories"] = build(
    """SELECT ord, l.category, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(category) FROM cmp), 6) AS pct FROM (VALUES (0, 'Neither below'), (1, 'SPI below threshold only'), (2, 'NPAFP below target only'), (3, 'Both below')) l(ord, category)
    LEFT JOIN (SELECT category, count(*) AS n FROM cmp GROUP BY 1) c ON c.category = l.category""", "draws", extra=CMP
)
SQL["compare_crosstab"] = build(
    """SELECT npafp_adequate, spi_pass, n, round_even(100.0 * n / sum(n) OVER (PARTITION BY npafp_adequate), 1) AS row_pct, round_even(100.0 * n / sum(n) OVER (PARTITION BY spi_pass), 1) AS col_pct, round_even(100.0 * n / sum(n) OVER (), 1) AS total_pct
    FROM (SELECT npafp_adequate, spi_pass, count(*) AS n FROM cmp WHERE category IS NOT NULL GROUP BY 1, 2)""", "draws", extra=CMP
)


def _metrics(by: str) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    log = "lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)"
    return f"""SELECT {key}a + b + c + d AS n, round(100.0 * (a + d) / (a + b + c + d), 6) AS pct_agreement, round(CASE WHEN abs(1 - pe) > 1e-12 THEN (po - pe) / (1 - pe) END, 6) AS cohens_kappa,
        round(CASE WHEN b + c = 0 THEN NULL WHEN b = c THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, CAST(least(b, c) AS BIGINT) + 1), lambda i: exp({log})))) END, 6) AS mcnemar_p, a AS n_neither, b AS n_spi_only, c AS n_npafp_only, d AS n_both
        FROM (SELECT *, (a + d) / (a + b + c + d) AS po, CAST((a + b) * (a + c) + (c + d) * (b + d) AS DOUBLE) / ((a + b + c + d) * (a + b + c + d)) AS pe FROM (SELECT {key}count(*) FILTER (npafp_adequate AND NOT spi_below_threshold) AS a, count(*) FILTER (npafp_adequate AND spi_below_threshold) AS b,
        count(*) FILTER (NOT npafp_adequate AND NOT spi_below_threshold) AS c, count(*) FILTER (NOT npafp_adequate AND spi_below_threshold) AS d FROM cmp {group}))"""


SQL["compare_metrics"] = build(_metrics(""), "draws", extra=CMP)
SQL["compare_by_stratum"] = build(_metrics("area"), "draws", extra=CMP)


def _bin(x: str, breaks: tuple[float, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN {i}" for i, b in enumerate(breaks)) + f" WHEN {x} IS NOT NULL THEN {len(breaks)} END"


SQL["map_bins"] = build(f"SELECT district, year, {_bin('npafp_rate', (1.0, 2.0, 3.0, 6.0, 12.0, 24.0))} AS npafp_bin, {_bin('spi_median', (0.5, 0.75, 1.0, 1.33, 2.0))} AS spi_bin, category FROM cmp WHERE year = 2000", "draws", extra=CMP)

# field guide
_TAIL = "list_sum(list_transform(range(0, observed + 1), lambda i: exp(i * ln(expected_total) - expected_total - lgamma(i + 1))))"
GUIDE = CMP | {
    "prev": "SELECT c.*, p.spi_median AS previous_spi, p.spi_median < 1 AS persistence_concern FROM cmp c LEFT JOIN cmp p ON p.district = c.district AND p.year = c.year - 1",
    "ext0": """SELECT *, count(*) OVER (PARTITION BY year, area) - 1 AS others, CAST(sum(CASE WHEN spi_median < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY year, area) AS BIGINT) - CASE WHEN spi_median < 1 THEN 1 ELSE 0 END AS others_below,
        100 * avg(CASE WHEN spi_median < 1 THEN 1.0 ELSE 0 END) OVER (PARTITION BY year) AS national_pct FROM prev""",
    "ext": "SELECT *, 100.0 * others_below / nullif(others, 0) AS extent_pct, 100.0 * others_below / nullif(others, 0) > national_pct AS extent_concern FROM ext0",
    "proc": "SELECT e.*, coalesce(n_cases, 0) AS n_cases, coalesce(n_adequate, 0) AS n_adequate, coalesce(n_transport, 0) AS n_transport, coalesce(n_transport_timely, 0) AS n_transport_timely FROM ext e LEFT JOIN process p ON p.district = e.district AND p.year = e.year",
    "pct": "SELECT *, 100.0 * n_transport_timely / nullif(n_transport, 0) AS pct_transport_timely, 100.0 * n_adequate / nullif(n_cases, 0) AS pct_adequate FROM proc",
    "verd": """SELECT *, spi_median < 1 AS spi_below, spi_q95 < 1 AS gate_pass, CASE WHEN spi_median < 1 AND spi_q95 < 1 AND (coalesce(extent_concern, FALSE) OR coalesce(persistence_concern, FALSE)) THEN 'Priority for review' WHEN spi_median < 1 THEN 'Monitor' ELSE 'No SPI indication' END AS verdict FROM pct""",
}
_ORDER = "CASE verdict WHEN 'Priority for review' THEN 1 WHEN 'Monitor' THEN 2 ELSE 3 END"


def guide(select: str, *more: str, extra: dict[str, str] | None = None) -> str:
    return build(select, "draws", "process", *more, extra=GUIDE | (extra or {}))


SQL["fg_strength"] = guide(
    f"""SELECT district, year, npafp_adequate AS conventional_pass, spi_median < 1 AS spi_below, {_TAIL} > 0.3 AS noise_plausible, spi_q95 < 1 AS cri_excludes_1, spi_q95 < 1 AND NOT {_TAIL} > 0.3 AS gate_pass,
    npafp_adequate AND spi_median < 1 AND spi_q95 < 1 AND NOT {_TAIL} > 0.3 AS s1_discordance FROM cmp"""
)
SQL["fg_noise_tail"] = guide(f"SELECT district, year, round({_TAIL}, 6) AS noise_tail FROM cmp")
SQL["fg_extent"] = guide(f"SELECT district, year, others, others_below, {r('extent_pct', 'national_pct')}, extent_concern FROM ext")
SQL["fg_process"] = guide(
    f"""SELECT district, year, n_cases, n_adequate, n_transport, n_transport_timely, {r('pct_transport_timely', 'pct_adequate')}, n_transport >= 60 AS transport_assessed, n_cases >= 60 AS adequacy_assessed,
    CASE WHEN n_transport >= 60 THEN pct_transport_timely < 50 END AS timeliness_concern, CASE WHEN n_cases >= 60 THEN pct_adequate < 50 END AS adequacy_concern FROM pct"""
)
SQL["fg_persistence"] = guide(f"SELECT district, year, {r('previous_spi')}, persistence_concern FROM prev")
SQL["fg_runs"] = guide(
    "SELECT district, year, trailing_run, max(trailing_run) OVER (PARTITION BY district ORDER BY year) AS longest_run FROM t",
    extra={"i": "SELECT district, year, spi_median < 1 AS b, sum(CASE WHEN spi_median < 1 THEN 0 ELSE 1 END) OVER (PARTITION BY district ORDER BY year) AS island FROM cmp", "t": "SELECT district, year, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY district, island ORDER BY year) AS INTEGER) AS trailing_run FROM i"},
)
SQL["fg_trajectory"] = guide(
    f"SELECT district, year, {r('slope')}, CASE WHEN slope IS NULL THEN NULL WHEN slope <= -0.01 THEN 'falling' WHEN slope >= 0.01 THEN 'rising' ELSE 'flat' END AS trajectory FROM t",
    extra={"t": "SELECT district, year, CASE WHEN count(*) OVER w >= 2 THEN regr_slope(spi_median, year) OVER w END AS slope FROM cmp WINDOW w AS (PARTITION BY district ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)"},
)
SQL["labelled_years"] = build("SELECT adm1_name, adm2_name, district, year, round(observed, 6) AS observed, round(pop, 6) AS pop FROM annual JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS d, CAST(n_regionkey AS VARCHAR) AS adm1_name, n_name AS adm2_name FROM nation) ON d = district", "annual")
SQL["closed_panel"] = build("SELECT district, month, count(*) AS count FROM ord GROUP BY 1, 2", "ord")
#: p of a slope in closed form: a trend of five years leaves one to three degrees of freedom.
SQL["trajectory_pvalue"] = guide(
    "SELECT district, year, round(p, 6) AS slope_p, CASE WHEN slope IS NULL THEN NULL WHEN slope <= -0.01 AND coalesce(p < 0.1, FALSE) THEN 'falling' WHEN slope >= 0.01 AND coalesce(p < 0.1, FALSE) THEN 'rising' ELSE 'flat' END AS trajectory FROM p",
    extra={
        "s": "SELECT district, year, count(spi_median) OVER w AS n, regr_sxx(spi_median, year) OVER w AS sxx, regr_syy(spi_median, year) OVER w AS syy, regr_sxy(spi_median, year) OVER w AS sxy FROM cmp WINDOW w AS (PARTITION BY district ORDER BY year RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)",
        "u": "SELECT district, year, n, syy, CASE WHEN n >= 2 AND sxx > 0 THEN sxy / sxx END AS slope, greatest(syy - sxy * sxy / nullif(sxx, 0), 0) AS rest, sxx FROM s",
        "v": "SELECT *, CASE WHEN n >= 3 AND rest > 1e-14 * syy THEN abs(slope) / sqrt(rest / (n - 2) / sxx) END AS t FROM u",
        "p": "SELECT district, year, slope, CASE WHEN n < 3 OR slope IS NULL THEN NULL WHEN t IS NULL THEN 0.0 WHEN n = 3 THEN 1 - 2 / pi() * atan(t) WHEN n = 4 THEN 1 - t / sqrt(2 + t * t) ELSE 1 - 2 / pi() * (atan(t / sqrt(3)) + t / sqrt(3) / (1 + t * t / 3)) END AS p FROM v",
    },
)
SQL["plot_funnel"] = build(
    "SELECT district, year, round(expected_total, 6) AS expected_total, round(expected_total * (1 + 0.1 * (CAST('0x' || substr(md5('1|' || district || '|' || year), 1, 6) AS BIGINT) / 16777216.0 - 0.5)), 6) AS expected_jittered, round(spi_median, 6) AS spi_median, npafp_adequate FROM cmp WHERE expected_total > 0", "draws", extra=CMP
)
SQL["fg_neighbour"] = guide(
    f"SELECT district, year, {r('neighbour_spi')}, district NOT IN (SELECT focal FROM rook) AS island, coalesce(neighbour_spi >= 1 AND spi_median < 1, FALSE) AS neighbour_discordant, coalesce(neighbour_spi < 1 AND spi_median < 1, FALSE) AS neighbourhood_shortfall FROM n",
    "rook", extra={"n": "SELECT c.*, neighbour_spi FROM cmp c LEFT JOIN (SELECT focal, year AS y, median(spi_median) AS neighbour_spi FROM rook JOIN cmp ON neighbour = district GROUP BY 1, 2) m ON m.focal = c.district AND m.y = c.year"},
)
SQL["fg_seasonal"] = build(
    """SELECT district, year, CASE WHEN sum(expected_total) = 0 THEN 'not assessed' WHEN coalesce(sum(observed) FILTER (peak), 0) = 0 THEN 'blind' WHEN sum(observed) FILTER (peak) / sum(expected_total) FILTER (peak) < 0.5 THEN 'muted' ELSE 'present' END AS seasonal FROM p GROUP BY 1, 2""",
    "draws",
    extra=index_ctes("month")
    | {
        "m": "SELECT unit AS district, CAST(year(period) AS INTEGER) AS year, CASE WHEN unit = '3' THEN 0 WHEN unit = '4' THEN observed // 4 ELSE observed END AS observed, expected_total FROM idx",
        "p": "SELECT m.*, expected_total >= cut AS peak FROM m JOIN (SELECT district AS d, year AS y, quantile_cont(expected_total, 2.0 / 3) AS cut FROM m GROUP BY 1, 2) ON d = district AND y = year",
    },
)


def _detected(rows: str, types: str) -> str:
    return guide(
        f"""SELECT district, year, coalesce(ys, '') AS {{n}}_years, ys IS NOT NULL AS {{n}}_flag, {types} AS {{n}}_serotypes FROM cmp
        LEFT JOIN (SELECT c.district AS d, c.year AS y, string_agg(DISTINCT CAST(det.year AS VARCHAR), ', ' ORDER BY CAST(det.year AS VARCHAR)) AS ys, string_agg(DISTINCT serotype, ', ' ORDER BY serotype) AS ts FROM cmp c JOIN det ON det.district = c.district AND det.year <= c.year GROUP BY 1, 2) ON d = district AND y = year""",
        extra={"det": rows},
    )


_RARE = "l_returnflag = 'R' AND l_quantity >= 50 AND l_discount >= 0.1"
SQL["fg_detections"] = _detected(f"SELECT DISTINCT district, CAST(year(day) AS INTEGER) AS year, p_type AS serotype FROM lineitem JOIN part ON l_partkey = p_partkey JOIN ord ON l_orderkey = orderkey WHERE {_RARE}", "coalesce(ts, '')").replace("{n}", "afp")
SQL["fg_es"] = _detected(f"SELECT DISTINCT CAST(s_nationkey AS VARCHAR) AS district, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(NULL AS VARCHAR) AS serotype FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE {_RARE}", "ts").replace("{n}", "es")
SQL["fg_verdict"] = guide(f"SELECT district, year, verdict, {_ORDER} AS verdict_order FROM verd")
SQL["fg_verdict_counts"] = guide(
    "SELECT verdict_order, l.verdict, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT count(*) FROM verd WHERE year = 2000), 6) AS pct FROM (VALUES (1, 'Priority for review'), (2, 'Monitor'), (3, 'No SPI indication')) l(verdict_order, verdict) LEFT JOIN (SELECT verdict, count(*) AS n FROM verd WHERE year = 2000 GROUP BY 1) v ON v.verdict = l.verdict"
)
SQL["fg_concerns"] = guide(
    "SELECT count(*) AS n_below, count(*) FILTER (n_transport >= 5 AND pct_transport_timely < 80) AS timeliness, count(*) FILTER (extent_concern) AS extent, count(*) FILTER (persistence_concern) AS persistence, count(*) FILTER (n_cases >= 5 AND pct_adequate < 80) AS adequacy FROM verd WHERE year = 2000 AND spi_median < 1"
)
SQL["fg_scan"] = guide(
    f"""SELECT district, observed AS obs, round_even(expected_total, 1) AS exp, round_even(spi_median, 2) AS spi, round_even(npafp_rate, 1) AS npafp, extent_concern AS extent, persistence_concern AS persist, round_even(pct_transport_timely, 0) AS transport, round_even(pct_adequate, 0) AS adequacy, verdict, {_ORDER} AS verdict_order FROM verd WHERE year = 2000"""
)
_BOTH = "(coalesce(extent_concern, FALSE) AND coalesce(persistence_concern, FALSE))"
SQL["fg_worked"] = guide(
    "SELECT 1 AS example, district FROM w1 UNION ALL SELECT 2, district FROM w2 UNION ALL SELECT 3, district FROM w3 UNION ALL SELECT 4, district FROM w4",
    extra={
        "f": "SELECT * FROM verd WHERE year = 2000",
        "w1": "SELECT district FROM f WHERE verdict = 'No SPI indication' ORDER BY NOT npafp_adequate, CASE WHEN npafp_adequate THEN -expected_total ELSE -spi_median END, district LIMIT 1",
        "w2": f"SELECT district FROM f WHERE spi_below AND spi_q95 >= 1 AND district NOT IN (FROM w1) ORDER BY NOT {_BOTH}, spi_median, district LIMIT 1",
        "w3": f"SELECT district FROM f WHERE verdict = 'Priority for review' AND {_BOTH} AND npafp_adequate AND district NOT IN (FROM w1 UNION ALL FROM w2) ORDER BY spi_median, district LIMIT 1",
        "w4": "SELECT district FROM f WHERE spi_below AND gate_pass AND persistence_concern AND NOT coalesce(extent_concern, FALSE) AND district NOT IN (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3) ORDER BY spi_median, district LIMIT 1",
    },
)

# graph
SQL["adjacency_queen"] = build("SELECT focal, neighbour FROM queen", "queen")
SQL["adjacency_rook"] = build("SELECT focal, neighbour FROM rook", "rook")
_FAR = "SELECT CAST(n_nationkey AS VARCHAR) AS district, seq, n_nationkey % 5 + dx + CASE WHEN n_nationkey >= 23 THEN 100.0 * (n_nationkey - 22) ELSE 0 END AS x, n_nationkey // 5 + dy + CASE WHEN n_nationkey >= 23 THEN 100.0 * (n_nationkey - 22) ELSE 0 END AS y FROM nation, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(seq, dx, dy)"
_NEAREST = "SELECT focal, arg_min(neighbour, struct_pack(d := d, n := neighbour)) AS neighbour FROM (SELECT a.district AS focal, b.district AS neighbour, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM mid a, mid b WHERE a.district <> b.district AND a.district NOT IN (SELECT focal FROM queen)) GROUP BY 1"
SQL["check_findings"] = build(
    """SELECT 'error' AS severity, 'cases_negative' AS code, district AS id, count(*) AS n FROM ord WHERE orderkey % 97 = 0 GROUP BY district
    UNION ALL SELECT 'error', 'cases_invalid_count', district, count(*) FROM ord WHERE orderkey % 97 <> 0 AND orderkey % 89 = 0 GROUP BY district
    UNION ALL SELECT 'warning', 'pop_zero', district, count(*) FROM ord WHERE orderkey % 83 = 0 GROUP BY district
    UNION ALL SELECT 'error', 'pop_negative', district, count(*) FROM ord WHERE orderkey % 83 <> 0 AND orderkey % 79 = 0 GROUP BY district
    UNION ALL SELECT 'error', 'cases_duplicates', district, count(*) FROM (SELECT district, day FROM ord GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY district""",
    "ord",
)
SQL["adjacency_snap_queen"] = build("SELECT focal, neighbour FROM snapped", "snapped")
SQL["adjacency_snap_rook"] = build("SELECT focal, neighbour FROM snapped WHERE n >= 2", "snapped")
SQL["adjacency_islands"] = build(
    "SELECT focal, neighbour FROM queen UNION SELECT focal, neighbour FROM near UNION SELECT neighbour, focal FROM near", "queen", replace={"verts": _FAR},
    extra={"mid": "SELECT district, avg(x) FILTER (seq < 4) AS x, avg(y) FILTER (seq < 4) AS y FROM verts GROUP BY 1", "near": _NEAREST},
)
SQL["adjacency_nearest"] = build(
    """SELECT * FROM (SELECT focal, neighbour FROM links UNION SELECT neighbour, focal FROM links) l ANTI JOIN snapped USING (focal, neighbour)""",
    "snapped",
    replace={"parcels": PARCELS.replace("OFF", "(CASE WHEN k % 7 = 0 THEN 3 * k + 0.001 * k * k + 200 ELSE 0 END)")},
    extra={
        "middles": "SELECT district, avg(x) FILTER (seq < 4) AS cx, avg(y) FILTER (seq < 4) AS cy FROM parcels GROUP BY 1",
        "far": "SELECT district FROM middles WHERE district NOT IN (SELECT focal FROM snapped)",
        "links": "SELECT a.district AS focal, min_by(b.district, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 7)) AS neighbour FROM middles a JOIN far USING (district) JOIN middles b ON a.district <> b.district GROUP BY 1",
    },
)
SQL["province_areas"] = """
WITH s AS (SELECT c_custkey AS k, c_custkey % 40 AS x, c_custkey // 40 AS y, CASE WHEN c_custkey % 11 = 0 THEN 'holes' ELSE (c_custkey % 40 // 7) || '-' || (c_custkey // 200) END AS province FROM customer),
sides AS (SELECT s.*, t.province AS beside FROM (SELECT s.*, dx, dy FROM s, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)) s LEFT JOIN s t ON t.x = s.x + dx AND t.y = s.y + dy),
cells AS (SELECT k, province, count(*) FILTER (beside IS DISTINCT FROM province) AS out FROM sides GROUP BY 1, 2),
gaps AS (
  SELECT province, count(*) AS hole_area FROM (
    SELECT s.k, min(t.province) AS province FROM s JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) ON true JOIN s t ON t.x = s.x + dx AND t.y = s.y + dy AND t.province <> s.province
    WHERE s.province = 'holes' GROUP BY s.k HAVING count(*) = 4 AND count(DISTINCT t.province) = 1) GROUP BY 1
)
SELECT province, CAST(count(*) AS DOUBLE) AS area, CAST(sum(out) AS DOUBLE) AS length, CAST(coalesce(max(hole_area), 0) AS DOUBLE) AS hole_area FROM cells LEFT JOIN gaps USING (province) GROUP BY 1"""
SQL["geometry_faults"] = """
WITH placed(kind, part, ring, px, py, side) AS (SELECT k, 0, 0, 0.0, 0.0, 1.0 FROM range(9) r(k) UNION ALL VALUES (2, 0, 1, 5.0, 5.0, 0.25), (3, 0, 1, 0.25, 0.25, 0.5), (4, 1, 0, 0.25, 0.25, 0.5), (6, 1, 0, 0.5, 0.5, 1.0), (7, 0, 1, 0.2, 0.2, 0.6), (7, 1, 0, 0.4, 0.4, 0.2), (8, 0, 1, 0.2, 0.2, 0.6), (8, 0, 2, 0.4, 0.4, 0.2)),
v AS (
  SELECT CAST(c_custkey AS VARCHAR) AS district, part, ring, CASE WHEN kind = 1 AND seq IN (1, 2) THEN 3 - seq ELSE seq END AS seq, CAST(c_custkey % 40 + px + dx * side AS DOUBLE) AS x, CAST(c_custkey // 40 + py + dy * side AS DOUBLE) AS y
  FROM customer JOIN placed ON c_custkey % 9 = kind, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) c(seq, dx, dy) WHERE kind <> 5 OR seq < 4
),
rings AS (SELECT district, part, ring, count(*) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, arg_min(x, seq) = arg_max(x, seq) AND arg_min(y, seq) = arg_max(y, seq) AS closed FROM v GROUP BY ALL),
s AS (SELECT a.*, b.x AS u, b.y AS w FROM v a JOIN v b ON b.district = a.district AND b.part = a.part AND b.ring = a.ring AND b.seq = a.seq + 1 JOIN rings r ON r.district = a.district AND r.part = a.part AND r.ring = a.ring AND closed),
t AS (
  SELECT p.district, p.part = q.part AND p.ring = q.ring AS one, abs(p.seq - q.seq) AS gap,
    sign((p.u - p.x) * (q.y - p.y) - (p.w - p.y) * (q.x - p.x)) * sign((p.u - p.x) * (q.w - p.y) - (p.w - p.y) * (q.u - p.x)) AS s12,
    sign((q.u - q.x) * (p.y - q.y) - (q.w - q.y) * (p.x - q.x)) * sign((q.u - q.x) * (p.w - q.y) - (q.w - q.y) * (p.u - q.x)) AS s34
  FROM s p JOIN s q ON p.district = q.district AND (p.part, p.ring, p.seq) < (q.part, q.ring, q.seq)
    AND greatest(least(p.x, p.u), least(q.x, q.u)) <= least(greatest(p.x, p.u), greatest(q.x, q.u)) AND greatest(least(p.y, p.w), least(q.y, q.w)) <= least(greatest(p.y, p.w), greatest(q.y, q.w))
),
pairs AS (SELECT a.district, a.part, a.ring, b.part AS bp, b.ring AS br, b.x1 < a.x1 AND a.x2 < b.x2 AND b.y1 < a.y1 AND a.y2 < b.y2 AS within FROM rings a JOIN rings b ON a.district = b.district AND (a.part <> b.part OR a.ring <> b.ring))
SELECT district, 'open' AS fault FROM rings WHERE NOT closed
UNION SELECT district, 'crossing' FROM t WHERE CASE WHEN one THEN gap NOT IN (1, 3) AND s12 <= 0 AND s34 <= 0 ELSE s12 < 0 AND s34 < 0 END
UNION SELECT district, 'hole outside' FROM pairs WHERE ring > 0 AND br = 0 AND part = bp AND NOT within
UNION SELECT district, 'nested holes' FROM pairs WHERE ring > 0 AND br > 0 AND part = bp AND within
UNION SELECT district, 'nested parts' FROM pairs WHERE ring = 0 AND part <> bp AND within GROUP BY district, part, bp HAVING count(*) FILTER (br = 0) = 1 AND count(*) FILTER (br > 0) = 0"""
SQL["adjacency_degree"] = build("SELECT district, count(neighbour) AS degree FROM (SELECT DISTINCT district FROM verts) LEFT JOIN queen ON focal = district GROUP BY 1", "queen")
SQL["adjacency_components"] = build(
    "SELECT a AS district, min(b) AS component FROM reach GROUP BY 1", "queen", replace={"verts": _FAR}, extra={"reach": "SELECT DISTINCT district AS a, district AS b FROM verts UNION SELECT a, neighbour FROM reach JOIN queen ON focal = b"}
).replace("WITH ", "WITH RECURSIVE ", 1)
SQL["adjacency_summary"] = build("SELECT count(*) AS regions, CAST(sum(d) AS BIGINT) AS links, round(100.0 * sum(d) / (count(*) * count(*)), 6) AS pct_nonzero, round(sum(d) / count(*), 6) AS mean_links, count(*) FILTER (d = 0) AS islands FROM (SELECT district, count(neighbour) AS d FROM (SELECT DISTINCT district FROM verts) LEFT JOIN queen ON focal = district GROUP BY 1)", "queen")
SQL["centroids"] = build("SELECT district, round(avg(x) FILTER (seq < 4), 6) AS cx, round(avg(y) FILTER (seq < 4), 6) AS cy FROM verts GROUP BY 1", "verts")
SQL["province_outline"] = build(
    "SELECT province, CAST(a.x AS DOUBLE) AS x1, CAST(a.y AS DOUBLE) AS y1, CAST(b.x AS DOUBLE) AS x2, CAST(b.y AS DOUBLE) AS y2 FROM seg GROUP BY province, a, b HAVING count(*) = 1", "verts", "areas",
    extra={"seg": "SELECT area AS province, least(struct_pack(x := p.x, y := p.y), struct_pack(x := q.x, y := q.y)) AS a, greatest(struct_pack(x := p.x, y := p.y), struct_pack(x := q.x, y := q.y)) AS b FROM verts p JOIN verts q ON q.district = p.district AND q.seq = p.seq + 1 JOIN areas s ON s.district = p.district"},
)

# plot data
SQL["plot_histogram"] = build(
    "SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, count(*) AS n FROM (SELECT CAST(least(floor((v - lo) / w), 9) AS INTEGER) AS bin, lo, w FROM logs, (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w FROM logs)) GROUP BY bin, lo, w",
    "draws", extra=index_ctes(YEAR) | {"logs": "SELECT log10(spi_median) AS v FROM idx WHERE spi_median > 0"},
)
SQL["plot_caterpillar"] = build(
    f"SELECT district, {r('spi_median', 'spi_q05', 'spi_q95')}, side FROM (SELECT *, 'low' AS side FROM low UNION ALL SELECT *, 'high' AS side FROM high WHERE district NOT IN (SELECT district FROM low))", "draws",
    extra=index_ctes(YEAR) | {"y": "SELECT unit AS district, spi_median, spi_q05, spi_q95 FROM idx WHERE period = 2000", "low": "FROM y ORDER BY spi_median, district LIMIT 5", "high": "FROM y ORDER BY spi_median DESC, district LIMIT 5"},
)
SQL["plot_calibration"] = build(f"SELECT unit, period, {r('expected_total')}, observed FROM idx WHERE observed > 0", "draws", extra=index_ctes(YEAR))
SQL["pit_ks"] = build("SELECT max(n) AS n, round(max(greatest(i / n - x, x - (i - 1) / n)), 6) AS pit_ks FROM (SELECT dayofyear(day) / 366 AS x, row_number() OVER (ORDER BY dayofyear(day)) AS i, count(*) OVER () AS n FROM ord)", "ord")
SQL["assessment_windows"] = build(
    """SELECT target, min(month) AS training_start, CAST(make_date(target, 1, 1) AS DATE) AS opens, max(month) AS closes, count(*) FILTER (year(month) < target) AS known, count(*) FILTER (year(month) = target) AS hidden
    FROM panel, (SELECT unnest([1998, 1999, 2000, 2001]) AS target) WHERE year(month) <= target GROUP BY target""", "panel"
)
