"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong spans (kinds assign, access, hex) stand alone. Weak candidates (kinds token, user,
endpoint) are reported only where a complementary part lies within ``REACH`` characters in the
same text: an identifier or endpoint next to a secret, or a secret next to an identifier or
endpoint. The interval join of weak and complementary spans runs inside a text's row, its scope, so that no
text is shuffled and no pair leaves it: the spans of each kind are sorted and do not overlap, so the
nearest part of a kind is found by bisection. Positions are prefix sums in chunks. The work of a text
grows with its length and with matches x log(matches).

Positions are code points, the end exclusive; a span is the whole match.

Defined cases: a null or empty text has no spans; repeated rows each get theirs; ``with_spans``
keeps all columns and replaces one of its own name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from survperf.llm.common import at_most, let, running

REACH = 200
KINDS = ("assign", "access", "hex", "token", "user", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "token": "secret", "user": "id", "endpoint": "endpoint"}

#: The patterns of the strong kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # of a maximal run, as AKIA[A-Z0-9]+ of 20 characters or more
HEX = "[0-9a-f]{24,}"
#: Weak kinds: a long token of mixed characters, a named account, an address.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}"
USER = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]{4,}"""

SPAN = "array<struct<start:int,ord:int,end:int>>"
#: Code points of a block of a text that is being redacted.
BLOCK = 4096


def _found(text: Column, pattern: str, kind: str, keep: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches, by start; ``keep``: array of flags, in their order."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # the last gap has no match after it
    widths = F.arrays_zip(F.transform(gaps, F.length).alias("g"), F.transform(matches, F.length).alias("m"))
    order = F.lit(KINDS.index(kind))

    def placed(w: Column) -> Column:
        before = running(F.transform(w, lambda x: x["g"] + F.coalesce(x["m"], F.lit(0))), lambda acc, x: acc + x, F.lit(0))
        spans = F.zip_with(before, w, lambda at, x: F.struct((at + x["g"]).alias("start"), order.alias("ord"), (at + x["g"] + x["m"]).alias("end")))
        return F.filter(spans, lambda s: s["end"].isNotNull())

    spans = let(widths, placed)
    return spans if keep is None else let(keep, lambda kept: F.filter(spans, lambda s, i: F.get(kept, i)))


def strong(text: Column) -> dict[str, Column]:
    """Arrays of (start, ord, end) of each strong kind, by start; ``ord`` is the place in ``KINDS``."""
    none = F.array().cast(SPAN)
    low = F.lower(text)
    may = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        may = may | low.contains(word)
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 6)
    return {
        "assign": F.when(may, _found(text, ASSIGN, "assign", long_enough)).otherwise(none),
        "access": F.when(text.contains("AKIA"), _found(text, ACCESS, "access")).otherwise(none),
        "hex": F.when(text.rlike(HEX), _found(text, HEX, "hex")).otherwise(none),
    }


def weak(text: Column) -> dict[str, Column]:
    """Arrays of (start, ord, end) of each weak kind, by start, before linking."""
    none = F.array().cast(SPAN)
    return {
        "token": F.when(text.rlike(TOKEN), _found(text, TOKEN, "token")).otherwise(none),
        "user": F.when(text.rlike(USER), _found(text, USER, "user")).otherwise(none),
        "endpoint": F.when(text.contains("://"), _found(text, ENDPOINT, "endpoint")).otherwise(none),
    }


def _last(kind: Column, starts: Column, limit: Column) -> Column:
    """The last span of one kind that starts at ``limit`` or before; spans of a kind do not overlap, so it also ends last."""
    return F.get(kind, at_most(starts, limit) - 1)


def _starts(spans: dict[str, Column]) -> Column:
    return F.struct(*[F.transform(v, lambda s: s["start"]).alias(k) for k, v in spans.items()])


def linked(firm: dict[str, Column], loose: dict[str, Column], reach: int = REACH) -> Column:
    """The weak spans near a complementary part, less those inside a strong span: an interval join by bisection of sorted spans.

    ``firm`` and ``loose`` have the spans of the strong and weak kinds as fields of lambda variables.
    """

    def covered(starts: Column, w: Column) -> Column:
        inside = F.lit(False)
        for k, spans in firm.items():
            inside = inside | F.coalesce(_last(spans, starts[k], w["start"])["end"] >= w["end"], F.lit(False))
        return inside

    def near(parts: dict[str, Column], starts: Column, kind: str) -> Callable[[Column], Column]:
        def test(w: Column) -> Column:
            found = F.lit(False)
            for k, spans in parts.items():
                if (ROLE[k] == "secret") != (ROLE[kind] == "secret"):
                    found = found | F.coalesce(_last(spans, starts[k], w["end"] + reach)["end"] >= w["start"] - reach, F.lit(False))
            return found

        return test

    def join(free: Column) -> Column:
        parts = firm | {k: free[k] for k in loose}
        return let(_starts(parts), lambda starts: F.concat(*[F.filter(parts[k], near(parts, starts, k)) for k in loose]))

    return let(_starts(firm), lambda starts: let(F.struct(*[F.filter(v, lambda w: ~covered(starts, w)).alias(k) for k, v in loose.items()]), join))


def spans_of(text: Column, reach: int = REACH) -> Column:
    """Sorted array of (start, ord, end, kind) of the secrets of ``text``, which is not null."""
    names = F.array(*map(F.lit, KINDS))
    none = F.array().cast(SPAN)

    def both(firm: Column) -> Column:
        known = {k: firm[k] for k in KINDS[:3]}
        may = (F.size(firm["assign"]) + F.size(firm["access"]) + F.size(firm["hex"]) > 0) | text.contains("://") | text.rlike(TOKEN)
        found = let(F.struct(*[v.alias(k) for k, v in weak(text).items()]), lambda loose: F.when(F.size(loose["token"]) + F.size(loose["user"]) + F.size(loose["endpoint"]) > 0, linked(known, {k: loose[k] for k in KINDS[3:]}, reach)).otherwise(none))
        return F.sort_array(F.concat(*known.values(), F.when(may, found).otherwise(none)))

    spans = let(F.struct(*[v.alias(k) for k, v in strong(text).items()]), both)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), F.get(names, s["ord"]).alias("kind")))


def with_spans(df: DataFrame, text_col: str = "text", out_col: str = "secret_spans", reach: int = REACH) -> DataFrame:
    """``df`` with its secrets: array of (start, ord, end, kind) by start, then kind as listed."""
    kept = [F.col(c) for c in df.columns if c != out_col]
    return df.select(*kept, spans_of(F.coalesce(F.col(text_col), F.lit("")), reach).alias(out_col))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[REDACTED]", reach: int = REACH) -> DataFrame:
    """``df`` with each run of secret spans replaced by ``mark``; endpoints and accounts stay."""
    text = F.col(text_col)

    def clean(hidden: Column, blocks: Column) -> Column:
        # where the spans before each one end
        ends = running(F.transform(hidden, lambda s: s["end"]), lambda acc, x: F.greatest(acc, x), F.lit(0))
        kept = F.zip_with(ends, hidden, lambda at, s: F.when(s["start"] >= at, F.concat(_between(blocks, at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.aggregate(hidden, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
        return F.concat(F.array_join(kept, ""), _between(blocks, last, F.length(text)))

    def changed(hidden: Column) -> Column:
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return F.when(F.size(hidden) == 0, text).otherwise(let(blocks, lambda b: clean(hidden, b)))

    hidden = F.filter(spans_of(F.coalesce(text, F.lit("")), reach), lambda s: s["kind"].isin("assign", "access", "hex", "token"))
    return df.withColumn(text_col, let(hidden, changed))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text given in blocks, so that no part is looked for from its beginning."""
    some = F.sequence(F.floor(start / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
    parts = F.transform(some, lambda k: F.get(blocks, k).substr(F.greatest(start - k * BLOCK, F.lit(0)) + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - F.greatest(start - k * BLOCK, F.lit(0))))
    return F.when(start < end, F.array_join(parts, "")).otherwise(F.lit(""))
