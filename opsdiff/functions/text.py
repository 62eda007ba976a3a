"""String and formatting functions as Column expressions."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): \s stands for white space in the Unicode sense, here spelled out for trimming.
BLANKS = (
    " \t\n\v\f\r\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
METRIC_NAME = r"^[A-Za-z][A-Za-z0-9._]*\z"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def words(s: Column) -> Column:
    """Words of a line, as an array."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def word(ws: Column, position: int) -> Column:
    """Word at a zero-based position; NULL when there are fewer."""
    return F.get(ws, position)


def clean_lines(text: Column) -> Column:
    """Lines of a text, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")


def proc_name(instance: Column) -> Column:
    """Command name in an instance such as ``1234 /usr/sbin/nginx``; '' when there is none."""
    text = strip(instance)
    is_number = text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()
    second = r"(?U)^\S+\s+(?:\S*/)?(\S*)"
    return (
        F.when(text.rlike(r"(?U)\s"), F.regexp_extract(text, second, 1))
        .when(is_number, "")
        .otherwise(text)
    )


def bracketed(name: Column, instance: Column) -> Column:
    """``name`` or ``name[instance]``."""
    return F.when(instance != "", F.concat(name, F.lit("["), instance, F.lit("]"))).otherwise(name)


def fixed(x: Column, digits: int) -> Column:
    """Decimal text rounded on the exact binary value, ties to even."""
    return F.translate(F.format_number(x, digits), ",", "")


def fixed_half_up(x: Column, digits: int) -> Column:
    """As ``fixed``, but exact ties go away from zero (the browser's convention)."""
    scaled = F.abs(x) * float(2 ** (digits + 1))
    exact_tie = (scaled % 2.0) == 1.0
    text = F.when(exact_tie, F.format_string(f"%.{digits}f", x)).otherwise(fixed(x, digits))
    return F.when(x == 0, fixed(F.abs(x), digits)).otherwise(text)


def signed(text: Column) -> Column:
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def evidence_line(metric: Column, instance: Column, a: Column, b: Column, delta: Column) -> Column:
    """One piece of evidence: the metric with its change, or ``(new)`` / ``(gone)``."""
    name = bracketed(metric, instance)
    return (
        F.when(delta.isNotNull(), F.concat(name, F.lit(" Δ"), signed(fixed(delta, 1)), F.lit("%")))
        .when(a.isNull() & b.isNotNull(), F.concat(name, F.lit(" (new)")))
        .when(b.isNull(), F.concat(name, F.lit(" (gone)")))
        .otherwise(name)
    )


def headline(label: Column, instance: Column, a: Column, b: Column, delta: Column) -> Column:
    """One-line conclusion of a triage block; percentages are cut, not rounded."""
    size = F.when(F.abs(delta) > 999, "spike").otherwise(
        F.concat(delta.try_cast("int").cast("string"), F.lit("%"))
    )
    tail = (
        F.when(delta.isNotNull(), F.concat(F.when(delta < 0, "").otherwise("+"), size))
        .when(a.isNull() & b.isNotNull(), "appeared")
        .otherwise("anomaly")
    )
    return F.concat(bracketed(label, instance), F.lit(" "), tail)


def _scaled(x: Column, fmt, rest: Column) -> Column:
    size = F.abs(x)
    return (
        F.when(x.isNull(), "—")
        .when(size >= 1e9, F.concat(fmt(x / 1e9, 2), F.lit("G")))
        .when(size >= 1e6, F.concat(fmt(x / 1e6, 2), F.lit("M")))
        .when(size >= 1e4, F.concat(fmt(x / 1e3, 2), F.lit("k")))
        .when(size == 0, "0")
        .otherwise(rest)
    )


def fmt_val(x: Column) -> Column:
    """Value in a text report: two decimals, G / M / k from 1e9 / 1e6 / 1e4."""
    return _scaled(x, fixed, fixed(x, 2))


# Doubles below this have so few bits that their shortest form has less than three exact digits.
_COARSE, _LEAST = 4e-320, 5e-324


def _three_digits(size: Column, half_up: bool) -> Column:
    """A size between 0 and 1 with three significant digits, exponential below 1e-6.

    Rounded on the exact binary value, exact ties up or to even.  The shortest form's exponent says how
    many places that takes; a number rounded up to the next power of ten has one digit more.
    """
    # A coarse size is a multiple of the least double, 4.94...e-324: that multiple of 4.94...e-3 is as good as exact.
    coarse = size < _COARSE
    size = F.when(coarse, size / F.lit(_LEAST) * 0.004940656458412465).otherwise(size)
    shift = F.when(coarse, -321).otherwise(0)
    floor = F.substring_index(F.format_string("%.17e", size), "e", -1).try_cast("int")
    places = 2 - floor
    plain = F.regexp_replace(F.call_function("format_number", size, places), r"^0\.0*|\.", "")
    number = F.struct(F.substring(plain, 1, 3).alias("digits"), (floor + F.length(plain) - 3).alias("exponent"))
    if half_up:
        up = F.format_string("%.2e", size)
        tie = F.struct(
            F.regexp_replace(F.substring_index(up, "e", 1), r"\.", "").alias("digits"),
            F.substring_index(up, "e", -1).try_cast("int").alias("exponent"),
        )
        number = F.when((size * F.pow(F.lit(2.0), places + 1)) % 2.0 == 1.0, tie).otherwise(number)
    digits, exponent = number["digits"], number["exponent"] + shift
    point = F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 2))
    return (
        F.when(exponent < -6, F.concat(point, F.lit("e"), exponent))
        .when(exponent >= 0, point)
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
    )


def fmt_num(x: Column, half_up: bool = True) -> Column:
    """Value on screen: one decimal from 100, two from 1, three significant digits below.

    Exact ties go away from zero as in the browser or, as in SQL's printf, to even.
    """
    size, fmt = F.abs(x), fixed_half_up if half_up else fixed
    rest = (
        F.when(size >= 100, fmt(x, 1))
        .when(size >= 1, fmt(x, 2))
        .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), _three_digits(size, half_up)))
    )
    return _scaled(x, fmt, rest)


def delta_text(kind: Column, delta: Column) -> Column:
    """Change in a report cell; ``kind`` is the row kind or the process verdict."""
    return (
        F.when(kind.isin("new", "appeared"), "⊕")
        .when(kind == "gone", "⊖")
        .when(delta.isNull(), "∞")
        .otherwise(F.concat(signed(fixed(delta, 1)), F.lit("%")))
    )


def ago_text(ms: Column) -> Column:
    """Age in whole minutes, hours or days."""
    ms = ms.cast("bigint")

    def unit(size_ms: int, name: str) -> Column:
        return F.concat(F.floor(ms / size_ms).cast("string"), F.lit(f"{name} ago"))

    return (
        F.when(ms < 60_000, "just now")
        .when(ms < 3_600_000, unit(60_000, "m"))
        .when(ms < 86_400_000, unit(3_600_000, "h"))
        .otherwise(unit(86_400_000, "d"))
    )


def md_escape(s: Column) -> Column:
    """Table cell for Markdown: over 60 bytes the first 57 and '...', no pipes or backticks."""
    head = F.make_valid_utf8(F.substring(s.cast("binary"), 1, 57).cast("string"))
    short = F.when(F.octet_length(s) > 60, F.concat(head, F.lit("..."))).otherwise(s)
    return F.translate(short, "|`", "  ")


def hash12(content: Column) -> Column:
    """First 12 bytes of the SHA-256 of a content, in hex."""
    return F.substring(F.sha2(content, 256), 1, 24)


def first_quoted(s: Column) -> Column:
    """Text between the first two double quotes, '' without a pair."""
    return F.regexp_extract(s, '"([^"]*)"', 1)


def valid_metric(s: Column) -> Column:
    return F.coalesce(s.rlike(METRIC_NAME), F.lit(False))


def parse_when(s: Column) -> Column:
    """Local time with or without seconds, 'T' or blank between; NULL when malformed."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\z"
    return F.when(s.rlike(shape), s.try_cast("timestamp_ntz"))


_DURATION_SECONDS = {
    "ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0,
}
_DURATION_PART = r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h)"


def parse_duration(text: str) -> timedelta:
    """``24h``, ``1h30m``, ``0.5h``: a positive duration, else ValueError."""
    if not re.fullmatch(rf"\+?({_DURATION_PART})+", text):
        raise ValueError(f"not a positive duration such as 24h: {text!r}")
    parts = re.findall(_DURATION_PART, text)
    span = timedelta(seconds=sum(float(n) * _DURATION_SECONDS[unit] for n, unit in parts))
    if span <= timedelta(0):
        raise ValueError(f"a duration must be positive: {text!r}")
    return span


def duration_seconds(s: Column) -> Column:
    """Column form of parse_duration, in seconds; NULL when malformed or not positive."""
    factor = F.create_map(*[F.lit(x) for kv in _DURATION_SECONDS.items() for x in kv])
    total = F.aggregate(
        F.regexp_extract_all(s, F.lit(_DURATION_PART), F.lit(0)),
        F.lit(0.0),
        lambda acc, part: acc
        + F.regexp_extract(part, _DURATION_PART, 1).try_cast("double")
        * F.element_at(factor, F.regexp_extract(part, _DURATION_PART, 2)),
    )
    return F.when(s.rlike(rf"^\+?({_DURATION_PART})+\z") & (total > 0), total)
