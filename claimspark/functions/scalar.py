"""Arithmetic, calendar and digest functions as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_A_DAY = 86_400_000_000


def round_to(x: Column, step: Column) -> Column:
    """The nearest multiple of ``step``, halves away from zero. A step that isn't positive gives null."""
    half = F.lit(0.5).cast("decimal(2,1)")
    up = F.floor(F.abs(x) / F.when(step > 0, step) + half) * step
    return F.when(x < 0, -up).otherwise(up)


def remainder(x: Column, y: Column) -> Column:
    """Exact, with the sign of the dividend; null for a zero divisor."""
    return x % F.nullif(y, F.lit(0))


def shift_date(d: Column, months: int | Column, days: int | Column) -> Column:
    """Months first, clamped to the month's end, then days."""
    return F.date_add(F.add_months(d, months), days)


def period_index(anchor: Column, span: tuple[int, int], at: Column) -> Column:
    """The greatest n whose boundary, anchor + n spans in one clamped shift, is not after ``at``."""
    months, days = span
    if months <= 0 and days <= 0:
        raise ValueError("a period must go forward")
    if not months:
        return F.floor(F.datediff(at, anchor) / F.lit(days)).cast("long")
    whole = (F.year(at) - F.year(anchor)) * 12 + F.month(at) - F.month(anchor)
    if not days:
        guess = F.floor(whole / F.lit(months)).cast("int")
        return F.when(F.add_months(anchor, guess * months) > at, guess - 1).otherwise(guess).cast("long")
    # Mixed spans: the mean length bounds n from both sides; the few candidates between are tried.
    low = F.floor(F.datediff(at, anchor) / F.lit(31 * months + days)).cast("int") - 1
    high = F.ceil(F.datediff(at, anchor) / F.lit(28 * months + days)).cast("int") + 1
    tried = F.filter(F.sequence(F.least(low, high), F.greatest(low, high)), lambda n: shift_date(anchor, n * months, n * days) <= at)
    return F.array_max(tried).cast("long")


def period_start_of(anchor: Column, span: tuple[int, int], n: Column) -> Column:
    """The boundary of the n-th period; null unless n is whole."""
    whole = F.when(n == F.floor(n), n).cast("int")
    return shift_date(anchor, whole * span[0], whole * span[1])


def periods(start: Column, end: Column, step_micros: int) -> Column:
    """Starts of every step-wide period, counted from the epoch, that meets [start, end)."""
    if step_micros <= 0:
        raise ValueError("a period must be longer than nothing")
    first = F.floor(micros(start) / F.lit(step_micros)).cast("long")
    last = F.floor((micros(end) - 1) / F.lit(step_micros)).cast("long")
    grid = F.transform(F.sequence(first, last), lambda n: F.timestamp_micros(n * step_micros))
    return F.when(micros(end) > micros(start), grid).otherwise(F.array().cast("array<timestamp>"))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def add_duration(t: Column, duration: Column) -> Column:
    return F.timestamp_micros(micros(t) + duration)


def decimal_text(x: Column) -> Column:
    """A decimal without trailing zeros: equal numbers have equal texts."""
    text = x.cast("string")
    trimmed = F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(trimmed, r"\.$", "")).otherwise(text)


def iso_instant(t: Column) -> Column:
    t = t.cast("timestamp")
    fraction = F.regexp_replace(F.date_format(t, ".SSSSSS"), r"\.?0+$", "")
    return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def canonical(kind: str, x: Column) -> Column:
    """The text by which values of a kind are equal."""
    if kind == "Decimal":
        return decimal_text(x)
    if kind == "Timestamp":
        return iso_instant(x)
    if kind == "Collection":
        quoted = F.transform(x.cast("array<string>"), lambda e: F.concat(F.lit('"'), F.regexp_replace(e, r'(["\\])', r"\\$1"), F.lit('"')))
        return F.concat(F.lit("["), F.array_join(quoted, ", ", "null"), F.lit("]"))
    return x.cast("string")


def value_key(kind: str, x: Column) -> Column:
    """Kind and canonical text, as a JSON pair."""
    text = F.regexp_replace(canonical(kind, x), r'(["\\])', r"\\$1")
    return F.concat(F.lit(f'["{kind.lower()}", "'), text, F.lit('"]'))


def digest(kinds: list[str], columns: list[Column]) -> Column:
    """A commitment to some values in order, each as its key."""
    keys = F.concat_ws(", ", *(value_key(k, c) for k, c in zip(kinds, columns, strict=True)))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("["), keys, F.lit("]")), 256))


def claim_key(kinds: list[str], columns: list[Column]) -> Column:
    """The identity of a claim: equal tuples have equal keys."""
    return F.sha2(F.concat_ws(", ", *(value_key(k, c) for k, c in zip(kinds, columns, strict=True))), 256)


def as_decimal(x: Column, precision: int = 28, scale: int = 10) -> Column:
    """To a narrower decimal, or an error if that would change the value."""
    narrow = x.cast(T.DecimalType(precision, scale))
    return F.when(narrow == x, narrow).otherwise(F.raise_error(F.lit("decimal_inexact")).cast(T.DecimalType(precision, scale)))


#: Digits after the point of a product whose exact type is wider than 38 digits, and all its digits.
PRODUCT_SCALE, PRODUCT_DIGITS = 12, 38


def exact_product(x: Column, y: Column, of_x: T.DecimalType, of_y: T.DecimalType, keep=lambda v: v) -> tuple[Column, Column | None]:
    """The exact product, and a condition for rows where it has none.

    Where the exact type fits 38 digits nothing can be lost. Elsewhere the factors are taken apart
    into whole and broken parts, whose four products are exact, and the sum has ``PRODUCT_SCALE``
    digits after the point; a value that this can't hold (one more digit there, or a part of
    10^18 or a term of 10^24 before it) is inexact. ``keep`` may put a step into a column of its own,
    so that it isn't computed again wherever it is used.
    """
    if of_x.precision + of_y.precision + 1 <= 38:
        return x * y, None
    unit = F.lit(1).cast("decimal(1,0)")
    bad: list[Column] = []

    def exactly(v: Column, digits: int, scale: int, own: T.DecimalType) -> Column:
        # Compared in v's own type: a common one could be too wide, and rounded.
        v = keep(v)
        narrow = keep(v.try_cast(T.DecimalType(digits, scale)))
        bad.append(v.isNotNull() & (narrow.isNull() | (narrow.cast(own) != v)))
        return narrow

    def parts(v: Column, of: T.DecimalType) -> tuple[Column, Column]:
        broken = keep(v % unit)
        return exactly((v - broken).cast("decimal(38,0)"), 18, 0, T.DecimalType(38, 0)), exactly(broken, 18, 18, T.DecimalType(of.scale + 1, of.scale))

    (xh, xl), (yh, yl) = parts(x, of_x), parts(y, of_y)
    products = ((xh * yh, 0), (xh * yl, 18), (xl * yh, 18), (xl * yl, 36))
    terms = [exactly(v, PRODUCT_DIGITS - 2, PRODUCT_SCALE, T.DecimalType(37, at)) for v, at in products]
    # Equal types: each sum is one digit wider, so the four fit 38 digits.
    return keep((terms[0] + terms[1]) + (terms[2] + terms[3])), keep(reduce(Column.__or__, bad))


def exact_sum(x: Column, y: Column, of_x: T.DecimalType, of_y: T.DecimalType) -> Column | None:
    """A condition for rows where x + y or x - y loses digits; None if the types say that none does."""
    scale = max(of_x.scale, of_y.scale)
    over = max(of_x.precision - of_x.scale, of_y.precision - of_y.scale) + scale + 1 - 38
    if over <= 0:
        return None
    kept = max(scale - over, min(scale, 6))
    lossy = [v != v.cast(T.DecimalType(38, kept)) for v, of in ((x, of_x), (y, of_y)) if of.scale > kept]
    return reduce(Column.__or__, lossy) if lossy else None
