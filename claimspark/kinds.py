"""Kinds of values and what holds them in Spark."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default precision of decimals that a schema doesn't type more narrowly.
DECIMAL = T.DecimalType(28, 10)
TYPES: dict[str, T.DataType] = {
    "Subject": T.StringType(), "Decimal": DECIMAL, "Bool": T.BooleanType(), "Date": T.DateType(), "Timestamp": T.TimestampType(),
    "Duration": T.LongType(), "Collection": T.ArrayType(T.StringType()), "Any": T.StringType(),
}
ORDERED = {"Decimal", "Date", "Timestamp", "Duration"}
#: Names of the errors that a value can have.
EMPTY_EXTREMUM, VALUE_MISSING, VALUE_AMBIGUOUS, ZERO_DIVISOR, KIND_MISMATCH, UNIT_MISMATCH, BAD_STEP, DECIMAL_INEXACT = (
    "empty_extremum", "value_missing", "value_ambiguous", "division_by_zero", "kind_mismatch", "unit_mismatch", "round_step", "decimal_inexact",
)


class KindError(ValueError):
    """The kinds of an expression don't fit; known before anything runs."""


class Measured(str):
    """The kind of a quantity: equal to the kind without its unit."""

    unit: str | None = None


def measured(kind: str, unit: str | None) -> str:
    if unit is None:
        return kind
    out = Measured(kind)
    out.unit = unit
    return out


def unit_of(kind: str) -> str | None:
    return getattr(kind, "unit", None)


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "Subject"
    if isinstance(t, T.BooleanType):
        return "Bool"
    if isinstance(t, T.DateType):
        return "Date"
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return "Timestamp"
    if isinstance(t, T.ArrayType):
        return "Collection"
    return "Decimal"


def literal(kind: str, value) -> Column:
    if kind == "Decimal":
        d = Decimal(value)
        digits, scale = len(d.as_tuple().digits), max(0, -d.as_tuple().exponent)
        return F.lit(d).cast(T.DecimalType(max(digits, scale + 1), scale))
    if kind == "Date":
        return F.to_date(F.lit(value))
    if kind == "Timestamp":
        return F.to_timestamp(F.lit(value))
    if kind == "Duration":
        return F.lit(int(value)).cast("long")
    return F.lit(value)
