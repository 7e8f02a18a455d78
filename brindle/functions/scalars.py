"""Scalar functions of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_code(c: Column) -> Column:
    """Unicode white space off both ends, upper case."""
    return F.upper(F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))


def length_between(c: Column, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def looks_like_email(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def minor_units(cents: Column, sign: str = "$") -> Column:
    """-123456 as -$1,234.56."""
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit(sign), F.format_number(F.abs(cents) / 100, 2))


def at_least_zero(c: Column) -> Column:
    """max(0, c), null for null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0), c))


def started(c: Column, as_of: Column) -> Column:
    """Open or not after as_of."""
    return c.isNull() | (c <= as_of)


def not_ended(c: Column, as_of: Column) -> Column:
    """Open or not before as_of."""
    return c.isNull() | (c >= as_of)


def int_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def initial(c: Column, default: str = "U") -> Column:
    return F.coalesce(F.nullif(F.upper(F.substring(c, 1, 1)), F.lit("")), F.lit(default))


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def per_ten(c: Column) -> Column:
    """ceil(c / 10) as a whole number."""
    return F.ceil(c / 10).cast("bigint")
