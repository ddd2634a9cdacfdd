"""Conversions between types: to_x is empty, and converts_to_x false, where a value has no such form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that stand for booleans, lower case.
TRUE, FALSE = ("true", "t", "yes", "y", "1", "1.0"), ("false", "f", "no", "n", "0", "0.0")
DATE = r"\d{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?"
TIME = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d(\.\d+)?)?)?"
ZONE = r"(Z|[+-]\d\d:[0-5]\d)"
DATETIME = rf"{DATE}(T({TIME})?{ZONE}?)?"


def _gated(c: Column, pattern: str) -> Column:
    s = c.cast("string")
    return F.when(F.rlike(s, F.lit(rf"\A({pattern})\z")), s)


def to_boolean(c: Column) -> Column:
    s = F.lower(c.cast("string"))
    return F.when(s.isin(*TRUE), True).when(s.isin(*FALSE), False)


def to_integer(c: Column) -> Column:
    """Digits with an optional sign; true and false are 1 and 0."""
    s = F.when(c.cast("string") == "true", "1").when(c.cast("string") == "false", "0").otherwise(_gated(c, r"[+-]?\d+"))
    return s.try_cast("long")


def to_long(c: Column) -> Column:
    return to_integer(c)


def to_decimal(c: Column, scale: int = 8) -> Column:
    """Digits with an optional sign and fraction, no exponent."""
    s = F.when(c.cast("string") == "true", "1.0").when(c.cast("string") == "false", "0.0").otherwise(_gated(c, r"[+-]?\d+(\.\d+)?"))
    return s.try_cast(f"decimal(38,{scale})")


def to_string(c: Column) -> Column:
    return c.cast("string")


def to_date(c: Column) -> Column:
    """A date of year, month or day precision, as its ISO text; of a date and time, the date."""
    return F.coalesce(_gated(c, DATE), F.regexp_extract(_gated(c, DATETIME), r"\A([0-9-]+)T", 1))


def to_datetime(c: Column) -> Column:
    return _gated(c, DATETIME)


def to_time(c: Column) -> Column:
    return _gated(c, TIME)


def to_quantity(c: Column, unit: str | None = None) -> Column:
    """struct<value decimal(38,8), unit string> of a number, or of text such as "4 'mg'" or "3 days"; with a unit, only
    quantities that have it."""
    s = _gated(c, r"[+-]?\d+(\.\d+)?(\s*('[^']+'|(year|month|week|day|hour|minute|second|millisecond)s?))?")
    name = F.regexp_extract(s, r"\A[+-]?[0-9.]+\s*'?([^']*?)'?\z", 1)
    name = F.when(name == "", "1").when(F.contains(s, F.lit("'")), name).otherwise(F.regexp_replace(name, r"s\z", ""))
    out = F.struct(F.regexp_extract(s, r"\A([+-]?[0-9.]+)", 1).try_cast("decimal(38,8)").alias("value"), name.alias("unit"))
    kept = s.isNotNull() if unit is None else s.isNotNull() & (name == unit)
    return F.when(kept, out)


def converts(to: Callable[..., Column], c: Column, *args) -> Column:
    """converts_to_x for any to_x: empty for an empty value."""
    return F.when(c.isNotNull(), to(c, *args).isNotNull())


def converts_to_boolean(c: Column) -> Column:
    return converts(to_boolean, c)


def converts_to_integer(c: Column) -> Column:
    return converts(to_integer, c)


def converts_to_long(c: Column) -> Column:
    return converts(to_long, c)


def converts_to_decimal(c: Column) -> Column:
    return converts(to_decimal, c)


def converts_to_string(c: Column) -> Column:
    return converts(to_string, c)


def converts_to_date(c: Column) -> Column:
    return converts(to_date, c)


def converts_to_datetime(c: Column) -> Column:
    return converts(to_datetime, c)


def converts_to_time(c: Column) -> Column:
    return converts(to_time, c)


def converts_to_quantity(c: Column, unit: str | None = None) -> Column:
    return converts(to_quantity, c, unit)
