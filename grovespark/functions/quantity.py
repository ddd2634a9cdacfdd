"""Quantities: struct<value decimal, unit string>. Calendar words and clock units of a week and less convert; other units
compare only with themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .temporal import MILLISECONDS

#: Unit codes and the calendar words they equal.
CODES = {"ms": "millisecond", "s": "second", "min": "minute", "h": "hour", "d": "day", "wk": "week"}


def quantity(value: Column, unit: Column | str) -> Column:
    return F.struct(value.try_cast("decimal(28,8)").alias("value"), (F.lit(unit) if isinstance(unit, str) else unit).alias("unit"))


def _milliseconds(unit: Column) -> Column:
    pairs = [(w, n) for w, n in MILLISECONDS.items()] + [(c, MILLISECONDS[w]) for c, w in CODES.items()] + [(w + "s", n) for w, n in MILLISECONDS.items()]
    return F.try_element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), unit)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; empty for units that don't convert."""
    ma, mb = _milliseconds(a["unit"]), _milliseconds(b["unit"])
    x = F.when(a["unit"] == b["unit"], a["value"]).when(ma.isNotNull() & mb.isNotNull(), a["value"] * ma)
    y = F.when(a["unit"] == b["unit"], b["value"]).when(ma.isNotNull() & mb.isNotNull(), b["value"] * mb)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def equal(a: Column, b: Column) -> Column:
    return compare(a, b) == 0


def add(a: Column, b: Column) -> Column:
    """In a's unit; empty for units that don't convert."""
    ma, mb = _milliseconds(a["unit"]), _milliseconds(b["unit"])
    other = F.when(a["unit"] == b["unit"], b["value"]).otherwise((b["value"] * mb / ma).cast("decimal(28,8)"))
    return F.when(other.isNotNull(), quantity(a["value"] + other, a["unit"]))


def negate(a: Column) -> Column:
    return quantity(-a["value"], a["unit"])


def subtract(a: Column, b: Column) -> Column:
    return add(a, negate(b))


def multiply(a: Column, b: Column) -> Column:
    """Equal units become their square; a unit of '1' leaves the other."""
    unit = F.when(a["unit"] == "1", b["unit"]).when(b["unit"] == "1", a["unit"]).when(a["unit"] == b["unit"], F.concat(a["unit"], F.lit("2")))
    return quantity(a["value"] * b["value"], F.coalesce(unit, F.concat_ws(".", a["unit"], b["unit"])))


def divide(a: Column, b: Column) -> Column:
    """Equal units cancel to '1'; empty for a zero divisor."""
    unit = F.when(a["unit"] == b["unit"], "1").when(b["unit"] == "1", a["unit"]).when(a["unit"] == F.concat(b["unit"], F.lit("2")), b["unit"])
    value = F.try_divide(a["value"], b["value"]).try_cast("decimal(28,8)")
    return F.when(value.isNotNull(), quantity(value, F.coalesce(unit, F.concat_ws("/", a["unit"], b["unit"]))))


def comparable(a: Column, b: Column) -> Column:
    """Whether the units are the same or convert; empty for an empty quantity."""
    convert = (a["unit"] == b["unit"]) | (_milliseconds(a["unit"]).isNotNull() & _milliseconds(b["unit"]).isNotNull())
    return F.when(a.isNotNull() & b.isNotNull(), convert)


def equivalent(a: Column, b: Column) -> Column:
    """Equal after conversion; false if the units don't convert or only one is empty, true if both are."""
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(compare(a, b) == 0, F.lit(False)))


def _in_unit_of(a: Column, b: Column) -> Column:
    """b's value in a's unit, empty if it doesn't convert or is zero."""
    other = F.when(a["unit"] == b["unit"], b["value"]).otherwise(b["value"] * _milliseconds(b["unit"]) / _milliseconds(a["unit"]))
    return F.nullif(other.try_cast("decimal(28,8)"), F.lit(0).cast("decimal(28,8)"))


def div(a: Column, b: Column) -> Column:
    """Whole part of the quotient of convertible quantities, of unit '1'."""
    value = F.call_function("div", a["value"], _in_unit_of(a, b))
    return F.when(value.isNotNull(), quantity(value, "1"))


def mod(a: Column, b: Column) -> Column:
    """Remainder of div, in a's unit."""
    value = F.try_mod(a["value"], _in_unit_of(a, b))
    return F.when(value.isNotNull(), quantity(value, a["unit"]))
