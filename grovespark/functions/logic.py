"""Operators on plain columns: three-valued logic, equality, comparison and arithmetic with empty propagation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def and_(a: Column, b: Column) -> Column:
    return a & b


def or_(a: Column, b: Column) -> Column:
    return a | b


def xor(a: Column, b: Column) -> Column:
    return a != b


def implies(a: Column, b: Column) -> Column:
    return ~a | b


def not_(a: Column) -> Column:
    return ~a


def equal(a: Column, b: Column) -> Column:
    return a == b


def not_equal(a: Column, b: Column) -> Column:
    return a != b


def equivalent(a: Column, b: Column) -> Column:
    """Never empty: two empty values are equivalent."""
    return a.eqNullSafe(b)


def text_equivalent(a: Column, b: Column) -> Column:
    """Case aside, and blanks of all kinds alike."""
    def plain(c: Column) -> Column:
        return F.translate(F.lower(c), "\t\r\n\f", "    ")

    return plain(a).eqNullSafe(plain(b))


def decimal_equivalent(a: Column, b: Column, scale: int) -> Column:
    """Equal after rounding half away from zero to the smaller scale of the two."""
    return F.round(a, scale).eqNullSafe(F.round(b, scale))


def less(a: Column, b: Column) -> Column:
    return a < b


def less_or_equal(a: Column, b: Column) -> Column:
    return a <= b


def greater(a: Column, b: Column) -> Column:
    return a > b


def greater_or_equal(a: Column, b: Column) -> Column:
    return a >= b


def add(a: Column, b: Column) -> Column:
    """Sum; empty on overflow."""
    return F.try_add(a, b)


def subtract(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def truncated(c: Column, scale: int = 8) -> Column:
    """Digits beyond the scale dropped, towards zero."""
    return F.when(c < 0, F.ceil(c, F.lit(scale))).otherwise(F.floor(c, F.lit(scale)))


def divide(a: Column, b: Column) -> Column:
    """Decimal quotient, found to ten digits and cut to eight; empty for a zero divisor, and for operands of more than
    twenty digits before the point."""
    return truncated(F.try_divide(a.try_cast("decimal(28,8)"), b.try_cast("decimal(28,8)"))).cast("decimal(38,8)")


def div(a: Column, b: Column) -> Column:
    """Whole part of the quotient, towards zero; empty for a zero divisor."""
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def mod(a: Column, b: Column) -> Column:
    """Remainder of div, with the sign of a; empty for a zero divisor."""
    return F.try_mod(a, b)


def concat(a: Column, b: Column) -> Column:
    """The & operator: empty counts as ''."""
    return F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


def negate(a: Column) -> Column:
    """Empty for the least integer, which has no opposite."""
    return F.try_subtract(F.lit(0), a)
