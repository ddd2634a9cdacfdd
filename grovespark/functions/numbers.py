"""Mathematical functions; a result outside the reals is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_(c: Column) -> Column:
    return F.abs(c)


def _long(c: Column, whole: Column) -> Column:
    return F.when(F.abs(c.cast("double")) < 9.223372036854775e18, whole.cast("long"))


def ceiling(c: Column) -> Column:
    """Empty beyond 64 bits, as floor and truncate are."""
    return _long(c, F.ceil(c))


def floor(c: Column) -> Column:
    return _long(c, F.floor(c))


def truncate(c: Column) -> Column:
    """Towards zero."""
    return _long(c, F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))


def round_(c: Column, digits: int = 0) -> Column:
    """Half away from zero, decided on the decimal form."""
    if digits < 0:
        raise ValueError("digits below 0")
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def _real(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def exp(c: Column) -> Column:
    return _real(F.exp(c))


def ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def log(c: Column, base: Column | float) -> Column:
    b = F.lit(base) if not isinstance(base, Column) else base
    return F.when((c > 0) & (b > 0) & (b != 1), F.ln(c) / F.ln(b))


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def power(c: Column, exponent: Column | float) -> Column:
    return _real(F.pow(c, exponent))
