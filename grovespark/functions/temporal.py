"""Dates, times and date-times of partial precision, kept as ISO text: '2020', '2020-05', '2020-05-17T10:30', '10:30:15'.

What two such values leave open is empty: a comparison is decided at the first component that differs, and is empty if
one value ends before. Date-times with an offset are compared in UTC; with and without one they don't compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .collections import let

_FORM = r"\A(?:(\d{4})(?:-(\d\d)(?:-(\d\d))?)?)?(?:T?(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?)?(Z|[+-]\d\d:\d\d)?\z"
_TIME = r"\AT?(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?\z"
#: Milliseconds of the units that have a fixed length.
MILLISECONDS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def _is_time(c: Column) -> Column:
    return F.rlike(c, F.lit(_TIME)) & (F.contains(c, F.lit(":")) | F.startswith(c, F.lit("T")) | (F.length(c) == 2))


def _parsed(c: Column) -> Column:
    """The eight parts of a text, from year to offset, each '' if not given; null for other texts. Times of day are of this
    form too, without a year."""
    return F.split(F.when(F.rlike(c, F.lit(_FORM)), F.regexp_replace(c, _FORM, "$1|$2|$3|$4|$5|$6|$7|$8")), r"\|", -1)


def _field(parsed: Column, group: int) -> Column:
    return F.nullif(F.get(parsed, F.lit(group - 1)), F.lit(""))


def _part(c: Column, group: int) -> Column:
    """One part of a text, null if not given and for other texts: c is evaluated and matched once."""
    return F.nullif(F.regexp_extract(c, _FORM, group), F.lit(""))


def text_of(c: Column, precision: str = "second") -> Column:
    """A timestamp or date column as ISO text of this precision."""
    forms = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd'T'HH", "minute": "yyyy-MM-dd'T'HH:mm",
             "second": "yyyy-MM-dd'T'HH:mm:ss", "millisecond": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
    return F.date_format(c, forms[precision])


def year_of(c: Column) -> Column:
    return _part(c, 1).cast("int")


def month_of(c: Column) -> Column:
    return _part(c, 2).cast("int")


def day_of(c: Column) -> Column:
    return _part(c, 3).cast("int")


def hour_of(c: Column) -> Column:
    return _part(c, 4).cast("int")


def minute_of(c: Column) -> Column:
    return _part(c, 5).cast("int")


def second_of(c: Column) -> Column:
    return _part(c, 6).cast("int")


def millisecond_of(c: Column) -> Column:
    return F.rpad(_part(c, 7), 3, "0").cast("int")


def timezone_offset_of(c: Column) -> Column:
    """Hours east of UTC."""
    return let(_part(c, 8), _offset)  # each mention would match the text again


def _offset(z: Column) -> Column:
    sign = F.when(F.startswith(z, F.lit("-")), -1.0).otherwise(1.0)
    hours = F.substring(z, 2, 2).try_cast("double") + F.substring(z, 5, 2).try_cast("double") / 60
    return F.when(z == "Z", 0.0).otherwise(sign * hours)


def date_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\A(\d{4}(?:-\d\d(?:-\d\d)?)?)", 1), F.lit(""))


def time_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"T(\d\d(?::\d\d(?::\d\d(?:\.\d+)?)?)?)", 1), F.lit(""))


def precision(c: Column) -> Column:
    """Digits given: 4 for a year up to 17 for milliseconds; of a time, 2 to 9."""
    z = F.regexp_replace(c, r"(Z|[+-]\d\d:\d\d)\z", "")
    return F.length(F.regexp_replace(F.when(F.contains(c, F.lit("T")) | _is_time(c), z).otherwise(c), r"\D", ""))


def decimal_precision(text: Column) -> Column:
    """Digits after the point in a number's text."""
    return F.length(F.regexp_extract(text, r"\.(\d+)", 1))


def _components(p: Column) -> Column:
    """Year to millisecond of a parsed text as numbers, null from where it ends; in UTC if it has an offset and a minute."""
    year, month, day, hour, minute, second, ms, zone = (_field(p, g) for g in range(1, 9))
    ms = F.rpad(ms, 3, "0")
    plain = F.array(*(x.cast("long") for x in (year, month, day, hour, minute)), F.concat(second, F.coalesce(ms, F.lit("000"))).cast("long"))
    clock = F.concat(F.concat_ws("-", year, month, day), F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), F.coalesce(second, F.lit("00")))

    def in_utc(t: Column) -> Column:
        seconds = F.when(second.isNotNull(), F.second(t).cast("long") * 1000 + F.coalesce(ms, F.lit("0")).cast("long"))
        return F.array(F.year(t).cast("long"), F.month(t).cast("long"), F.day(t).cast("long"), F.hour(t).cast("long"), F.minute(t).cast("long"), seconds)

    utc = let(F.to_timestamp_ntz(clock) - F.make_dt_interval(mins=(_offset(zone) * 60).cast("int")), in_utc)
    return F.when(zone.isNotNull() & minute.isNotNull(), utc).otherwise(plain)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; empty if what is given does not decide."""

    def decided(p: Column) -> Column:
        x, y = p["a"], p["b"]
        step = F.zip_with(_components(x), _components(y), lambda m, n: F.when(m < n, -1).when(m > n, 1).when(m == n, 0).when(m.isNull() & n.isNull(), 3).otherwise(2))
        first = F.get(F.filter(step, lambda s: (s != 0) & (s != 3)), F.lit(0))
        zoned = (_field(x, 8).isNull() == _field(y, 8).isNull()) | _field(x, 4).isNull() | _field(y, 4).isNull()
        return F.when((_field(x, 1).isNull() == _field(y, 1).isNull()) & zoned, F.nullif(F.coalesce(first, F.lit(0)), F.lit(2)))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(_parsed(a).alias("a"), _parsed(b).alias("b")), decided))


_ZONE = r"(Z|[+-]\d\d:\d\d)\z"
#: Digits of a precision and length of its text, of dates and times of day.
LENGTHS = {4: 4, 6: 7, 8: 10, 10: 13, 12: 16, 14: 19, 17: 23}
TIME_LENGTHS = {2: 2, 4: 5, 6: 8, 9: 12}


def _filled(c: Column, whole: str) -> Column:
    """c with what it leaves open taken from a whole text of the same form."""
    return F.concat(c, F.lit(whole).substr(F.length(c) + 1, F.lit(len(whole))))


def add(c: Column, n: int | Column, unit: str) -> Column:
    """A date or date-time text moved by whole calendar units, a number or a column of them; month and year steps stop at
    the month's end. The precision stays: steps finer than it count as whole larger ones (30 days a month, 365 a year)."""
    n = (n if isinstance(n, Column) else F.lit(n)).cast("long")
    digits, day = precision(c), F.to_date(F.rpad(date_of(c), 10, "-01-01").substr(1, 10))
    if unit in ("year", "month"):
        months = (n * 12 if unit == "year" else n).cast("int")
        moved = F.add_months(day, F.when(digits == 4, (months / 12).cast("int") * 12).otherwise(months))
        out = F.date_format(moved, "yyyy-MM-dd").substr(F.lit(1), F.length(date_of(c)))
        return F.concat(out, F.substring(c, 11, 100))
    days = (n * MILLISECONDS[unit] / MILLISECONDS["day"]).cast("int")
    by_month = F.add_months(day, F.when(digits == 4, (days / 365).cast("int") * 12).otherwise((days / 30).cast("int")))
    clock = F.regexp_replace(c, _ZONE, "")
    moved = F.to_timestamp_ntz(_filled(clock, "2000-01-01T00:00:00.000")) + F.make_dt_interval(secs=(n * MILLISECONDS[unit] / 1000).cast("decimal(18,6)"))
    exact = F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss.SSS").substr(F.lit(1), F.length(clock)), F.coalesce(_part(c, 8), F.lit("")))
    by_day = F.date_format(F.date_add(F.to_date(date_of(c)), days), "yyyy-MM-dd")
    return F.when(digits < 8, F.date_format(by_month, "yyyy-MM-dd").substr(F.lit(1), F.length(c))).when(digits == 8, by_day).otherwise(exact)


def add_to_time(c: Column, n: int, unit: str) -> Column:
    """A time of day moved within the day, past midnight if need be."""

    def moved(p: Column) -> Column:
        hour, minute, second, ms = (_field(p, g) for g in range(4, 8))
        parts = ((hour, 3_600_000), (minute, 60_000), (second, 1000), (F.rpad(ms, 3, "0"), 1))
        total = sum((F.coalesce(x.cast("int"), F.lit(0)) * size for x, size in parts), F.lit(0))
        return F.pmod(total + n * MILLISECONDS[unit], F.lit(86_400_000)).cast("long")

    def whole(ms: Column) -> Column:
        return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)

    return let(c, lambda c: let(let(_parsed(c), moved), whole).substr(F.lit(1), F.length(c)))


def duration(a: Column, b: Column, unit: str) -> Column:
    """Whole units from timestamp a to b, towards zero."""
    return F.timestamp_diff(unit.upper(), a, b)


def difference(a: Column, b: Column, unit: str) -> Column:
    """Boundaries of the unit crossed from timestamp a to b; weeks begin on Sunday."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit in ("year", "month"):
        return (F.year(b) - F.year(a) if unit == "year" else months).cast("long")
    if unit == "day":
        return F.datediff(b, a).cast("long")
    if unit == "week":
        def week(c: Column) -> Column:
            return F.floor((F.datediff(c, F.lit("1970-01-04").cast("date"))) / 7)

        return (week(b) - week(a)).cast("long")
    size = MILLISECONDS[unit] * 1000
    return (F.floor(F.unix_micros(b) / size) - F.floor(F.unix_micros(a) / size)).cast("long")


def low_boundary(c: Column, digits: int | None = None) -> Column:
    """The earliest instant a text can mean: a date to the day, a date-time to milliseconds with the largest offset if it
    has none, a time of day to milliseconds. With digits, cut to that precision (LENGTHS, TIME_LENGTHS)."""
    dated = _filled(date_of(c), "0000-01-01")
    return _bounded(c, dated, "00:00:00.000", "+14:00", digits)


def high_boundary(c: Column, digits: int | None = None) -> Column:
    """The latest instant, likewise."""
    month = F.last_day(F.to_date(F.concat(date_of(c), F.lit("-01"))))
    dated = F.when(F.length(date_of(c)) == 4, F.concat(date_of(c), F.lit("-12-31"))).when(F.length(date_of(c)) == 7, F.date_format(month, "yyyy-MM-dd")).otherwise(date_of(c))
    return _bounded(c, dated, "23:59:59.999", "-12:00", digits)


def _bounded(c: Column, dated: Column, clock: str, zone: str, digits: int | None) -> Column:
    long, short = (t.get(digits, 23) if digits else 23 for t in (LENGTHS, TIME_LENGTHS))
    time = F.coalesce(time_of(c), F.lit(""))
    stamp = F.concat(dated, F.lit("T"), _filled(time, clock).substr(1, 12))
    timed = F.concat(stamp.substr(1, long), F.coalesce(_part(c, 8), F.lit(zone)) if long > 10 else F.lit(""))
    of_day = _filled(F.regexp_replace(c, r"\AT", ""), clock).substr(1, short)
    return F.when(_is_time(c), of_day).when(F.contains(c, F.lit("T")), timed).otherwise(dated.substr(1, long))


def decimal_low_boundary(text: Column, digits: int = 8) -> Column:
    """Half a unit of the last given digit below, to eight digits or fewer, rounded down."""
    return F.floor((text.cast("decimal(28,8)") - _half(text)).cast("decimal(28,9)"), F.lit(digits)).cast("decimal(28,8)")


def decimal_high_boundary(text: Column, digits: int = 8) -> Column:
    """Half a unit above, rounded up."""
    return F.ceil((text.cast("decimal(28,8)") + _half(text)).cast("decimal(28,9)"), F.lit(digits)).cast("decimal(28,8)")


def _half(text: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), -decimal_precision(text)) / 2, 9).cast("decimal(28,9)")


def now(at: str) -> Column:
    """The frozen clock of one evaluation, given as ISO text in UTC."""
    return F.lit(at)


def today(at: str) -> Column:
    return F.lit(at[:10])


def time_of_day(at: str) -> Column:
    return F.lit(at[11:23])
