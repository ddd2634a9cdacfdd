"""Text functions; positions and lengths are code points, from 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def starts_with(c: Column, s: Column) -> Column:
    return F.startswith(c, s)


def ends_with(c: Column, s: Column) -> Column:
    return F.endswith(c, s)


def contains(c: Column, s: Column) -> Column:
    return F.contains(c, s)


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """Empty if start lies outside (start 0 of '' is ''); a length of 0 or less gives ''."""
    inside = (F.lit(start) >= 0) & ((F.lit(start) < F.length(c)) | ((F.lit(start) == 0) & (c == "")))
    return F.when(inside, F.substring(c, start + 1, 2**31 - 1 - max(start, 0) if length is None else max(length, 0)))


def index_of(c: Column, s: Column) -> Column:
    return F.instr(c, s) - 1


def last_index_of(c: Column, s: Column) -> Column:
    back = F.instr(F.reverse(c), F.reverse(s))
    return F.when(s == "", F.length(c)).when(back == 0, -1).otherwise(F.length(c) - back - F.length(s) + 1)


def length(c: Column) -> Column:
    return F.length(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def replace(c: Column, pattern: str, by: str) -> Column:
    """Literal; an empty pattern puts the replacement around every character."""
    if pattern == "":
        return F.regexp_replace(c, "", by.replace("\\", "\\\\").replace("$", "\\$"))
    return F.replace(c, F.lit(pattern), F.lit(by))


def _flags(flags: str) -> str:
    return "(?s" + "".join(f for f in flags if f in "im") + ")"


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    """A match anywhere; the dot matches line ends."""
    return F.rlike(c, F.lit(_flags(flags) + pattern))


def matches_full(c: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(c, F.lit(f"{_flags(flags)}\\A(?:{pattern})\\z"))


def replace_matches(c: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(c, _flags(flags) + pattern, by)


def trim(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\r\n"))


def to_chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def split(c: Column, separator: str) -> Column:
    """Empty parts kept; an empty separator gives the characters."""
    return F.split(c, re.escape(separator), -1) if separator else to_chars(c)


def join(c: Column, separator: str = "") -> Column:
    """Items as one text; empty for none."""
    return F.when(F.size(c) > 0, F.array_join(c, separator))


def encode(c: Column, form: str) -> Column:
    """hex, base64 or urlbase64 of the UTF-8 bytes; empty for other forms."""
    if form == "hex":
        return F.lower(F.hex(c))
    plain = F.regexp_replace(F.base64(F.encode(c, "utf-8")), "\r\n", "")
    return {"base64": plain, "urlbase64": F.translate(plain, "+/", "-_")}.get(form, F.lit(None).cast("string"))


def decode(c: Column, form: str) -> Column:
    """The text that encode() came from; empty if it is none."""
    if form == "hex":
        return F.try_validate_utf8(F.decode(F.try_to_binary(c, F.lit("hex")), "utf-8"))
    if form == "urlbase64":
        c = F.translate(c, "-_", "+/")
    elif form != "base64":
        return F.lit(None).cast("string")
    return F.decode(F.try_to_binary(c, F.lit("base64")), "utf-8")


_HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
_JSON = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")]


def escape(c: Column, form: str) -> Column:
    """html (&, <, > and double quotes) or json."""
    for a, b in {"html": _HTML, "json": _JSON}[form]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, form: str) -> Column:
    if form == "json":
        return F.get_json_object(F.concat(F.lit('{"v":"'), c, F.lit('"}')), "$.v")
    for a, b in reversed(_HTML):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c
