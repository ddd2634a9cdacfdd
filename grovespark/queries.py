"""Queries over the driver's tables by name, with DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as rows
from . import sources, streaming
from .functions import collections as c
from .functions import convert, logic, numbers, quantity, strings, temporal, trees
from .plans import customer_documents, leaves, order_documents, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

class Columns:
    """The columns that expressions share, made when a query is built, as that needs a session."""

    @property
    def text(self) -> Column:
        return F.col("text")

    @property
    def value(self) -> Column:
        return F.col("value")

    @property
    def date(self) -> Column:
        return F.col("o_orderdate")

    @property
    def k(self) -> Column:
        return F.get_json_object("props", "$.k")

    @property
    def day(self) -> Column:
        return temporal.text_of(self.date, "day")

    @property
    def minute(self) -> Column:
        return temporal.text_of(F.col("ts"), "minute")

    @property
    def ms(self) -> Column:
        return temporal.text_of(F.col("ts"), "millisecond")

    @property
    def q(self) -> Column:
        return self.value.cast("decimal(18,2)")

    @property
    def seven(self) -> Column:
        return F.lit(7).cast("decimal(18,2)")

    @property
    def since(self) -> Column:
        return F.lit("2000-03-15 10:20:30").cast("timestamp")

    def pick(self, a: Column | str, b: Column | str) -> Column:
        """One of two values, by the event's k."""
        a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
        return F.when(self.k.cast("long") > 50, a).otherwise(b)

    @property
    def mixed(self) -> Column:
        """A number or a string, by the event's k."""
        return trees.tree(self.pick(self.k, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))))

    @property
    def primitive(self) -> Column:
        """A primitive with metadata: now and then without a value, now and then with an extension."""
        more = F.struct(F.lit("x").alias("id"), F.array(F.struct(F.lit("http://k").alias("url"), self.k.alias("value")), F.struct(F.lit("http://t").alias("url"), F.lit("t").alias("value"))).alias("extension"))
        return sources.merged_primitive(F.nullif(F.col("event_type"), F.lit("error")), self.pick(more, F.lit(None)))

    @property
    def item(self) -> Column:
        return F.col("item")

    @property
    def quantity(self) -> Column:
        return self.item["l_quantity"]

    @property
    def part(self) -> Column:
        return self.item["l_partkey"]

    @property
    def flag(self) -> Column:
        return self.item["l_returnflag"]

    @property
    def big(self) -> Column:
        return c.select(c.where(self.item, lambda e: e["l_quantity"] > 25), lambda e: e["l_returnflag"])

    @property
    def even(self) -> Column:
        return c.select(c.where(self.item, lambda e, i: i % 2 == 0), lambda e: e["l_returnflag"])


Expression = Callable[[Columns], Column]

# Scalar expressions: (name, table, key, column, SQL), giving (key, value).
_KEYS = {"documents": "doc_id", "events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "labels": "doc_id", "embeddings": "vec_id"}
_SK = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_TWO = "o_orderdate, TIMESTAMP '2000-03-15 10:20:30'"

SCALARS: list[tuple[str, str, Expression, str]] = [
    ("string_starts_with", "documents", lambda v: strings.starts_with(v.text, F.lit("Th")), "starts_with(text, 'Th')"),
    ("string_ends_with", "documents", lambda v: strings.ends_with(v.text, F.lit(".")), "ends_with(text, '.')"),
    ("string_contains", "documents", lambda v: strings.contains(v.text, F.lit("tion")), "contains(text, 'tion')"),
    ("string_substring", "documents", lambda v: strings.substring(v.text, 5, 10), "CASE WHEN len(text) > 5 THEN substr(text, 6, 10) END"),
    ("string_substring_open", "documents", lambda v: strings.substring(F.col("lang"), 1), "CASE WHEN len(lang) > 1 THEN substr(lang, 2) END"),
    ("string_index_of", "documents", lambda v: strings.index_of(v.text, F.lit("the")).cast("long"), "CAST(strpos(text, 'the') - 1 AS BIGINT)"),
    ("string_last_index_of", "documents", lambda v: strings.last_index_of(v.text, F.lit("e")).cast("long"),
     "CAST(CASE WHEN strpos(text, 'e') = 0 THEN -1 ELSE len(text) - strpos(reverse(text), 'e') END AS BIGINT)"),
    ("string_length", "documents", lambda v: strings.length(v.text).cast("long"), "CAST(len(text) AS BIGINT)"),
    ("string_upper", "documents", lambda v: strings.upper(F.col("lang")), "upper(lang)"),
    ("string_lower", "part", lambda v: strings.lower(F.col("p_type")), "lower(p_type)"),
    ("string_replace", "documents", lambda v: strings.replace(v.text, "the", "THE"), "replace(text, 'the', 'THE')"),
    ("string_replace_empty", "documents", lambda v: strings.replace(F.col("lang"), "", "-"), "'-' || array_to_string(string_split(lang, ''), '-') || '-'"),
    ("string_trim", "documents", lambda v: strings.trim(F.concat(F.lit(" \t"), F.col("lang"), F.lit("\n "))), "lang"),
    ("string_join_split", "documents", lambda v: strings.join(strings.split(v.text, " "), "|"), "array_to_string(string_split(text, ' '), '|')"),
    ("string_to_chars", "documents", lambda v: F.size(strings.to_chars(v.text)).cast("long"), "CAST(len(text) AS BIGINT)"),
    ("regex_matches", "documents", lambda v: strings.matches(v.text, "[0-9]{3}"), "regexp_matches(text, '[0-9]{3}', 's')"),
    ("regex_matches_flags", "documents", lambda v: strings.matches(v.text, "^THE", "im"), "regexp_matches(text, '(?ism)^THE')"),
    ("regex_matches_full", "documents", lambda v: strings.matches_full(F.col("source"), "src[0-9]"), "regexp_full_match(source, 'src[0-9]')"),
    ("regex_replace_matches", "documents", lambda v: strings.replace_matches(v.text, "([aeiou])n", "<$1>"), "regexp_replace(text, '([aeiou])n', '<\\1>', 'g')"),
    ("encode_hex", "documents", lambda v: strings.encode(v.text, "hex"), "lower(hex(encode(text)))"),
    ("encode_base64", "documents", lambda v: strings.encode(v.text, "base64"), "to_base64(encode(text))"),
    ("encode_urlbase64", "documents", lambda v: strings.encode(v.text, "urlbase64"), "translate(to_base64(encode(text)), '+/', '-_')"),
    ("decode_hex", "documents", lambda v: strings.decode(strings.encode(v.text, "hex"), "hex"), "text"),
    ("decode_base64", "documents", lambda v: strings.decode(strings.encode(v.text, "base64"), "base64"), "text"),
    ("decode_urlbase64", "documents", lambda v: strings.decode(strings.encode(v.text, "urlbase64"), "urlbase64"), "text"),
    ("escape_html", "documents", lambda v: strings.escape(v.text, "html"), "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
    ("unescape_html", "documents", lambda v: strings.unescape(strings.escape(v.text, "html"), "html"), "text"),
    ("escape_json", "documents", lambda v: strings.escape(v.text, "json"), "replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"),
    ("unescape_json", "documents", lambda v: strings.unescape(strings.escape(v.text, "json"), "json"), "text"),
    ("string_equivalent", "documents", lambda v: logic.text_equivalent(F.col("lang"), F.lit("EN")), "lower(lang) = 'en'"),
    ("string_concat", "documents", lambda v: logic.concat(F.col("lang"), F.nullif(F.col("source"), F.lit("src1"))), "lang || coalesce(nullif(source, 'src1'), '')"),
    ("math_abs", "customer", lambda v: F.round(numbers.abs_(F.col("c_acctbal")), 2), "round(abs(c_acctbal), 2)"),
    ("math_ceiling", "events", lambda v: numbers.ceiling(v.value), "CAST(ceil(value) AS BIGINT)"),
    ("math_floor", "events", lambda v: numbers.floor(v.value), "CAST(floor(value) AS BIGINT)"),
    ("math_truncate", "customer", lambda v: numbers.truncate(F.col("c_acctbal")), "CAST(trunc(c_acctbal) AS BIGINT)"),
    ("math_round", "events", lambda v: numbers.round_(v.value, 1), "CAST(round(CAST(value AS DECIMAL(38, 12)), 1) AS DOUBLE)"),
    ("math_exp", "events", lambda v: F.round(numbers.exp(v.value / 1000), 6), "round(exp(value / 1000), 6)"),
    ("math_ln", "events", lambda v: F.round(numbers.ln(v.value), 6), "CASE WHEN value > 0 THEN round(ln(value), 6) END"),
    ("math_log", "events", lambda v: F.round(numbers.log(v.value, 2.0), 6), "CASE WHEN value > 0 THEN round(ln(value) / ln(2.0), 6) END"),
    ("math_sqrt", "customer", lambda v: F.round(numbers.sqrt(F.col("c_acctbal")), 4), "CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 4) END"),
    ("math_power", "part", lambda v: numbers.power(F.col("p_size"), 2.0), "pow(p_size, 2.0)"),
    ("arith_add", "events", lambda v: logic.add(v.k.cast("long"), F.lit(5)), f"{_SK} + 5"),
    ("arith_subtract", "events", lambda v: logic.subtract(v.k.cast("long"), F.lit(500)), f"{_SK} - 500"),
    ("arith_multiply", "events", lambda v: logic.multiply(v.k.cast("long"), F.lit(3)), f"{_SK} * 3"),
    ("arith_negate", "events", lambda v: logic.negate(v.k.cast("long")), f"-{_SK}"),
    ("arith_divide", "events", lambda v: logic.divide(v.q, v.seven).cast("double"), "CAST(trunc(CAST(value AS DECIMAL(18, 2)) * 100000000 / 7) AS DOUBLE) / 100000000"),
    ("arith_div", "events", lambda v: logic.div((v.k.cast("long") - 50), F.lit(7).cast("long")), f"({_SK} - 50) // 7"),
    ("arith_mod", "events", lambda v: logic.mod((v.k.cast("long") - 50), F.lit(7).cast("long")), f"({_SK} - 50) % 7"),
    ("arith_div_zero", "events", lambda v: logic.div(v.k.cast("long"), F.lit(0).cast("long")), "CAST(NULL AS BIGINT)"),
    ("compare_less", "events", lambda v: logic.less(v.value, F.lit(10.0)), "value < 10.0"),
    ("compare_greater_or_equal", "events", lambda v: logic.greater_or_equal(v.value, F.lit(10.0)), "value >= 10.0"),
    ("equal_not_equal", "events", lambda v: logic.not_equal(F.col("event_type"), F.lit("error")), "event_type <> 'error'"),
    ("decimal_equivalent", "events", lambda v: logic.decimal_equivalent(v.q, F.lit(6.5).cast("decimal(18,1)"), 1), "round(CAST(value AS DECIMAL(18, 2)), 1) = 6.5"),
    ("bool_kleene_and", "events", lambda v: logic.and_(F.nullif(v.value > 5, F.lit(False)), v.k.cast("long") > 50), f"nullif(value > 5, false) AND {_SK} > 50"),
    ("bool_kleene_or", "events", lambda v: logic.or_(F.nullif(v.value > 5, F.lit(False)), v.k.cast("long") > 50), f"nullif(value > 5, false) OR {_SK} > 50"),
    ("bool_implies", "events", lambda v: logic.implies(F.nullif(v.value > 5, F.lit(True)), v.k.cast("long") > 50), f"NOT nullif(value > 5, true) OR {_SK} > 50"),
    ("bool_xor", "events", lambda v: logic.xor(v.value > 5, v.k.cast("long") > 50), f"(value > 5) <> ({_SK} > 50)"),
    ("bool_not", "events", lambda v: logic.not_(v.value > 5), "NOT value > 5"),
    ("iif", "events", lambda v: c.iif(F.nullif(v.value > 5, v.k.cast("long") > 50), F.lit("a"), F.lit("b")), f"CASE WHEN nullif(value > 5, {_SK} > 50) THEN 'a' ELSE 'b' END"),
    ("coalesce", "events", lambda v: c.coalesce(F.nullif(F.col("event_type"), F.lit("error")), F.lit("none")), "coalesce(nullif(event_type, 'error'), 'none')"),
    ("define_variable", "events", lambda v: c.let(v.k.cast("long") * 2, lambda v: v * v + v), f"({_SK} * 2) * ({_SK} * 2) + {_SK} * 2"),
    ("date_year", "orders", lambda v: temporal.year_of(v.day), "CAST(year(o_orderdate) AS INT)"),
    ("date_month", "orders", lambda v: temporal.month_of(v.day), "CAST(month(o_orderdate) AS INT)"),
    ("date_day", "orders", lambda v: temporal.day_of(v.day), "CAST(day(o_orderdate) AS INT)"),
    ("date_hour_of_date_is_empty", "orders", lambda v: temporal.hour_of(v.day), "CAST(NULL AS INT)"),
    ("time_hour", "events", lambda v: temporal.hour_of(v.minute), "CAST(hour(ts) AS INT)"),
    ("time_minute", "events", lambda v: temporal.minute_of(v.minute), "CAST(minute(ts) AS INT)"),
    ("time_second", "events", lambda v: temporal.second_of(v.ms), "CAST(floor(second(ts)) AS INT)"),
    ("time_millisecond", "events", lambda v: temporal.millisecond_of(v.ms), "CAST(millisecond(ts) % 1000 AS INT)"),
    ("time_zone_offset", "events", lambda v: temporal.timezone_offset_of(F.concat(v.minute, v.pick("-05:30", "+02:15"))), f"CASE WHEN {_SK} > 50 THEN -5.5 ELSE 2.25 END::DOUBLE"),
    ("date_of", "events", lambda v: temporal.date_of(v.minute), "strftime(ts, '%Y-%m-%d')"),
    ("time_of", "events", lambda v: temporal.time_of(v.minute), "strftime(ts, '%H:%M')"),
    ("date_precision", "events", lambda v: temporal.precision(v.pick(v.minute, temporal.text_of(F.col("ts"), "month"))).cast("long"), f"CAST(CASE WHEN {_SK} > 50 THEN 12 ELSE 6 END AS BIGINT)"),
    ("date_low_boundary", "orders", lambda v: temporal.low_boundary(temporal.text_of(v.date, "month")), "strftime(o_orderdate, '%Y-%m-01')"),
    ("date_high_boundary", "orders", lambda v: temporal.high_boundary(temporal.text_of(v.date, "month")), "strftime(last_day(o_orderdate), '%Y-%m-%d')"),
    ("datetime_low_boundary", "events", lambda v: temporal.low_boundary(v.minute), "strftime(ts, '%Y-%m-%dT%H:%M') || ':00.000+14:00'"),
    ("datetime_high_boundary", "events", lambda v: temporal.high_boundary(v.minute), "strftime(ts, '%Y-%m-%dT%H:%M') || ':59.999-12:00'"),
    ("decimal_low_boundary", "events", lambda v: temporal.decimal_low_boundary(v.q.cast("string")).cast("double"), "CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) - 0.005"),
    ("decimal_high_boundary", "events", lambda v: temporal.decimal_high_boundary(v.q.cast("string")).cast("double"), "CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) + 0.005"),
    ("date_compare", "orders", lambda v: temporal.compare(v.day, F.lit("2000")), "CASE WHEN year(o_orderdate) < 2000 THEN -1 WHEN year(o_orderdate) > 2000 THEN 1 END"),
    ("date_compare_zone", "events", lambda v: temporal.compare(F.concat(v.minute, F.lit("+02:00")), F.lit("2024-01-02T00:00Z")),
     "CASE WHEN date_trunc('minute', ts) - INTERVAL 2 HOUR < TIMESTAMP '2024-01-02' THEN -1 WHEN date_trunc('minute', ts) - INTERVAL 2 HOUR > TIMESTAMP '2024-01-02' THEN 1 ELSE 0 END"),
    ("date_add_month", "orders", lambda v: temporal.add(v.day, 1, "month"), "strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d')"),
    ("date_add_week", "orders", lambda v: temporal.add(v.day, 2, "week"), "strftime(o_orderdate + INTERVAL 14 DAY, '%Y-%m-%d')"),
    ("date_add_days_to_month", "orders", lambda v: temporal.add(temporal.text_of(v.date, "month"), 61, "day"), "strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m')"),
    ("time_add", "events", lambda v: temporal.add_to_time(temporal.time_of(v.ms), 90, "minute"), "strftime(ts + INTERVAL 90 MINUTE, '%H:%M:%S.%g')"),
    ("duration_days", "orders", lambda v: temporal.duration(v.date, v.since, "day"), f"date_sub('day', {_TWO})"),
    ("duration_hours", "orders", lambda v: temporal.duration(v.date, v.since, "hour"), f"date_sub('hour', {_TWO})"),
    ("difference_days", "orders", lambda v: temporal.difference(v.date, v.since, "day"), f"date_diff('day', {_TWO})"),
    ("difference_months", "orders", lambda v: temporal.difference(v.date, v.since, "month"), f"date_diff('month', {_TWO})"),
    ("difference_years", "orders", lambda v: temporal.difference(v.date, v.since, "year"), f"date_diff('year', {_TWO})"),
    ("difference_weeks", "orders", lambda v: temporal.difference(v.date, v.since, "week"), "CAST(floor((DATE '2000-03-15' - DATE '1970-01-04') / 7.0) - floor((CAST(o_orderdate AS DATE) - DATE '1970-01-04') / 7.0) AS BIGINT)"),
    ("clock", "region", lambda v: F.concat_ws(" ", temporal.now("2024-05-06T07:08:09.010+00:00"), temporal.today("2024-05-06T07:08:09.010"), temporal.time_of_day("2024-05-06T07:08:09.010")),
     "'2024-05-06T07:08:09.010+00:00 2024-05-06 07:08:09.010'"),
    ("quantity_compare", "events", lambda v: quantity.compare(quantity.quantity(v.value, "h"), quantity.quantity(F.lit(600), "minutes")), "CASE WHEN value * 60 < 600 THEN -1 WHEN value * 60 > 600 THEN 1 ELSE 0 END"),
    ("quantity_add", "events", lambda v: quantity.add(quantity.quantity(v.q, "day"), quantity.quantity(F.lit(12), "hour"))["value"].cast("double"), "CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) + 0.5"),
    ("quantity_multiply", "events", lambda v: quantity.multiply(quantity.quantity(v.q, "cm"), quantity.quantity(F.lit(2), v.pick("cm", "kg")))["unit"], f"CASE WHEN {_SK} > 50 THEN 'cm2' ELSE 'cm.kg' END"),
    ("convert_to_integer", "events", lambda v: convert.to_integer(v.k), _SK),
    ("convert_to_integer_fails", "events", lambda v: convert.to_integer(F.concat(F.lit(" "), v.k)), "CAST(NULL AS BIGINT)"),
    ("convert_to_boolean", "labels", lambda v: convert.to_boolean(F.col("toxic")), "toxic = 1"),
    ("convert_to_decimal", "events", lambda v: convert.to_decimal(v.k).cast("double"), f"CAST({_SK} AS DOUBLE)"),
    ("convert_to_string", "events", lambda v: convert.to_string(v.k.cast("long")), f"CAST({_SK} AS VARCHAR)"),
    ("convert_to_date", "events", lambda v: convert.to_date(v.minute), "strftime(ts, '%Y-%m-%d')"),
    ("convert_to_datetime", "events", lambda v: convert.to_datetime(v.minute), "strftime(ts, '%Y-%m-%dT%H:%M')"),
    ("convert_to_time", "events", lambda v: convert.to_time(temporal.time_of(v.minute)), "strftime(ts, '%H:%M')"),
    ("convert_to_quantity", "events", lambda v: convert.to_quantity(F.concat(v.k, v.pick(" days", " 'mg'")))["unit"], f"CASE WHEN {_SK} > 50 THEN 'day' ELSE 'mg' END"),
    ("converts_to_integer", "events", lambda v: convert.converts_to_integer(v.pick(v.k, F.col("event_type"))), f"{_SK} > 50"),
    ("converts_to_date", "events", lambda v: convert.converts_to_date(v.pick(v.minute, F.col("event_type"))), f"{_SK} > 50"),
    ("json_path", "events", lambda v: trees.field(trees.tree(F.col("props")), "k", "bigint"), _SK),
    ("type_is", "events", lambda v: trees.is_type(v.mixed, "Integer"), f"{_SK} > 50"),
    ("type_as", "events", lambda v: trees.as_type(v.mixed, "String"), f"CASE WHEN {_SK} <= 50 THEN event_type END"),
    ("choice", "events", lambda v: sources.choice(valueString=F.nullif(F.col("event_type"), F.lit("error")), valueQuantity=v.k)["type"], "CASE WHEN event_type <> 'error' THEN 'valueString' ELSE 'valueQuantity' END"),
    ("type_of", "events", lambda v: trees.type_of(v.mixed)["name"], f"CASE WHEN {_SK} > 50 THEN 'Integer' ELSE 'String' END"),
    ("compare_less_or_equal", "events", lambda v: logic.less_or_equal(v.k.cast("long"), F.lit(10)), f"{_SK} <= 10"),
    ("compare_greater", "events", lambda v: logic.greater(v.k.cast("long"), F.lit(10)), f"{_SK} > 10"),
    ("arith_negate_least", "events", lambda v: logic.negate(v.pick(F.lit(-(1 << 63)), v.k.cast("long"))), f"CASE WHEN {_SK} <= 50 THEN -{_SK} END"),
    ("arith_divide_large", "events", lambda v: logic.divide(v.k.cast("long") * 20_000_000_000, F.lit(2)).cast("long"), f"{_SK} * 10000000000"),
    ("math_ceiling_large", "events", lambda v: numbers.ceiling(v.pick(F.lit(1e20), v.value)), f"CASE WHEN {_SK} <= 50 THEN CAST(ceil(value) AS BIGINT) END"),
    ("convert_to_long", "events", lambda v: convert.to_long(v.pick(v.k, F.col("event_type"))), f"CASE WHEN {_SK} > 50 THEN {_SK} END"),
    ("converts_to_boolean", "events", lambda v: convert.converts_to_boolean(v.pick(F.lit("yes"), F.col("event_type"))), f"{_SK} > 50"),
    ("converts_to_long", "events", lambda v: convert.converts_to_long(v.pick(v.k, F.col("event_type"))), f"{_SK} > 50"),
    ("converts_to_decimal", "events", lambda v: convert.converts_to_decimal(v.pick(F.concat(v.k, F.lit(".50")), F.concat(v.k, F.lit("e1")))), f"{_SK} > 50"),
    ("converts_to_string", "events", lambda v: convert.converts_to_string(F.nullif(v.k.cast("long"), F.lit(7).cast("long"))), f"CASE WHEN {_SK} <> 7 THEN true END"),
    ("converts_to_datetime", "events", lambda v: convert.converts_to_datetime(v.pick(v.ms, F.concat(v.ms, F.lit("x")))), f"{_SK} > 50"),
    ("converts_to_time", "events", lambda v: convert.converts_to_time(v.pick(temporal.time_of(v.ms), v.ms)), f"{_SK} > 50"),
    ("converts_to_quantity", "events", lambda v: convert.converts_to_quantity(F.concat(v.k, v.pick(" days", " moons"))), f"{_SK} > 50"),
    ("quantity_subtract", "events", lambda v: quantity.subtract(quantity.quantity(v.q, "day"), quantity.quantity(F.lit(12), "hour"))["value"].cast("double"), "CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) - 0.5"),
    ("quantity_divide", "events", lambda v: quantity.divide(quantity.quantity(v.k, "cm2"), quantity.quantity(F.lit(4), v.pick("cm", "cm2")))["unit"], f"CASE WHEN {_SK} > 50 THEN 'cm' ELSE '1' END"),
    ("quantity_equivalent", "events", lambda v: quantity.equivalent(quantity.quantity(v.k.cast("long") % 3, v.pick("day", "kg")), quantity.quantity(F.lit(24), "hour")), f"{_SK} > 50 AND {_SK} % 3 = 1"),
    ("quantity_div", "events", lambda v: quantity.div(quantity.quantity(v.k, "hour"), quantity.quantity(F.lit(90), v.pick("minute", "kg")))["value"].cast("long"), f"CASE WHEN {_SK} > 50 THEN {_SK} * 60 // 90 END"),
    ("quantity_mod", "events", lambda v: quantity.mod(quantity.quantity(v.k, "hour"), quantity.quantity(F.lit(90), v.pick("minute", "kg")))["value"].cast("double"), f"CASE WHEN {_SK} > 50 THEN ({_SK} * 60 % 90) / 60.0 END"),
    ("quantity_comparable", "events", lambda v: quantity.comparable(quantity.quantity(v.k, "hour"), quantity.quantity(F.lit(90), v.pick("minute", "kg"))), f"{_SK} > 50"),
    ("extension", "events", lambda v: F.get(c.extension(v.primitive, "http://k"), F.lit(0))["value"], f"CASE WHEN {_SK} > 50 THEN CAST({_SK} AS VARCHAR) END"),
    ("has_value", "events", lambda v: c.has_value(v.primitive), f"CASE WHEN event_type <> 'error' THEN true WHEN {_SK} > 50 THEN false END"),
    ("get_value", "events", lambda v: c.get_value(v.primitive), "nullif(event_type, 'error')"),
    ("datetime_add_minutes", "events", lambda v: temporal.add(v.pick(v.minute, v.ms), 90, "minute"), f"CASE WHEN {_SK} > 50 THEN strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M') ELSE strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S.%g') END"),
    ("datetime_add_column", "events", lambda v: temporal.add(v.ms, v.k.cast("long"), "second"), f"strftime(ts + to_seconds({_SK}), '%Y-%m-%dT%H:%M:%S.%g')"),
    ("date_add_column", "orders", lambda v: temporal.add(v.day, F.col("o_custkey") % 25, "month"), "strftime(o_orderdate + to_months(CAST(o_custkey % 25 AS INT)), '%Y-%m-%d')"),
    ("time_low_boundary", "events", lambda v: temporal.low_boundary(v.pick(temporal.time_of(v.minute), v.minute), 6), f"CASE WHEN {_SK} > 50 THEN strftime(ts, '%H:%M') || ':00' ELSE strftime(ts, '%Y-%m') END"),
    ("time_high_boundary", "events", lambda v: temporal.high_boundary(temporal.time_of(v.minute)), "strftime(ts, '%H:%M') || ':59.999'"),
    ("date_boundary_precision", "orders", lambda v: temporal.high_boundary(temporal.text_of(v.date, "year"), 6), "year(o_orderdate) || '-12'"),
    ("decimal_boundary_precision", "events", lambda v: F.round(temporal.decimal_high_boundary(v.q.cast("string"), 1).cast("double"), 1), "CAST(ceil((CAST(value AS DECIMAL(18, 3)) + 0.005) * 10) AS DOUBLE) / 10"),
    ("vector_count_positive", "embeddings", lambda v: c.count(c.where(F.col("embedding"), lambda e: e > 0)), "CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT)"),
]
_KEYS["region"] = "r_regionkey"


def _scalar(name: str, source: str, column: Expression, sql: str) -> None:
    key = _KEYS[source]
    QUERIES[name] = lambda s, d: table(s, d, source).select(key, column(Columns()).alias("value"))
    SQL[name] = f"SELECT {key}, {sql} AS value FROM {source}"


# Collections: `item` of each order. Items in order are CTE `li` on the SQL side.
_LI = """WITH li AS (SELECT *, l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS i FROM lineitem) """
_PER = "SELECT o_orderkey, {} AS value FROM orders LEFT JOIN li USING (o_orderkey) GROUP BY o_orderkey"
_FIRST = "SELECT o.o_orderkey, l_partkey AS value FROM orders o LEFT JOIN li ON li.o_orderkey = o.o_orderkey AND {}"

#: One value for each order: (name, column, SQL after the CTE).
PER_ORDER: list[tuple[str, Expression, str]] = [
    ("count", lambda v: c.count(v.item), _PER.format("count(i)")),
    ("empty", lambda v: c.empty(v.item), _PER.format("count(i) = 0")),
    ("exists", lambda v: c.exists(v.item), _PER.format("count(i) > 0")),
    ("exists_criteria", lambda v: c.exists(v.item, lambda e: e["l_discount"] > 0.09), _PER.format("coalesce(bool_or(l_discount > 0.09), false)")),
    ("all_criteria", lambda v: c.all_(v.item, lambda e: e["l_quantity"] < 50), _PER.format("coalesce(bool_and(l_quantity < 50), true)")),
    ("sum", lambda v: F.round(c.sum_(v.quantity), 2), _PER.format("round(sum(l_quantity), 2)")),
    ("avg", lambda v: F.round(c.avg(v.quantity), 6), _PER.format("round(avg(l_quantity), 6)")),
    ("min", lambda v: c.min_(v.quantity), _PER.format("min(l_quantity)")),
    ("max", lambda v: c.max_(v.quantity), _PER.format("max(l_quantity)")),
    ("aggregate", lambda v: c.aggregate(v.quantity, lambda t, e: t + e, F.lit(0.0)), _PER.format("coalesce(sum(l_quantity), 0.0)")),
    ("all_true", lambda v: c.all_true(c.select(v.item, lambda e: e["l_quantity"] > 5)), _PER.format("coalesce(bool_and(l_quantity > 5), true)")),
    ("any_true", lambda v: c.any_true(c.select(v.item, lambda e: e["l_quantity"] > 45)), _PER.format("coalesce(bool_or(l_quantity > 45), false)")),
    ("all_false", lambda v: c.all_false(c.select(v.item, lambda e: e["l_quantity"] > 45)), _PER.format("coalesce(bool_and(l_quantity <= 45), true)")),
    ("any_false", lambda v: c.any_false(c.select(v.item, lambda e: e["l_quantity"] > 45)), _PER.format("coalesce(bool_or(l_quantity <= 45), false)")),
    ("first", lambda v: c.first(v.part), _FIRST.format("i = 0")),
    ("last", lambda v: c.last(v.part), _FIRST.format("i = (SELECT count(*) - 1 FROM lineitem x WHERE x.l_orderkey = o.o_orderkey)")),
    ("indexer", lambda v: c.item_at(v.part, 2), _FIRST.format("i = 2")),
    ("is_distinct", lambda v: c.is_distinct(v.flag), _PER.format("count(l_returnflag) = count(DISTINCT l_returnflag)")),
    ("in", lambda v: c.in_(F.lit("R"), v.flag), _PER.format("coalesce(bool_or(l_returnflag = 'R'), false)")),
    ("contains", lambda v: c.contains(v.flag, F.lit("A")), _PER.format("coalesce(bool_or(l_returnflag = 'A'), false)")),
    ("subset_of", lambda v: c.subset_of(v.big, v.even), _PER.format("coalesce(bool_and(l_quantity <= 25 OR l_returnflag IN (SELECT x.l_returnflag FROM li x WHERE x.o_orderkey = li.o_orderkey AND x.i % 2 = 0)), true)")),
    ("superset_of", lambda v: c.superset_of(v.big, v.even), _PER.format("coalesce(bool_and(i % 2 = 1 OR l_returnflag IN (SELECT x.l_returnflag FROM li x WHERE x.o_orderkey = li.o_orderkey AND x.l_quantity > 25)), true)")),
    ("equal", lambda v: c.equal(v.flag, F.reverse(v.flag)), _PER.format("CASE WHEN count(i) > 0 THEN list(l_returnflag ORDER BY i) = list(l_returnflag ORDER BY i DESC) END")),
    ("equivalent", lambda v: c.equivalent(v.big, v.even), _PER.format("coalesce(list_sort(list(l_returnflag) FILTER (WHERE l_quantity > 25)), []) = coalesce(list_sort(list(l_returnflag) FILTER (WHERE i % 2 = 0)), [])")),
    ("coalesce_items", lambda v: c.count(c.coalesce_items(c.where(v.item, lambda e: e["l_quantity"] > 45), v.item)), _PER.format("CASE WHEN count(*) FILTER (WHERE l_quantity > 45) > 0 THEN count(*) FILTER (WHERE l_quantity > 45) ELSE count(i) END")),
    ("pruned_exists", lambda v: c.exists(leaves(v.item, "l_quantity", "l_discount"), lambda e: (e["l_quantity"] > 40) & (e["l_discount"] > 0.05)), _PER.format("coalesce(bool_or(l_quantity > 40 AND l_discount > 0.05), false)")),
]

_LIST = "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY {}) - 1 AS ord, {} AS value FROM li {}"
_FIRSTS = "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY p) - 1 AS ord, value FROM (SELECT o_orderkey, value, min(p) AS p FROM ({}) GROUP BY o_orderkey, value)"
_A, _B = "SELECT o_orderkey, l_returnflag AS value, i AS p FROM li WHERE l_quantity > 25", "SELECT o_orderkey, l_returnflag AS value, i + 1000 AS p FROM li WHERE i % 2 = 0"

#: A collection for each order, as rows (o_orderkey, ord, value).
COLLECTIONS: list[tuple[str, Expression, str]] = [
    ("where_select", lambda v: c.select(c.where(v.item, lambda e: e["l_quantity"] > 45), lambda e: e["l_partkey"]), _LIST.format("i", "l_partkey", "WHERE l_quantity > 45")),
    ("select", lambda v: c.select(v.item, lambda e: e["l_quantity"] * 2), _LIST.format("i", "l_quantity * 2", "")),
    ("index_variable", lambda v: c.select(c.where(v.item, lambda e, i: i % 2 == 0), lambda e: e["l_partkey"]), _LIST.format("i", "l_partkey", "WHERE i % 2 = 0")),
    ("tail", lambda v: c.tail(v.part), _LIST.format("i", "l_partkey", "WHERE i > 0")),
    ("skip_take", lambda v: c.take(c.skip(v.part, 1), 2), _LIST.format("i", "l_partkey", "WHERE i BETWEEN 1 AND 2")),
    ("sort_descending", lambda v: c.select(c.sort(v.item, (lambda e: e["l_quantity"], True)), lambda e: e["l_partkey"]), _LIST.format("l_quantity DESC, i", "l_partkey", "")),
    ("sort_two_keys", lambda v: c.select(c.sort(v.item, (lambda e: e["l_returnflag"], False), (lambda e: e["l_quantity"], True)), lambda e: e["l_partkey"]), _LIST.format("l_returnflag, l_quantity DESC, i", "l_partkey", "")),
    ("top_three", lambda v: c.take(c.sort(v.item, (lambda e: e["l_extendedprice"], True)), 3)["l_partkey"], "SELECT o_orderkey, ord, value FROM (" + _LIST.format("l_extendedprice DESC, i", "l_partkey", "") + ") WHERE ord < 3"),
    ("distinct", lambda v: c.distinct(v.flag), _FIRSTS.format("SELECT o_orderkey, l_returnflag AS value, i AS p FROM li")),
    ("union", lambda v: c.union(v.big, v.even), _FIRSTS.format(f"{_A} UNION ALL {_B}")),
    ("combine", lambda v: c.combine(v.big, v.even), f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY p) - 1 AS ord, value FROM ({_A} UNION ALL {_B})"),
    ("intersect", lambda v: c.intersect(v.big, v.even), _FIRSTS.format(f"SELECT * FROM ({_A}) a WHERE EXISTS (SELECT 1 FROM ({_B}) b WHERE a.o_orderkey = b.o_orderkey AND a.value = b.value)")),
    ("exclude", lambda v: c.exclude(v.big, v.even), f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY p) - 1 AS ord, value FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_B}) b WHERE a.o_orderkey = b.o_orderkey AND a.value = b.value)"),
]


def _per_order(name: str, column: Expression, sql: str) -> None:
    QUERIES[name] = lambda s, d: order_documents(s, d).select("o_orderkey", column(Columns()).alias("value"))
    SQL[name] = _LI + sql


def _collection(name: str, column: Expression, sql: str) -> None:
    QUERIES[name] = lambda s, d: order_documents(s, d).select("o_orderkey", F.posexplode(column(Columns())).alias("ord", "value")).withColumn("ord", F.col("ord").cast("long"))
    SQL[name] = _LI + sql


for _row in SCALARS:
    _scalar(*_row)
for _row in PER_ORDER:
    _per_order(*_row)
for _row in COLLECTIONS:
    _collection(*_row)


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


@_add("select_many", "SELECT o_custkey AS c_custkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def select_many(s: SparkSession, d: str) -> DataFrame:
    parts = c.select_many(F.col("order"), lambda o: c.select(o["item"], lambda e: e["l_partkey"]))
    return customer_documents(s, d).select("c_custkey", c.count(parts).alias("n"), c.sum_(parts, "long").alias("parts")).where("n > 0")


@_add("single", "SELECT c_custkey, min(o_orderkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <= 1")
def single(s: SparkSession, d: str) -> DataFrame:
    docs = customer_documents(s, d).where(c.count(F.col("order")) <= 1)
    return docs.select("c_custkey", c.single(F.col("order"))["o_orderkey"].alias("value"))


@_add("typed_result", _LI + "SELECT o_orderkey, i AS ord, 'System.String' AS type, l_returnflag AS value FROM li")
def typed_result(s: SparkSession, d: str) -> DataFrame:
    v = Columns()
    return sources.typed_rows(order_documents(s, d), "o_orderkey", v.flag, "System.String")


@_add("children", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def children(s: SparkSession, d: str) -> DataFrame:
    kids = trees.children(table(s, d, "events").select("event_id", trees.tree(F.col("props")).alias("v")), "v", "event_id")
    return kids.select("event_id", "key", F.try_variant_get("value", "$", "string").alias("value"))


@_add("descendants", "SELECT event_id, level, key, value FROM (SELECT event_id, 1 AS level, 'a' AS key, NULL AS value FROM events UNION ALL SELECT event_id, 2, 'b', json_extract_string(props, '$.k') FROM events UNION ALL SELECT event_id, 2, 'b', 'x' FROM events)")
def descendants(s: SparkSession, d: str) -> DataFrame:
    v = Columns()
    text = F.concat(F.lit('{"a":{"b":['), v.k, F.lit(',"x"]}}'))
    found = trees.descendants(table(s, d, "events").select("event_id", trees.tree(text).alias("v")), "v", "event_id")
    plain = F.when(~F.schema_of_variant("value").startswith("OBJECT"), F.try_variant_get("value", "$", "string"))
    return found.select("event_id", "level", "key", plain.alias("value"))


@_add("repeat", "SELECT c_custkey AS root, 'n' || n_nationkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def repeat(s: SparkSession, d: str) -> DataFrame:
    customers, nations = table(s, d, "customer"), table(s, d, "nation")
    up = customers.selectExpr("concat('c', c_custkey) src", "concat('n', c_nationkey) dst").union(nations.selectExpr("concat('n', n_nationkey) src", "concat('r', n_regionkey) dst"))
    return rows.repeat(customers.selectExpr("c_custkey root", "concat('c', c_custkey) node"), up)


@_add("reference_join", "SELECT o_orderkey, c_name AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def reference_join(s: SparkSession, d: str) -> DataFrame:
    targets = table(s, d, "customer").select("c_custkey", "c_name")
    return rows.resolve(table(s, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey"), targets, "c_custkey").select("o_orderkey", F.col("c_name").alias("value"))


@_add("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def semi_join(s: SparkSession, d: str) -> DataFrame:
    return rows.intersect_rows(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").selectExpr("o_custkey c_custkey"), ["c_custkey"])


@_add("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(s: SparkSession, d: str) -> DataFrame:
    return rows.exclude_rows(table(s, d, "customer").select("c_custkey"), table(s, d, "orders").selectExpr("o_custkey c_custkey"), ["c_custkey"])


@_add("rows_skip_take", _LI + "SELECT o_orderkey, i AS ord, l_partkey AS item FROM li WHERE i BETWEEN 1 AND 2")
def rows_skip_take(s: SparkSession, d: str) -> DataFrame:
    v = Columns()
    found = rows.first_rows(rows.rows_of(order_documents(s, d), "o_orderkey", v.part), "o_orderkey", 2, 1)
    return found.withColumn("ord", F.col("ord").cast("long"))


@_add("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 8) AS discount FROM lineitem GROUP BY ALL")
def group_by(s: SparkSession, d: str) -> DataFrame:
    grouped = table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 8).alias("discount"))


@_add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@_add("running_fold", _LI + "SELECT o_orderkey, i AS ord, round(sum(l_quantity) OVER (PARTITION BY o_orderkey ORDER BY i), 2) AS value FROM li")
def running_fold(s: SparkSession, d: str) -> DataFrame:
    v = Columns()
    from pyspark.sql import Window

    items = rows.rows_of(order_documents(s, d), "o_orderkey", v.quantity)
    total = F.sum("item").over(Window.partitionBy("o_orderkey").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return items.select("o_orderkey", F.col("ord").cast("long").alias("ord"), F.round(total, 2).alias("value"))


@_add("windowed_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(s: SparkSession, d: str) -> DataFrame:
    return streaming.windowed(table(s, d, "events")).withColumn("total", F.round("total", 2))


@_add("sessions", """WITH o AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM o)
SELECT min(ts) AS start, user_id, count(*) AS n FROM g GROUP BY user_id, session""")
def sessions(s: SparkSession, d: str) -> DataFrame:
    return streaming.sessions(table(s, d, "events"))


@_add("repeat_all", "SELECT c_custkey AS root, 'n' || n_nationkey AS node FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey")
def repeat_all(s: SparkSession, d: str) -> DataFrame:
    customers, nations = table(s, d, "customer"), table(s, d, "nation")
    up = customers.selectExpr("concat('c', c_custkey) src", "concat('n', c_nationkey) dst").union(nations.selectExpr("concat('n', n_nationkey) src", "concat('r', n_regionkey) dst"))
    return rows.repeat(customers.selectExpr("c_custkey root", "concat('c', c_custkey) node"), up, distinct=False)
