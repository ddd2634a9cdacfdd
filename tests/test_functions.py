"""Cases of single functions: empty collections, partial dates, units, and reads and streams."""

import json

import pytest
from grovespark import operators, plans, sources, streaming
from grovespark.functions import collections as c
from grovespark.functions import convert, logic, quantity, strings, temporal, trees
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


def text(s):
    return F.lit(s).cast("string")


def test_empty_and_null_collections(spark):
    none, gone = F.array().cast("array<int>"), F.lit(None).cast("array<int>")
    for x in (none, gone):
        assert value(spark, c.count(x)) == 0 and value(spark, c.empty(x)) and not value(spark, c.exists(x))
        assert value(spark, c.all_(x, lambda e: e > 1)) is True and value(spark, c.first(x)) is None
        assert value(spark, c.sum_(x)) is None and value(spark, c.all_true(x.cast("array<boolean>"))) is True
    assert value(spark, c.equal(none, none)) is None and value(spark, c.equivalent(none, none)) is True


def test_unknown_criteria_drop_items(spark):
    x = F.array(F.lit(1), F.lit(None).cast("int"), F.lit(3))
    assert value(spark, c.where(x, lambda e: e > 1)) == [3]
    assert value(spark, c.all_(x, lambda e: e > 0)) is False
    assert value(spark, c.select(x, lambda e: e + 1)) == [2, 4]
    assert value(spark, c.exclude(F.array(*map(F.lit, [1, 1, 2])), F.array(F.lit(2)))) == [1, 1]


def test_single_of_several_fails(spark):
    assert value(spark, c.single(F.array(F.lit(4)))) == 4
    with pytest.raises(Exception, match="single item"):
        value(spark, c.single(F.array(F.lit(4), F.lit(5))))


def test_sort_is_stable_and_puts_empty_keys_low(spark):
    rows = F.array(*(F.struct(F.lit(a).cast("int").alias("a"), F.lit(b).alias("b")) for a, b in [(2, "x"), (None, "y"), (1, "z"), (2, "w")]))
    assert [r["b"] for r in value(spark, c.sort(rows, (lambda e: e["a"], False)))] == ["y", "z", "x", "w"]
    assert [r["b"] for r in value(spark, c.sort(rows, (lambda e: e["a"], True)))] == ["x", "w", "z", "y"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("2020", "2021", -1), ("2020-05", "2020", None), ("2020-05", "2019", 1), ("2020-05-01", "2020-05-01", 0), ("2020-05-01T10:00Z", "2020-05-01T12:00+02:00", 0),
        ("2020-05-01T10:00", "2020-05-01T10:00Z", None), ("2020-05-01T23:30-02:00", "2020-05-02T01:00Z", 1), ("10:30", "10:30:00", None), ("09:59", "10:00", -1),
    ],
)
def test_partial_dates_compare(spark, a, b, want):
    assert value(spark, temporal.compare(text(a), text(b))) == want


def test_dates_move_and_bound(spark):
    assert value(spark, temporal.add(text("2020-01-31"), 1, "month")) == "2020-02-29"
    assert value(spark, temporal.add(text("2020"), 18, "month")) == "2021"
    assert value(spark, temporal.add(text("2020-01-31T23:59:30Z"), 45, "second")) == "2020-02-01T00:00:15Z"
    assert value(spark, temporal.add_to_time(text("23:30"), 45, "minute")) == "00:15"
    assert value(spark, temporal.high_boundary(text("2023-02"))) == "2023-02-28"
    assert value(spark, temporal.low_boundary(text("2020-05-01T10"))) == "2020-05-01T10:00:00.000+14:00"
    assert str(value(spark, temporal.decimal_high_boundary(text("1.0")))) == "1.05000000"


def test_parts_of_texts_mention_their_text_once(spark):
    for s, want in (("2020-05-17T10:30-05:30", -5.5), ("2020-05T10+99:99", 100.65), ("10:30Z", 0.0), ("2020-05-17", None), ("2020-05-17T10:30-05:30x", None), ("-05:30", -5.5)):
        assert value(spark, temporal.timezone_offset_of(text(s))) == want
    assert value(spark, temporal.add_to_time(text("T01"), -2, "hour")) == "23:"
    given = F.date_format(F.timestamp_seconds("id"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    for column in (temporal.hour_of(given), temporal.timezone_offset_of(given), temporal.add_to_time(given, 1, "hour")):
        plan = spark.range(3).select(column.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("date_format(") == 1


def test_quantities_convert_clock_units_only(spark):
    q = quantity.quantity
    assert value(spark, quantity.equal(q(F.lit(60), "min"), q(F.lit(1), "hour"))) is True
    assert value(spark, quantity.compare(q(F.lit(1), "mg"), q(F.lit(1), "g"))) is None
    assert float(value(spark, quantity.add(q(F.lit(1), "week"), q(F.lit(1), "day")))["value"]) == pytest.approx(1 + 1 / 7, abs=1e-7)
    assert value(spark, quantity.divide(q(F.lit(6), "cm2"), q(F.lit(3), "cm")))["unit"] == "cm"


@pytest.mark.parametrize("s", ["1e3", " 1", "1.", "0x1", "", "1.5"])
def test_integers_are_digits_only(spark, s):
    assert value(spark, convert.to_integer(text(s))) is None


def test_conversions(spark):
    assert value(spark, convert.to_quantity(text("4 'mg'"))).asDict()["unit"] == "mg"
    assert value(spark, convert.to_quantity(text("3 days"), "week")) is None
    assert value(spark, convert.to_date(text("2020-13"))) is None and value(spark, convert.to_date(text("2020-12"))) == "2020-12"
    assert value(spark, convert.converts_to_boolean(text(None))) is None


def test_arithmetic_edges(spark):
    assert str(value(spark, logic.divide(F.lit(-10), F.lit(3)))) == "-3.33333333"
    assert value(spark, logic.divide(F.lit(1), F.lit(0))) is None
    assert value(spark, logic.add(F.lit(2**63 - 1).cast("long"), F.lit(1).cast("long"))) is None
    assert value(spark, logic.mod(F.lit(-7), F.lit(3))) == -1


def test_text_edges(spark):
    assert value(spark, strings.substring(text("abc"), 3)) is None and value(spark, strings.substring(text(""), 0)) == ""
    assert value(spark, strings.last_index_of(text("abcabc"), F.lit("bc"))) == 4
    assert value(spark, strings.replace(text("ab"), "", "x")) == "xaxbx"
    assert value(spark, strings.matches_full(text("ab"), "a|ab")) is True
    assert value(spark, strings.decode(text("zz"), "hex")) is None and value(spark, strings.encode(text("a"), "other")) is None


def test_merged_primitives_and_choices(spark):
    schema = "given array<string>, _given array<struct<id:string,extension:array<string>>>, valueString string, valueQuantity struct<value:int>"
    docs = [{"given": ["a", None], "_given": [None, {"id": "x"}], "valueQuantity": {"value": 3}}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(sources.from_json(F.col("j"), schema).alias("d")).select("d.*")
    got = df.select(sources.merged_primitives(F.col("given"), F.col("_given")).alias("g"), sources.choice(valueString=F.col("valueString"), valueQuantity=F.col("valueQuantity.value")).alias("c")).collect()[0]
    assert [(r["value"], r["id"]) for r in got["g"]] == [("a", None), (None, "x")] and got["c"]["type"] == "valueQuantity"


def test_json_and_xml_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"v": 98.600000}\n')
    (tmp_path / "a.xml").write_text('<rows><row id="1"><name value="x"/><name value="y"/></row></rows>')
    assert sources.read_json(spark, str(tmp_path / "a.json"), "v string", exact_numbers=True).collect()[0]["v"] == "98.600000"
    rows = sources.read_xml(spark, str(tmp_path / "a.xml"), "row", "_id long, name array<struct<_value:string>>").select(F.col("name._value").alias("n")).collect()
    assert rows[0]["n"] == ["x", "y"]


def test_trees(spark):
    df = spark.createDataFrame([(1, '{"a":[1,{"b":true}],"c":"x"}')], "id int, j string").select("id", trees.tree(F.col("j")).alias("v"))
    assert sorted(r["key"] for r in trees.children(df, "v", "id").collect()) == ["a", "c"]
    levels = sorted((r["level"], r["key"]) for r in trees.descendants(df, "v", "id").collect())
    assert levels == [(1, "a"), (1, "a"), (1, "c"), (2, "b")]


def test_repeat_ends_on_cycles(spark):
    seed = spark.createDataFrame([(1, "a")], "root int, node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert sorted(r["node"] for r in operators.repeat(seed, edges).collect()) == ["a", "b", "c"]


def test_trees_and_repeat_are_not_bounded_by_limits_of_recursion(spark):
    limits = {"spark.sql.cteRecursionRowLimit": "5", "spark.sql.cteRecursionLevelLimit": "2"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        df = spark.createDataFrame([(i, '{"a":{"b":{"c":{"d":1}}}}') for i in range(20)], "id int, j string").select("id", trees.tree(F.col("j")).alias("v"))
        assert sorted((r["id"], r["level"], r["key"]) for r in trees.descendants(df, "v", "id").collect()) == [(i, n + 1, k) for i in range(20) for n, k in enumerate("abcd")]
        seed = spark.createDataFrame([(1, 0), (2, 3), (None, 4)], "root int, node int")
        edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 3)], "src int, dst int")
        got = [(r["root"], r["node"]) for r in operators.repeat(seed, edges).collect()]
        assert sorted(got, key=str) == sorted([*((1, n) for n in range(1, 6)), *((r, n) for r in (2, None) for n in range(3, 6))], key=str)
    finally:
        for k in limits:
            spark.conf.unset(k)


def test_leaves_prune_the_read(spark, tmp_path):
    spark.range(3).select(F.array(F.struct(F.col("id").alias("a"), F.lit("x").alias("b"), F.lit(1.5).alias("z"))).alias("item")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = df.select(c.exists(plans.leaves(F.col("item"), "a"), lambda e: e["a"] > 1))._jdf.queryExecution().executedPlan().toString()
    assert "item:array<struct<a:bigint>>" in plan


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_events(spark, str(tmp_path / "in"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    projected = stream.select("event_id", trees.field(trees.tree(F.col("props")), "k", "bigint").alias("k"))
    streaming.run_available(projected, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    streaming.run_available(streaming.windowed(stream, late="0 seconds"), str(tmp_path / "out2"), str(tmp_path / "cp2"))
    done = {(r["start"], r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert done <= {(r["start"], r["event_type"], r["n"]) for r in streaming.windowed(events).collect()}
    assert streaming.sessions(events).agg(F.sum("n")).collect()[0][0] == events.count()


def test_whole_texts_are_read_beyond_their_heads(spark, tmp_path):
    from grovespark.queries import QUERIES

    text = "a b " * 20 + 'én <&> "e" \\ \n\t end'
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def got(name):
        df = QUERIES[name](spark, str(tmp_path))
        key = next(c for c in df.columns if c == "doc_id" or c == "key")
        value = next(c for c in df.columns if c != key)
        return {r[key]: r[value] for r in df.collect()}[1]

    for name in ("decode_hex", "decode_base64", "decode_urlbase64", "unescape_html", "unescape_json"):
        assert got(name) == text
    assert got("encode_hex") == text.encode().hex() and got("string_to_chars") == len(text)
    assert got("string_last_index_of") == text.rindex("e") and got("string_join_split") == text.replace(" ", "|")
