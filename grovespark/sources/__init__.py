"""Documents in, results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, *, exact_numbers: bool = False) -> DataFrame:
    """Documents of a JSON-lines path, with a declared schema so that only one pass is made. exact_numbers keeps each
    number's text, trailing zeros included; the schema then has strings in their place."""
    return spark.read.schema(schema).option("primitivesAsString", exact_numbers).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | str) -> DataFrame:
    """Documents of an XML path; an element's attributes are fields of the same name with no mark before them."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").schema(schema).load(path)


def from_json(text: Column, schema: T.StructType | str) -> Column:
    return F.from_json(text, schema)


def merged_primitive(value: Column, more: Column) -> Column:
    """struct<value, id, extension> of a primitive field and its companion of metadata (`_name`); empty if both are."""
    both = F.struct(value.alias("value"), more["id"].alias("id"), more["extension"].alias("extension"))
    return F.when(value.isNotNull() | more.isNotNull(), both)


def merged_primitives(values: Column, more: Column) -> Column:
    """The same for two parallel arrays, by position; places that are empty in both go."""
    merged = F.zip_with(F.coalesce(values, F.expr("array()")), F.coalesce(more, F.expr("array()")), merged_primitive)
    return F.when(values.isNotNull() & more.isNotNull(), F.array_compact(merged)).otherwise(
        F.coalesce(F.transform(values, lambda v: merged_primitive(v, F.lit(None).cast("struct<id:string,extension:array<string>>"))), F.expr("array()"))
    )


def choice(**variants: Column) -> Column:
    """The first present variant of a choice element, as struct<type, value string>."""
    options = [F.when(c.isNotNull(), F.struct(F.lit(k).alias("type"), c.cast("string").alias("value"))) for k, c in variants.items()]
    return F.coalesce(*options)


def typed_rows(df: DataFrame, key: str, c: Column, kind: str) -> DataFrame:
    """A collection as rows (key, ord, type, value), in order: the result sink of one expression."""
    exploded = df.select(key, F.posexplode(c).alias("ord", "value"))
    return exploded.select(key, F.col("ord").cast("long"), F.lit(kind).alias("type"), F.col("value").cast("string").alias("value"))


def json_result(c: Column) -> Column:
    """A collection as JSON text."""
    return F.to_json(c)
