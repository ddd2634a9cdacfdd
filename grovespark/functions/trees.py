"""Untyped trees: documents held as variants, navigated without a declared schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved


def tree(json: Column) -> Column:
    """A JSON text as a variant; empty if it is none."""
    return F.try_parse_json(json)


def field(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as a.b[0], empty if missing or of another kind."""
    return F.try_variant_get(v, "$." + path, kind)


def type_of(v: Column) -> Column:
    """struct<namespace, name> of a variant's value, by its kind."""
    kind = F.schema_of_variant(v)
    name = (
        F.when(kind == "BOOLEAN", "Boolean").when(kind == "BIGINT", "Integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "Decimal")
        .when(kind == "STRING", "String").otherwise("Any")
    )
    return F.when(v.isNotNull() & (kind != "VOID"), F.struct(F.lit("System").alias("namespace"), name.alias("name")))


def is_type(v: Column, name: str) -> Column:
    return type_of(v)["name"] == name


def as_type(v: Column, name: str) -> Column:
    """The value if it has the type, as text; empty otherwise."""
    return F.when(is_type(v, name), F.try_variant_get(v, "$", "string"))


def children(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows (keys, key, value) of each object's fields or each array's items; key is null for items."""
    own = ", ".join(f"`{k}`" for k in keys)
    return df.sparkSession.sql(f"SELECT {own}, e.key, e.value FROM {{df}}, LATERAL variant_explode(`{column}`) AS e", df=df)


def descendants(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Rows (keys, level, key, value) of all nodes below, arrays passed through as no nodes of their own.

    Each level is a written table of its own, so neither rows nor levels are bounded."""
    spark = df.sparkSession
    own = "".join(f"`{k}`, " for k in keys)
    level = saved(spark.sql(f"SELECT {own}1 AS level, e.key, e.value FROM {{df}}, LATERAL variant_explode(`{column}`) AS e", df=df), "level")
    found = level
    while level.limit(1).count():
        inner = "".join(f"t.`{k}`, " for k in keys)
        step = f"""SELECT {inner}t.level + if(schema_of_variant(t.value) LIKE 'ARRAY%', 0, 1) AS level, coalesce(e.key, t.key) AS key, e.value
          FROM {{level}} t, LATERAL variant_explode(t.value) AS e"""
        level = saved(spark.sql(step, level=level), "level")
        found = found.union(level)
    return found.where("schema_of_variant(value) NOT LIKE 'ARRAY%'")
