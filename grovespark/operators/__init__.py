"""Collections as rows: the same operators for collections too large or too skewed for one row, keyed (document, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def rows_of(df: DataFrame, key: str, c: Column, name: str = "item") -> DataFrame:
    """A row (key, ord, item) for each item."""
    return df.select(key, F.posexplode(c).alias("ord", name))


def first_rows(rows: DataFrame, key: str, n: int = 1, skip: int = 0) -> DataFrame:
    """Items skip to skip + n of each document, by ord."""
    at = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    return rows.withColumn("__at", at).where((F.col("__at") > skip) & (F.col("__at") <= skip + n)).drop("__at")


def intersect_rows(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose values b has."""
    return a.join(b.select(*on).distinct(), on, "left_semi")


def exclude_rows(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose values b lacks, repeats kept."""
    return a.join(b.select(*on), on, "left_anti")


def resolve(df: DataFrame, reference: Column, targets: DataFrame, target_key: str) -> DataFrame:
    """Each row with the document its reference names, none if it names none."""
    return df.withColumn("__ref", reference).join(targets.withColumnRenamed(target_key, "__ref"), "__ref", "left").withColumnRenamed("__ref", target_key)


def repeat(seed: DataFrame, edges: DataFrame, *, distinct: bool = True) -> DataFrame:
    """Rows (root, node) reached from the seed's (root, node) by edges (src, dst), without the seed itself.

    distinct: each node once for a root, so cycles end; otherwise every path counts and cycles don't end. Each level is a
    written table of its own, so neither rows nor levels are bounded."""

    def step(near: DataFrame) -> DataFrame:
        far = near.alias("t").join(edges.alias("e"), F.col("e.src") == F.col("t.node")).select("t.root", F.col("e.dst").alias("node"))
        return far.distinct() if distinct else far

    level = found = saved(step(seed), "level")
    while level.limit(1).count():
        level = step(level)
        if distinct:
            new = F.col("t.root").eqNullSafe(F.col("f.root")) & (F.col("t.node") == F.col("f.node"))
            level = level.where("node IS NOT NULL").alias("t").join(found.alias("f"), new, "left_anti")
        level = saved(level, "level")
        found = found.union(level)
    return found
