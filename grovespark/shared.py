"""Tables written between steps, to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where the session names none and
    runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(df: DataFrame, tag: str) -> str:
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _delete(spark: SparkSession, path: str, on_exit: bool) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if on_exit:
        files.deleteOnExit(where)
    else:
        files.delete(where, True)


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends, as a result that is still lazy may read them."""
    path = _path(df, tag)
    _delete(df.sparkSession, path, on_exit=True)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Saved tables of one piece of work: what the work has ended with is saved by saved(), all else goes on exit.

    with Scratch() as scratch:
        a = scratch.saved(df, "a")
        return saved(a.groupBy("k").count(), "counts")"""

    def __init__(self):
        self.paths: dict[int, tuple[SparkSession, str]] = {}
        self.held: list[DataFrame] = []  # keeps the keys of paths unique

    def saved(self, df: DataFrame, tag: str) -> DataFrame:
        path = _path(df, tag)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (df.sparkSession, path)
        self.held.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _delete(*self.paths.pop(id(table)), on_exit=False)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for spark, path in self.paths.values():
            _delete(spark, path, on_exit=False)
        self.paths.clear()
