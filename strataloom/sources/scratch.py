"""Tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session's own (tests), and an error on a cluster."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = getattr(spark, "_strataloom_shared", None)
        if place is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            place = spark._strataloom_shared = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: it is computed once and survives lost executors.

    Columns have neutral names in the files, so names that differ by case alone don't clash there.
    """
    spark, names = df.sparkSession, df.columns
    path = scratch(spark, name)
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    plain.write.parquet(path)
    for made in _passing[-1:]:
        made.append(path)
    return spark.read.schema(plain.schema).parquet(path).toDF(*names)


#: Paths of tables that end with the innermost ``settled``.
_passing: list[list[str]] = []


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, staged; what it staged on the way is deleted then."""
    made: list[str] = []
    _passing.append(made)
    try:
        found = make()
        _passing.pop()
        _passing.append([])  # the result is not one of them
        out = staged(found, name)
    finally:
        kept = _passing.pop()
        for path in made:
            remove(spark, path)
    if _passing:
        _passing[-1] += kept
    return out


def remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
