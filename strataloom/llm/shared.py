"""Shared folders, column selection and file access for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.sources.scratch import scratch, settled, staged

__all__ = ["scratch", "settled", "staged"]  # for the operators, with what follows

#: ASCII white space as the word rules of the operators define it.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of a batch between the JVM and Python: whole texts are large, so few at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand over at most ``BATCH_ROWS`` rows at a time; its default of 10,000 whole texts takes memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: What a Python worker keeps between tasks: one value, that of the operator that runs now.
_kept: dict[str, object] = {}


def kept(key: str, make) -> object:
    """The worker's value for a key; another key's is let go first."""
    if key not in _kept:
        let_go()
        _kept[key] = make()
    return _kept[key]


def let_go() -> None:
    """Give freed memory back to the system, which allocators put off, and drop what other operators kept."""
    _kept.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def position(df: DataFrame, name: str) -> int:
    """Where a column is: the first of that name, or else of that name but for case."""
    columns = df.columns
    return columns.index(name) if name in columns else [c.lower() for c in columns].index(name.lower())


def take(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone.  Columns are found by position, so other columns may have any name, also one that differs by case alone."""
    small_batches(df.sparkSession)
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{position(df, name)}").alias(name) for name in names))


def copied(df: DataFrame, name: str, to: str) -> DataFrame:
    """``df`` with one more column, a copy of a named one, found by position."""
    names = df.columns
    plain = df.toDF(*(f"_{i}" for i in range(len(names))))
    return plain.withColumn(f"_{len(names)}", F.col(f"_{position(df, name)}")).toDF(*names, to)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, so that few of its values are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it."""
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, *chunks: bytes) -> None:
    """Write a file under a name of its own, then move it into place: a repeated task replaces the file by the same bytes."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(own, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a unique key in ``name`` that orders as doc_id does: the id itself, or, where ids repeat or are null, numbers given out by ascending id (nulls last) and written down."""
    n, present, distinct = take(docs, "doc_id").agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    rows = copied(docs, "doc_id", name)
    if n == present == distinct:
        return rows
    return staged(rows.orderBy(F.col(name).asc_nulls_last()).withColumn(name, F.monotonically_increasing_id()), "keyed")


def keep_rows(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """The rows whose key has true in ``decisions`` (key, kept): by a broadcast of the ids that go where they are few, else by a shuffled join."""
    gone = decisions.filter(~F.col("kept")).select(key)
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(gone), key, "left_anti")
    return rows.join(decisions.filter("kept").select(key).hint("shuffle_hash"), key, "left_semi")


def first_by_hash(rows: DataFrame, group: str, n: int) -> DataFrame:
    """``rows`` (doc_id, group and others) of which each group keeps the n with the smallest MD5 of the id, with their ``place``; of rows with one id any may be kept.

    Only rows below a bound that lets about 4 n of a group pass are sorted, so no task gets a large group, but for rows that
    share an id.  The groups' counts are broadcast: a row a label or language.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    share = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)
    few = rows.join(F.broadcast(counts), group).filter(share * F.col("_n") < 4.0 * n + 64).drop("_n")
    place = F.row_number().over(Window.partitionBy(group).orderBy(key, "doc_id"))
    return few.withColumn("place", place).filter(F.col("place") <= n)
