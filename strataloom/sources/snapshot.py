"""Snapshots of the model as JSON lines: a header, each table's rows, and a footer with counts and a digest.

The digest is made of the sums of four parts of 60 bits of the rows' SHA-256,
so it needs no global order and rows may be written by any number of tasks.
Tables for which an order is given have numbered rows, and the root of their Merkle tree beside the digest: then the order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import text as X
from strataloom.sources import legacy, merkle
from strataloom.sources.scratch import settled

VERSION = 2


def differences(found: T.StructType, wanted: T.StructType) -> list[str]:
    """What sets a table's schema apart from the one it should have."""
    own, asked = ({f.name: f.dataType.simpleString() for f in s} for s in (found, wanted))
    missing = [f"{n} is missing" for n in sorted(asked.keys() - own.keys())]
    unknown = [f"{n} is unknown" for n in sorted(own.keys() - asked.keys())]
    return missing + unknown + [f"{n} is {own[n]}, not {asked[n]}" for n in sorted(own.keys() & asked.keys()) if own[n] != asked[n]]


def counted(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """name, n, ids, hashes: rows, the sum of a key and the number of distinct values of a column of each table."""
    out = None
    for name, (df, key, value) in tables.items():
        part = df.agg(F.count("*").alias("n"), F.sum(key).alias("ids"), F.count_distinct(value).alias("hashes")).select(F.lit(name).alias("name"), "n", "ids", "hashes")
        out = part if out is None else out.unionByName(part)
    return out


def lines(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = part if out is None else out.unionByName(part)
    return out


def footer(rows: DataFrame) -> DataFrame:
    """table, n, digest of snapshot lines."""
    own = rows.withColumn("sha", F.sha2(F.concat_ws("\0", "table", "row"), 256))
    sums = (F.sum(F.conv(F.substring("sha", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4))
    return own.groupBy("table").agg(F.count("*").alias("n"), F.concat_ws("-", *sums).alias("digest"))


def rooted(rows: DataFrame) -> str | None:
    """The root of the tree over (n, row); raises where the numbers are not those from 0, each once."""
    told = rows.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()
    if tuple(told) not in ((told[0], told[0], 0, told[0] - 1), (0, 0, None, None)):
        raise ValueError("rows without their numbers, or with others' ones")
    return settled(rows.sparkSession, "root", lambda: merkle.tree(merkle.given(rows))[-1]).select("digest").first()[0] if told[0] else None


def export(tables: dict[str, DataFrame], path: str, version: int = VERSION, order: dict[str, list[str]] | None = None) -> None:
    """Write a snapshot; ``order`` has the key columns of tables whose rows are to be numbered by them."""
    spark = next(iter(tables.values())).sparkSession
    placed = {name: settled(spark, "ordered", lambda name=name, keys=keys: merkle.ordered(tables[name], keys)) for name, keys in (order or {}).items()}
    rows = None
    for name, df in tables.items():
        part = placed[name].select(F.lit(name).alias("table"), "row", "n") if name in placed else lines({name: df}).withColumn("n", F.lit(None).cast("long"))
        rows = part if rows is None else rows.unionByName(part)
    rows.select(F.to_json(F.struct(F.lit("row").alias("record_type"), "table", "row", "n")).alias("value")).write.text(f"{path}/rows")
    schemas = spark.createDataFrame([(name, df.schema.json()) for name, df in tables.items()], "table string, schema string")
    schemas.select(F.to_json(F.struct(F.lit("export").alias("record_type"), F.lit(version).alias("format_version"), "table", "schema"))).write.text(f"{path}/header")
    roots = spark.createDataFrame([(name, rooted(df.select("n", "row"))) for name, df in placed.items()], "table string, root string")  # a row a table
    footer(rows).join(F.broadcast(roots), "table", "left").select(F.to_json(F.struct(F.lit("export_end").alias("record_type"), "table", "n", "digest", "root"))).write.text(f"{path}/footer")


def changes(spark: SparkSession, mine: str, theirs: str, table: str, keys: list[str]) -> DataFrame:
    """What sets a table of two snapshots apart, by their trees: ``merkle.changes``."""
    tree = lambda path: merkle.tree(merkle.ordered(load(spark, path)[table], keys))
    return settled(spark, "changes", lambda: merkle.changes(tree(mine), tree(theirs)))


def load(spark: SparkSession, path: str, wanted: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot; raises where a line is broken, a table or column unknown, or counts or digests differ from the footer's."""
    read = lambda part, schema: spark.read.text(f"{path}/{part}").select(F.from_json("value", schema).alias("x")).select("x.*")
    head = read("header", "record_type string, format_version int, table string, schema string").collect()  # a row a table
    if not head or any(r[0] != "export" or r[1] not in (1, VERSION) for r in head) or len({r[1] for r in head}) > 1:
        raise ValueError("no snapshot header of a known version")
    schemas = {r[2]: T.StructType.fromJson(__import__("json").loads(r[3])) for r in head}
    version = head[0][1]
    if version == 1 and wanted is not None:
        wanted = {n: s for n, s in wanted.items() if n not in legacy.TABLES} | {n: T.StructType.fromDDL(s) for n, s in legacy.TABLES.items()}
    for name, schema in (wanted or {}).items():
        if name in schemas and not set(schemas[name].names) <= set(schema.names):
            raise ValueError(f"unknown columns in {name}")
    rows = read("rows", "record_type string, table string, row string, n long")
    if not rows.filter("record_type is null or record_type != 'row' or row is null").isEmpty() or not rows.filter(~F.col("table").isin(*schemas)).isEmpty():
        raise ValueError("a broken row or an unknown table")
    if not rows.filter(X.redacted(F.col("row"))["count"] > 0).isEmpty():
        raise ValueError("a row holds a secret")
    told = read("footer", "record_type string, table string, n long, digest string, root string").select("table", "n", "digest", "root").collect()  # a row a table
    if {tuple(r)[:3] for r in told} != {tuple(r) for r in footer(rows.select("table", "row")).collect()}:
        raise ValueError("counts or digests differ from the footer")
    for name, _, _, root in told:
        if root is not None and rooted(rows.filter(F.col("table") == name).select("n", "row")) != root:
            raise ValueError(f"the rows of {name} are not in the footer's order")
    found = {name: rows.filter(F.col("table") == name).select(F.from_json("row", schema).alias("x")).select("x.*") for name, schema in schemas.items()}
    return legacy.upgraded(found) if version == 1 and "heads" in found else found
