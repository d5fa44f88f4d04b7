"""Generated aliases as a kept table with markers, so that only outdated ones are made again.

A marker says of which revision and of which input the aliases were made, and
by which version of the generator.  ``outdated`` takes the inputs without a marker;
``Aliases.repair`` runs the generator on those records alone and writes aliases
and markers in one commit.  Texts go to their record's task once and are written
nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.aliases import alias_text
from strataloom.operators import retrieval as R
from strataloom.sources.scratch import remove
from strataloom.sources.versions import Manifest, Versions

#: Of the generator; another one makes every marker outdated.
GENERATOR = "aliases-1"


def inputs(corpus) -> DataFrame:
    """memory_id, revision, title, body, structured and input_hash of every record that is not retracted."""
    own = R.alias_inputs(corpus)
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "body")] + [F.array_join(F.coalesce("structured", F.array().cast("array<string>")), "\x1e")]
    return own.withColumn("input_hash", F.sha2(F.concat_ws("\x1f", *parts), 256))


def outdated(rows: DataFrame, markers: DataFrame, generator: str = GENERATOR) -> DataFrame:
    """The inputs without a marker (memory_id, revision, input_hash, generator) of their revision and hash by this generator."""
    mark = F.struct(F.col("revision").cast("long").alias("revision"), "input_hash")
    current = markers.filter(F.col("generator") == generator).groupBy("memory_id").agg(F.collect_set(mark).alias("_made"))
    # by the record alone, as the inputs are joined: other keys would shuffle their texts again
    return rows.join(current, "memory_id", "left").filter(~F.coalesce(F.array_contains("_made", mark), F.lit(False))).drop("_made")


class Aliases:
    """The kept table in a folder; the newest row of a record counts."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", generator: str = GENERATOR) -> None:
        self.versions, self.generator = Versions(spark, path), generator
        self.schema = T.StructType.fromDDL(f"memory_id {kind}, revision long, input_hash string, generator string, aliases string, seq long")

    def _newest(self, *names: str) -> DataFrame:
        every = self.versions.read(self.versions.manifest(), "aliases", self.schema)
        last = every.groupBy("memory_id").agg(F.max_by(F.struct("revision", "input_hash", "generator", *names), "seq").alias("r"))
        return last.select("memory_id", "r.*")

    def rows(self) -> DataFrame:
        """memory_id, revision, input_hash, generator, aliases: the newest of each record."""
        return self._newest("aliases")

    def markers(self) -> DataFrame:
        """memory_id, revision, input_hash, generator: the newest of each record."""
        return self._newest()

    def repair(self, corpus) -> int:
        """Make the outdated aliases again; how many there were."""
        m = self.versions.manifest()
        late = outdated(inputs(corpus), self.markers(), self.generator)
        made = late.select("memory_id", F.col("revision").cast("long").alias("revision"), "input_hash", F.lit(self.generator).alias("generator"), alias_text("title", "body", "structured").alias("aliases"), F.lit(m.version + 1).cast("long").alias("seq"))
        entry = self.versions.write("aliases", made)
        if n := self.versions.read(Manifest(0, {"aliases": [entry]}), "aliases", self.schema).count():
            self.versions.commit(m, {"aliases": [entry]})
        else:
            remove(self.versions.spark, f"{self.versions.path}/{entry['path']}")
        return n
