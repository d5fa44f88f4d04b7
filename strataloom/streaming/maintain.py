"""The kept index as a stream: each batch of changed records becomes one segment, whatever is replayed.

``maintain`` takes a stream of changes (key, seq, removed and the index's
fields).  Of a batch the newest change of each key counts, and only if it is
newer than the one that the index has, so a late worker's older change is
rejected.  A batch's segment is written under the stream's name and the batch's
number, so one that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strataloom.index import Index
from strataloom.sources.scratch import staged


class Maintainer:
    """Feeds an index, and beside it the table of the newest change of each key (``heads``), from batches."""

    def __init__(self, index: Index, stream: str, merge: bool = True) -> None:
        self.index, self.stream, self.merge = index, stream, merge
        self.schema = T.StructType.fromDDL(f"{index.key} {index.kind}, change long, removed boolean, part long")

    def heads(self) -> DataFrame:
        """key, change, removed: the newest change of each key that was taken."""
        rows = self.index.versions.read(self.index.manifest(), f"heads_{self.stream}", self.schema)
        return rows.groupBy(self.index.key).agg(F.max("change").alias("change"), F.max_by("removed", "change").alias("removed"))

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch; the same number again changes nothing."""
        own, key = self.index, self.index.key
        m = own.versions.manifest()
        if m.notes.get("streams", {}).get(self.stream, -1) >= number:
            return
        newest = Window.partitionBy(key).orderBy(F.col("seq").desc(), F.col("removed").desc())
        last = batch.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        known = self.heads().select(F.col(key).alias("_key"), F.col("change").alias("_change"))
        late = (F.col(key) == F.col("_key")) & (F.col("seq") <= F.col("_change"))
        rows = staged(last.join(known, late, "left_anti"), "changes")
        taken = rows.select(key, F.col("seq").alias("change"), "removed", F.lit(number).cast("long").alias("part"))
        beside = {f"heads_{self.stream}": [own.versions.write(f"heads_{self.stream}", taken)]}
        own.add(rows.filter("not removed").select(key, *own.fields), rows.filter("removed").select(key), self.stream, number, beside)
        if self.merge:
            own.merge()

    def run(self, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Start the stream; by default it ends when what is there has been read."""
        return changes.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
