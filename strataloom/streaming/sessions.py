"""Sessions folded as a stream: events gather until a checkpoint marker, which emits what was gathered.

``fold_stream`` keeps one small state a session (counts since its last marker),
``fold_table`` is the same fold of a finished table by one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id long, checkpoint_seq long, events long, failures long"


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Event files as a stream, a few files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)


def fold_table(events: DataFrame) -> DataFrame:
    """OUT for each checkpoint of (session_id, seq, kind, succeeded)."""
    marker = F.col("kind") == "checkpoint"
    before = F.sum(F.when(marker, 1).otherwise(0)).over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    parts = events.withColumn("n", F.coalesce(before, F.lit(0))).groupBy("session_id", "n")
    out = parts.agg(F.max(F.when(marker, F.col("seq"))).alias("checkpoint_seq"), F.count_if(~marker).alias("events"), F.count_if(~marker & ~F.col("succeeded")).alias("failures"))
    return out.filter("checkpoint_seq is not null").select("session_id", "checkpoint_seq", "events", "failures")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    count, failed = state.get if state.exists else (0, 0)
    out = []
    rows = pd.concat([*batches]).sort_values("seq")
    for seq, kind, ok in zip(rows["seq"], rows["kind"], rows["succeeded"]):
        if kind == "checkpoint":
            out.append((key[0], seq, count, failed))
            count = failed = 0
        else:
            count, failed = count + 1, failed + (not ok)
    state.update((count, failed))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def fold_stream(events: DataFrame) -> DataFrame:
    """OUT as a stream; events of a session must arrive in order of seq between batches."""
    return events.groupBy("session_id").applyInPandasWithState(_fold, OUT, "events long, failures long", "append", GroupStateTimeout.NoTimeout)


def ingest(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each idempotency key once: (key, occurred_at timestamp, ...), within the watermark."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["key"])
