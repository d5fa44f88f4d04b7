"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed shuffled order (by MD5 of
the id), passed through again when it ends.  A document goes through the queue
in packets of at most ``PACKET`` words.  A packet's virtual finish time is the
words of its source up to its end, divided by the source's target, so sources
advance at the rate of their targets; a document's is that of its last packet.
``schedule`` range-sorts the packets of all sources by finish time, takes the
running total of their words and cuts it at the budget; ``mix`` adds up what is
before the cut for each document.  A source misses its target by less than a
packet and what the cut moves, however long its documents are.

Targets share the budget by weight and stop at ``most`` times a source's size;
the excess is shared again by weight among the others.  With the sources in
ascending order of size by weight, those that stop come first, so one pass of
running sums finds them.

Running sums inside a source are taken over slices of the shuffle order and
then over the slices' totals, so that no task gets a source whole; those of the
schedule over its parts and then over the parts' totals.

Defined cases: a null text has size 0 and takes 0; a null source is a source
of its own, the last by order; null ids come in one place of the order; repeated rows are
documents each; an empty table gives no row; sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, partitions, staged, take

#: Slices of the shuffle order in each source: the first three hexadecimal digits of the key, so 4096.
SLICE_DIGITS = 3
#: Words of a packet.
PACKET = 256


def words(text: Column) -> Column:
    """Number of words of a text: the starts of runs of characters that are no ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """source, source_size, target for ``sizes`` (source, source_size): one row a source in and out."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # by UTF-8 bytes, so by code point
    whole = Window.partitionBy()
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    full = F.col("cap") * F.col("open") <= F.col("weight") * F.col("left")
    ranked = ranked.withColumn("full", F.min(F.when(full, 1).otherwise(0)).over(fill.rowsBetween(Window.unboundedPreceding, 0)))
    # all sources that are not full share the level of the first of them
    first = F.min(F.when(F.col("full") == 0, F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), (F.col("left") / F.col("open")).alias("level")))).over(whole)
    return ranked.select("source", "source_size", F.when(F.col("full") == 1, F.col("cap")).otherwise(F.col("weight") * first["level"]).alias("target"))


def queued(docs: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """Each row of ``docs`` (doc_id, source, text) with its place: doc_id, source, size, order_key, source_size, target, start (words of its source before it), slice and line (which name it)."""
    rows = take(docs, "doc_id", "source", "text")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = rows.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("order_key"))
    rows = rows.withColumn("slice", F.substring("order_key", 1, SLICE_DIGITS))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    line = Window.partitionBy("source").orderBy("slice")
    slices = slices.withColumn("slice_start", F.sum("slice_size").over(line) - F.col("slice_size"))
    sizes = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    found = targets(sizes, weights, budget, most).withColumnRenamed("source", "s")
    starts = slices.withColumnsRenamed({"source": "of", "slice": "p"}).join(found, F.col("of").eqNullSafe(F.col("s"))).select("of", "p", "slice_start", "source_size", "target")
    inside = Window.partitionBy("source", "slice").orderBy("order_key", "doc_id", "size")
    rows = rows.withColumn("inside", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("line", F.row_number().over(inside))
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("p")))
    return rows.withColumn("start", F.col("slice_start") + F.col("inside")).drop("inside", "slice_start", "of", "p")


def schedule(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, packet: int = PACKET) -> DataFrame:
    """Every packet in the order of service: the columns of ``queued``, copy and packet (from 0), words, finish, position (words of the schedule up to its end) and taken (its words before the cut)."""
    spark = docs.sparkSession
    copies, cut = int(-(-most // 1)), min(budget, most)
    rows = queued(docs, weights, budget, most).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = rows.withColumn("packet", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("size") - 1) / packet)).cast("int"))))
    rows = rows.withColumn("words", F.least(F.lit(packet), F.col("size") - F.col("packet") * packet).cast("long"))
    until = F.col("start") + F.col("copy") * F.col("source_size") + F.col("packet") * packet + F.col("words")
    rows = rows.withColumn("finish", F.when(F.col("target") > 0, until / F.col("target")).otherwise(F.lit(float("inf"))))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("order_key"), F.col("doc_id"), F.col("copy"), F.col("packet")]
    ordered = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kept = staged(ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "schedule")
    parts = kept.groupBy("part").agg(F.sum("words").alias("sum"))  # a row a part
    before = F.sum("sum").over(Window.orderBy("part")) - F.col("sum")
    parts = parts.select("part", before.alias("before"), F.floor(F.sum(F.col("sum")).over(Window.partitionBy()) / copies * cut + 0.5).alias("budget"))
    inside = F.sum("words").over(Window.partitionBy("part").orderBy("place"))
    told = kept.withColumn("inside", inside).join(parts, "part").withColumn("position", F.col("before") + F.col("inside"))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("position") + F.col("words")))
    return told.withColumn("taken", taken.cast("long")).drop("part", "place", "inside", "before", "budget")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, most: float = 2.0, packet: int = PACKET) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, order_key, start, finish: the words the mix takes of each document, and the virtual time at which its first copy ends."""
    served = schedule(docs, weights, budget, most, packet)
    same = ("doc_id", "size", "source", "source_size", "target", "order_key", "start")
    found = served.groupBy("source", "slice", "line").agg(*(F.first(c).alias(f"_{c}") for c in same), F.sum("taken").alias("taken"), F.max(F.when(F.col("copy") == 0, F.col("finish"))).alias("finish"))
    return found.select(*(F.col(f"_{c}").alias(c) for c in same), "taken", "finish").select("doc_id", "size", "source", "source_size", "target", "taken", "order_key", "start", "finish")
