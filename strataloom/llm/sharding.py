"""Shards of nearly equal size by histogram sort.

Rows have a key of three numbers: a hash of the text, a hash of the id and a
number handed out to the row, so rows with equal texts are neighbours and no two
rows have one key.  ``splitters`` looks for the keys below which given numbers
of bytes lie: in each round every partition counts the bytes below a list of
candidate keys, the sums over all partitions are exact, and the next candidates
lie between the two that enclose a target.  Candidates are borders between
texts as long as two texts are left between them, so a group of equal texts is
cut only where it is larger than the tolerance allows.  A target is settled
when a candidate meets its tolerance or no row is left between its neighbours.

Then rows are exchanged once: each task gets a range of keys, several of which
make up a shard, sorts it and numbers its rows; the rows below each splitter are
known from the counts, so slots need no further pass.

To the driver go the counts of the candidates, ``PROBES`` a splitter, and never
rows; splitters grow with the number of tasks.

Defined cases: a null text has size 1, as has an empty one, and is a text of its
own; rows with null or equal ids, and repeated rows, are told apart by their
number and may lie in different shards; a row that is larger than a shard has
one by itself, and shards may be empty; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, staged, take

#: Part of a shard's bytes that a shard's border may be off; borders between tasks inside a shard may be off by more.
TOLERANCE, TASK_TOLERANCE = 0.01, 0.2
#: Bytes that a task is to get of the exchange, and candidates a splitter and round.
TASK_BYTES, PROBES = 128 << 20, 8
#: A key as one number: 64 bits for each of its three parts.
PART, END = 64, 1 << 192
GROUP = 2 * PART
#: Rows that a task sorts at a time to sum them up.
SUM_ROWS = 1 << 20


def keys_of(*parts: np.ndarray) -> np.ndarray:
    """Keys of 24 bytes that order as the three numbers, which are not negative."""
    return np.column_stack(parts).astype(">i8").view("S24").ravel()


def packed(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(24, "big") for k in keys], "S24")


@dataclass
class Search:
    """A target, and the keys known to enclose it with the bytes and rows below each."""

    target: int
    slack: float
    low: tuple[int, int, int]
    high: tuple[int, int, int]
    found: tuple[int, int, int] | None = None

    def settle(self) -> None:
        near = min(self.low, self.high, key=lambda x: abs(x[1] - self.target))
        if abs(near[1] - self.target) <= self.slack or self.high[0] - self.low[0] <= 1:
            self.found = near


def candidates(low: int, high: int, n: int) -> list[int]:
    """At most n keys between two, evenly: borders between texts where those enclose more than one text."""
    a, b = low >> GROUP, (high - 1) >> GROUP
    some = {(a + (b - a) * i // n) << GROUP for i in range(1, n + 1)} if a != b else {low + (high - low) * i // (n + 1) for i in range(1, n + 1)}
    return [k for k in some if low < k < high]


def counted(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Of the keys between each two candidates, by the number of candidates at or below them: bytes, rows, smallest and largest key."""
    shipped = rows.sparkSession.sparkContext.broadcast(packed(probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(columns: list[np.ndarray]) -> pa.RecordBatch:
            order = np.lexsort(columns[2::-1])
            keys, sizes = keys_of(*(c[order] for c in columns[:3])), columns[3][order]
            bins = np.searchsorted(shipped.value, keys, side="right")
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            last = np.append(first[1:], len(bins)) - 1
            raw = lambda at: pa.array([x.ljust(24, b"\0") for x in keys[at].tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bins[first], pa.int64()), pa.array(np.add.reduceat(sizes, first)), pa.array(last - first + 1), raw(first), raw(last)], ["bin", "bytes", "rows", "low", "high"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                n += batch.num_rows
            if n >= SUM_ROWS:
                yield summed([np.concatenate(c) for c in zip(*held)])
                held, n = [], 0
        if held:
            yield summed([np.concatenate(c) for c in zip(*held)])

    each = rows.mapInArrow(run, "bin long, bytes long, rows long, low binary, high binary")
    sums = each.groupBy("bin").agg(F.sum("bytes"), F.sum("rows"), F.min("low"), F.max("high")).collect()
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in sums}


def splitters(rows: DataFrame, targets: list[tuple[int, float]], total: tuple[int, int], probes: int = PROBES) -> list[tuple[int, int, int]]:
    """For each target (bytes, tolerance), ascending: a key with the bytes and rows below it, exact, as near as the tolerance or the rows allow; ``rows``: the three parts of the key and the size, ``total``: bytes and rows."""
    found = [Search(t, slack, (0, 0, 0), (END, *total)) for t, slack in targets]
    while open_ := [s for s in found if s.found is None]:
        shared: dict[tuple[int, int], int] = {}
        for s in open_:
            shared[s.low[0], s.high[0]] = shared.get((s.low[0], s.high[0]), 0) + 1
        at = sorted({k for (low, high), n in shared.items() for k in (low, *candidates(low, high, probes * n), high) if 0 < k < END})
        bins = counted(rows, at)
        below, so_far, count = [], 0, 0
        for i, k in enumerate(at):
            more = bins.get(i, (0, 0))
            so_far, count = so_far + more[0], count + more[1]
            below.append((k, so_far, count))
        edges = [(0, 0, 0), *below, (END, *total)]
        for s in open_:
            inside = [s.low, *(e for e in edges if s.low[0] < e[0] < s.high[0]), s.high]
            s.low = max(e for e in inside if e[1] <= s.target)
            s.high = min(e for e in inside if e[1] >= s.target)
            if s.high[0] > s.low[0]:
                own = [bins[i] for i in [sum(k <= s.low[0] for k in at)] if i in bins]
                if own:  # the rows between are those of one bin, so the keys can be drawn in to them
                    s.low, s.high = (max(s.low[0], own[0][2]), *s.low[1:]), (min(s.high[0], own[0][3] + 1), *s.high[1:])
            s.settle()
    return [s.found for s in found]


def shards(docs: DataFrame, n: int = 8, tolerance: float = TOLERANCE, task_bytes: int = TASK_BYTES, probes: int = PROBES) -> DataFrame:
    """doc_id, text, size, shard (from 0) and slot (from 0 in each shard, without gaps) of each row of ``docs`` (doc_id, text), by ranges of the key."""
    spark = docs.sparkSession
    rows = take(docs, "doc_id", "text")
    hashed = lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)  # noqa: E731  not negative
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    rows = staged(rows.withColumns({"k1": hashed("text"), "k2": hashed("doc_id"), "k3": F.monotonically_increasing_id()}), "sized")
    narrow = rows.select("k1", "k2", "k3", "size")
    total, count = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    each = max(1, -(-partitions(spark) // n), -(-total // (n * task_bytes)))  # ranges of a shard
    tasks = n * each
    wanted = [(total * t // tasks, total / n * tolerance if t % each == 0 else total / tasks * TASK_TOLERANCE) for t in range(1, tasks)]
    found = splitters(narrow, wanted, (total, count), probes) if total else [(END, 0, 0)] * len(wanted)
    for k in range(1, len(found)):  # looked for one by one, so two may have come to lie the wrong way round
        found[k] = max(found[k], found[k - 1])
    below = [0, *(f[2] for f in found)]
    starts = spark.createDataFrame([(t, t // each, below[t] - below[t - t % each]) for t in range(tasks)], "range int, shard int, start long")
    shipped = spark.sparkContext.broadcast(packed([min(f[0], END - 1) for f in found]))

    @F.pandas_udf("int")
    def ranged(k1: pd.Series, k2: pd.Series, k3: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shipped.value, keys_of(k1.to_numpy(), k2.to_numpy(), k3.to_numpy()), side="right").astype(np.int32))

    dealt = rows.withColumn("range", ranged("k1", "k2", "k3")).repartitionById(tasks, "range").sortWithinPartitions("k1", "k2", "k3")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of the row in its task
    out = dealt.withColumn("place", place).join(F.broadcast(starts), "range")  # a row a task
    return out.select("doc_id", "text", "size", "shard", (F.col("start") + F.col("place")).alias("slot"))
