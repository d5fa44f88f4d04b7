"""Attempts as streams: the outcomes of each session at its checkpoints, and failures that stay open across sessions.

Both keep folds of attempts, one for each canonical key, in Spark's keyed state
(``applyInPandasWithState``), so they survive restarts with the stream's
checkpoint.  ``ledger.session_attempts`` and ``ledger.attempts_folded`` are the
same folds of finished tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strataloom import schemas as S
from strataloom.operators import ledger as L
from strataloom.sources.scratch import staged

#: Rows of a file of a replayed table.
PART_ROWS = 100_000

FOLD = "final_result string, final_succeeded boolean, first_failure string, last_order long, runs long, reason string"
#: State of a key: its fold and the sequence numbers that its parts come from.
KEPT = FOLD + ", first_order long, reason_order long"
RANKS = {"verification": 3, "explicit_salience": 2, "failed_execution": 1}


def folded(old: tuple | None, seq: int, result: str | None, succeeded: bool, reason: str | None) -> tuple:
    """A key's fold (KEPT) with one more attempt, in any order of arrival."""
    if old is None:
        return result, succeeded, None if succeeded else result, seq, 1, reason, None if succeeded else seq, seq
    last, ok, first, order, runs, why, first_order, why_order = old
    if seq >= order:
        last, ok, order = result, succeeded, seq
    if not succeeded and (first_order is None or seq < first_order):
        first, first_order = result, seq
    if (RANKS.get(reason, 0), seq) >= (RANKS.get(why, 0), why_order):
        why, why_order = reason, seq
    return last, ok, first, order, runs + 1, why, first_order, why_order


def merged(old: tuple | None, new: tuple) -> tuple:
    """A key's fold (KEPT) of the attempts of two folds."""
    if old is None:
        return new
    last, ok, first, order, runs, why, first_order, why_order = old
    if new[3] >= order:
        last, ok, order = new[0], new[1], new[3]
    if new[6] is not None and (first_order is None or new[6] < first_order):
        first, first_order = new[2], new[6]
    if (RANKS.get(new[5], 0), new[7]) >= (RANKS.get(why, 0), why_order):
        why, why_order = new[5], new[7]
    return last, ok, first, order, runs + new[4], why, first_order, why_order


def _text(value) -> str | None:
    return None if value is None or value != value else value


_NAMES = [x.split()[0] for x in FOLD.split(", ")]


#: Folds of a task's rows on their way to the state; ``failed`` says whether there is a first failure.
_PART = f"scope string, key string, {KEPT}, failed boolean"
_PART_NAMES = [x.split()[0] for x in _PART.split(", ")]


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        folds: dict[tuple, tuple] = {}
        for scope, name, seq, result, ok, reason in zip(*(rows[c] for c in ("scope", "key", "seq", "result", "succeeded", "reason"))):
            key = (_text(scope), _text(name))
            folds[key] = folded(folds.get(key), int(seq), _text(result), bool(ok), _text(reason))
        yield pd.DataFrame([(*key, *f[:6], f[6] or 0, f[7], f[6] is not None) for key, f in folds.items()], columns=_PART_NAMES)


def _kept(rows: pd.DataFrame) -> Iterator[tuple]:
    """The folds (KEPT) of a key's rows: those a task has made of its attempts, or of single attempts that none has folded."""
    if "runs" not in rows:
        for seq, result, ok, reason in zip(*(rows[c] for c in ("seq", "result", "succeeded", "reason"))):
            yield folded(None, int(seq), _text(result), bool(ok), _text(reason))
        return
    for last, ok, first, order, runs, why, first_order, why_order, failed in rows[_PART_NAMES[2:]].itertuples(index=False, name=None):
        yield _text(last), bool(ok), _text(first), int(order), int(runs), _text(why), int(first_order) if failed else None, int(why_order)


def _carry(ttl_ms: int | None) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fold = state.get if state.exists else None
        for rows in batches:
            for part in _kept(rows):
                fold = merged(fold, part)
        state.update(fold)
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(*key, *fold[: len(_NAMES)])], columns=["scope", "key", *_NAMES])

    return run


def carried(attempts: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The fold of each key that a batch of attempts (scope, seq, key, result, succeeded, reason) touches, with all that came before it in any session; ``scope`` as a text.

    A task folds its own rows first, so a key with many attempts brings its group a row for each batch of rows of a task.
    Its last row is the fold of the finished table; a failure is open while final_succeeded is false.  A key that nothing
    touches for ``ttl_ms`` is forgotten.
    """
    rows = attempts.select(F.col("scope").cast("string").alias("scope"), "seq", "key", "result", "succeeded", "reason")
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.mapInPandas(_parts, _PART).groupBy("scope", "key").applyInPandasWithState(_carry(ttl_ms), f"scope string, key string, {FOLD}", KEPT, "update", timeout)


def latest(changes: DataFrame) -> DataFrame:
    """The last fold of each key of what ``carried`` gave, in batches numbered by ``batch``."""
    rows = changes.groupBy("scope", "key").agg(F.max_by(F.struct(*_NAMES), "batch").alias("f"))
    return rows.select("scope", "key", "f.*")


_EVENT = ("seq", "at", "marker", "prompt", "counts", "key", "result", "succeeded", "reason")


def _session(limit: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, events = map(json.loads, state.get) if state.exists else ([], [])
        if not state.hasTimedOut:
            for rows in batches:
                for seq, at, marker, prompt, counts, name, result, ok, reason in rows[[*_EVENT]].itertuples(index=False, name=None):
                    waiting.append((int(seq), int(at), bool(marker), bool(prompt), bool(counts), _text(name), _text(result), bool(ok), _text(reason)))
        watermark, out = state.getCurrentWatermarkMs(), []
        waiting.sort(key=lambda e: (e[1], e[0]))
        ready = sum(e[1] <= watermark for e in waiting)
        for e in waiting[:ready]:
            if e[2]:
                out += outcomes(key[0], e[0], events)
                events = []
            else:
                events = [e] if e[3] else [*events, e][-limit:]
        rest = waiting[ready:]
        state.update((json.dumps(rest), json.dumps(events)))
        if rest:  # a timeout comes when the watermark is past its time
            state.setTimeoutTimestamp(max(rest[0][1] - 1, watermark + 1))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "checkpoint_seq", "key", *_NAMES])

    return run


def outcomes(session_id, checkpoint_seq: int, events: list[tuple]) -> list[tuple]:
    """The folds of a session's events at a checkpoint."""
    folds: dict[str, tuple] = {}
    for seq, _, _, _, counts, name, result, ok, reason in events:
        if counts:
            folds[name] = folded(folds.get(name), seq, result, ok, reason)
    return [(session_id, checkpoint_seq, name, *fold[: len(_NAMES)]) for name, fold in folds.items()]


def session_outcomes(events: DataFrame, delay: str = "1 hour", limit: int = S.SESSION_EVENTS) -> DataFrame:
    """session_id, checkpoint_seq, key and fold of each key that a session's checkpoint folds, as a stream of events (session_id, seq, event_id, kind, content, attributes, occurred_at_ms).

    The state of a session is its newest ``limit`` events since its last boundary, and the events that wait until the
    watermark has passed them, so that ones which come late, within ``delay``, take their place by event time.
    """
    facts = L.session_facts(F.col("kind"), F.col("attributes"), F.col("content"), F.col("event_id"))
    rows = events.select("session_id", "seq", F.col("occurred_at_ms").alias("at"), F.timestamp_millis("occurred_at_ms").alias("occurred_at"), *facts)
    kind = rows.schema["session_id"].dataType.simpleString()
    keyed = rows.withWatermark("occurred_at", delay).groupBy("session_id")
    return keyed.applyInPandasWithState(_session(limit), f"session_id {kind}, checkpoint_seq long, key string, {FOLD}", "waiting string, events string", "append", GroupStateTimeout.EventTimeTimeout)


def told(found: DataFrame) -> DataFrame:
    """The outcomes of sessions with their texts: session_id, checkpoint_seq, key, result, succeeded, runs, reason."""
    rows = L.attempts_told(found.withColumn("scope", F.struct("session_id", "checkpoint_seq")))
    return rows.select("scope.session_id", "scope.checkpoint_seq", "key", "result", "succeeded", "runs", "reason")


def written(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream to the end of what is there; each batch is a folder named by its number under ``path``, so one that is repeated replaces itself.  Gives all rows with their ``batch``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out")


def replayed(table: DataFrame, path: str, order: str, files: int = 4, rows: int | None = None) -> DataFrame:
    """A finished table as a stream of so many parts in an order, a folder and a batch each.

    A part has a file for each ``rows`` of its rows (PART_ROWS), so a large one is written and read by many tasks.
    """
    spark = table.sparkSession
    table = staged(table, "replayed")
    edges = table.approxQuantile(order, [k / files for k in range(1, files)], 0.01)
    bounds = [None, *edges, None]
    each = max(1, math.ceil(table.count() / files / (rows or PART_ROWS)))
    while True:
        for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
            part = table if low is None else table.filter(F.col(order) > low)
            part = part if high is None else part.filter(F.col(order) <= high)
            part = part.coalesce(1) if each == 1 else part.repartition(each)
            part.write.mode("overwrite").parquet(f"{path}/in/f{k:04d}")  # one after another, so their times order them
        if each == 1 or all(len(spark.read.parquet(f"{path}/in/f{k:04d}").inputFiles()) == each for k in range(files)):
            break
        each = 1  # parts of few rows: batches must be parts
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).option("recursiveFileLookup", "true").parquet(f"{path}/in")
