"""Exact duplicates by a log-structured merge index of digests.

Each task collects its rows in a memtable of bounded bytes.  A full memtable is
flushed as a sorted run: one entry for each distinct digest with the best row
(most code points, then the smallest id) and the number of rows; rows that
hit an entry of the memtable are compared byte by byte.  Runs are cut by digest
prefix and written as a table, with a Bloom filter of each cut.  Compaction
merges the runs of a prefix pair by pair, smaller ones first; only entries
that pass the other run's filter are searched.  What compaction finds goes
back to the rows by (run, entry), so a text with any number of copies costs
one entry a run, and no task gets its rows together.  Entries that hit another
run are verified: a row of each run is fetched and its bytes compared with
those of the row that stays.  There are as many cuts as keep the entries of one
below ``CUT``, so memory does not grow with the table.

Defined cases: a null text counts as empty; repeated rows (same id) count each,
and the first stays; null ids sort last and are verified like others; texts of
any length are read whole; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, SPACES, let_go, partitions, settled, slices, staged, take

#: Bytes of normalised text that a memtable holds.
MEMTABLE = 24 << 20
#: Entries that a compacting task merges, about: the rows of a cut if none are equal.
CUT = 1 << 20
_DROP = SPACES.encode()
_LAST = np.iinfo(np.int64).max


def normal(text: str | None) -> bytes:
    """The bytes that equality goes by: UTF-8 without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _DROP)


class Filter:
    """A Bloom filter over digests, ten bits an entry, whose probes are parts of the digest."""

    @staticmethod
    def build(digests: np.ndarray) -> np.ndarray:
        bits = max(64, 1 << int(np.ceil(np.log2(10 * max(1, len(digests))))))
        table = np.zeros(bits, bool)
        for probe in Filter.probes(digests, bits):
            table[probe] = True
        return np.packbits(table)

    @staticmethod
    def probes(digests: np.ndarray, bits: int) -> list[np.ndarray]:
        words = digests.view("<u8").reshape(len(digests), 4)
        return [(words[:, k] & np.uint64(bits - 1)).astype(np.int64) for k in range(1, 4)]

    @staticmethod
    def passes(packed: np.ndarray, digests: np.ndarray) -> np.ndarray:
        table = np.unpackbits(packed).astype(bool)
        hit = np.ones(len(digests), bool)
        for probe in Filter.probes(digests, len(table)):
            hit &= table[probe]
        return hit


class Run:
    """Sorted distinct digests with the best row, the number of rows and the (run, entry) pairs each stands for."""

    def __init__(self, digests, chars, ids, counts, first, filter=None):
        self.digests, self.chars, self.ids, self.counts, self.first = digests, chars, ids, counts, first
        self.filter = Filter.build(digests) if filter is None else filter

    def merge(self, other: Run) -> tuple[Run, np.ndarray, np.ndarray]:
        """The merged run, and where each entry of either has gone."""
        small, large = (self, other) if len(self.digests) <= len(other.digests) else (other, self)
        ask = np.flatnonzero(Filter.passes(large.filter, small.digests))
        at = np.minimum(np.searchsorted(large.digests, small.digests[ask]), len(large.digests) - 1)
        hit = large.digests[at] == small.digests[ask]
        ask, at = ask[hit], at[hit]
        better = (small.chars[ask] > large.chars[at]) | ((small.chars[ask] == large.chars[at]) & ((small.ids[ask] < large.ids[at]) | ((small.ids[ask] == large.ids[at]) & (small.first[ask] < large.first[at]))))
        large.counts[at] += small.counts[ask]
        for name in ("chars", "ids", "first"):
            getattr(large, name)[at[better]] = getattr(small, name)[ask[better]]
        alone = np.ones(len(small.digests), bool)
        alone[ask] = False
        digests = np.concatenate([large.digests, small.digests[alone]])
        order = np.argsort(digests, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        to_small = np.empty(len(small.digests), np.int64)
        to_small[ask] = place[at]
        to_small[alone] = place[len(large.digests) :]
        joined = [np.concatenate([getattr(large, n), getattr(small, n)[alone]])[order] for n in ("chars", "ids", "counts", "first")]
        out = Run(digests[order], *joined)
        to_large = place[: len(large.digests)]
        return (out, to_small, to_large) if small is self else (out, to_large, to_small)


def compact(runs: list[Run]) -> tuple[Run, list[np.ndarray]]:
    """All runs merged into one, smallest first, and where each entry has gone."""
    level = [(run, [(k, np.arange(len(run.digests)))]) for k, run in enumerate(runs)]
    while len(level) > 1:
        level.sort(key=lambda x: len(x[0].digests))
        (a, from_a), (b, from_b) = level[:2]
        merged, to_a, to_b = a.merge(b)
        level[:2] = [(merged, [(k, to_a[w]) for k, w in from_a] + [(k, to_b[w]) for k, w in from_b])]
    run, where = level[0]
    return run, [w for _, w in sorted(where, key=lambda x: x[0])]


_ROWS = "kind int, run string, entry int, doc_id long, chars long, digest binary, n long, pick boolean, cut int"


def flush(docs: DataFrame, cuts: int, memtable: int = MEMTABLE) -> DataFrame:
    """Sorted runs: rows of kind 0 are the entries, rows of kind 1 the documents with the entry they belong to, rows of kind 2 the filters of each cut (in ``digest``)."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: dict[bytes, list] = {}  # digest: text, best, number, rows
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            run, keys = uuid.uuid4().hex, sorted(held)
            entries, rows, by = [], [], {}
            for e, key in enumerate(keys):
                _, best, n, members = held[key]
                cut = int.from_bytes(key[:4], "big") * cuts >> 32
                entries.append((0, run, e, best[1], -best[0], key, n, True, cut))
                by.setdefault(cut, []).append(key)
                rows += [(1, run, e, i, c, None, 1, k == best[2], cut) for k, (c, i) in enumerate(members)]
            filters = [(2, run, 0, 0, 0, Filter.build(np.frombuffer(b"".join(x), "S32")).tobytes(), len(x), False, cut) for cut, x in by.items()]
            for part in (entries, rows, filters):
                for a in range(0, len(part), 20_000):
                    columns = list(zip(*part[a : a + 20_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.int32()))], [x.split()[0] for x in _ROWS.split(", ")])

        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = normal(text)
                key, chars = hashlib.sha256(body).digest(), len(text or "")
                entry = held.get(key)
                if entry is None:
                    held[key] = entry = [body, None, 0, []]
                    size += len(body) + 200
                elif entry[0] != body:
                    raise ValueError("two texts have one SHA-256 digest")
                rank = (-chars, _LAST if doc_id is None else doc_id, len(entry[3]))
                entry[3].append((chars, doc_id))
                entry[1] = rank if entry[1] is None else min(entry[1], rank)
                entry[2] += 1
                size += 40
                if size >= memtable:
                    yield from out()
                    held, size = {}, 0
        if held:
            yield from out()

    return take(docs, "doc_id", "text").mapInArrow(tables, _ROWS)


def exact_duplicates(docs: DataFrame, memtable: int = MEMTABLE, verify: bool = True, cut: int = CUT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    return settled(docs.sparkSession, "exact", lambda: _exact_duplicates(docs, memtable, verify, cut))


def _exact_duplicates(docs: DataFrame, memtable: int, verify: bool, cut: int) -> DataFrame:
    cuts = max(partitions(docs.sparkSession), -(-docs.count() // cut))
    runs = staged(flush(docs, cuts, memtable), "runs")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        filters = {r: np.frombuffer(x, np.uint8) for r, x in pdf.loc[pdf["kind"] == 2, ["run", "digest"]].itertuples(index=False)}
        pdf = pdf[pdf["kind"] == 0].sort_values(["run", "entry"], ignore_index=True)
        names, starts = np.unique(pdf["run"].to_numpy(), return_index=True)
        spans, made = [*zip(starts, [*starts[1:], len(pdf)])], []
        for name, (a, b) in zip(names, spans):
            part = pdf.iloc[a:b]
            keys = np.frombuffer(b"".join(part["digest"]), "S32")
            made.append(Run(keys, *(part[c].to_numpy().copy() for c in ("chars", "doc_id", "n")), np.arange(a, b), filters[name]))
        whole, where = compact(made)
        keep, total, first, runs_of = (np.empty(len(pdf), np.int64) for _ in range(4))
        met = np.bincount(np.concatenate(where), minlength=len(whole.digests))
        for (a, b), to in zip(spans, where):
            keep[a:b], total[a:b], first[a:b], runs_of[a:b] = whole.ids[to], whole.counts[to], whole.first[to], met[to]
        return pd.DataFrame({"run": pdf["run"], "entry": pdf["entry"], "keep_id": keep, "group_size": total, "stays": first == np.arange(len(pdf)), "digest": pdf["digest"], "runs": runs_of, "entry_id": pdf["doc_id"]})

    index = runs.filter("kind <> 1")
    found = index.groupBy("cut").applyInPandas(merge, "run string, entry int, keep_id long, group_size long, stays boolean, digest binary, runs long, entry_id long")
    found = staged(found, "compacted")
    if verify:
        verify_hits(docs, found)
    rows = runs.filter("kind = 1").select("run", "entry", "doc_id", "pick")
    out = rows.join(found.select("run", "entry", "keep_id", "group_size", "stays", "digest"), ["run", "entry"])
    keep = F.when(F.col("keep_id") != _LAST, F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", (F.col("pick") & F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def verify_hits(docs: DataFrame, found: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Compare the bytes of a row of each run with those of the row that stays, where a digest is in more than one run."""
    pairs = found.filter((F.col("runs") > 1) & ~F.col("stays")).select("entry_id", "keep_id", F.lower(F.hex("digest")).alias("sha")).distinct()
    asked = pairs.select(F.col("entry_id").alias("doc_id"), "sha").unionByName(pairs.select(F.col("keep_id").alias("doc_id"), "sha")).distinct()
    ids = asked.select("doc_id").distinct()
    if ids.limit(broadcast_rows + 1).count() <= broadcast_rows:
        ids = F.broadcast(ids)
    body = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    texts = take(docs, "doc_id", "text").withColumn("doc_id", F.coalesce("doc_id", F.lit(int(_LAST))))
    texts = texts.join(ids, "doc_id", "left_semi").select("doc_id", body.alias("body")).withColumn("sha", F.sha2("body", 256))
    kept = texts.join(pairs.select(F.col("keep_id").alias("doc_id"), "sha").distinct(), ["doc_id", "sha"], "left_semi").dropDuplicates(["doc_id", "sha"])
    seen = pairs.withColumnRenamed("entry_id", "doc_id").join(texts, ["doc_id", "sha"])
    kept = kept.select(F.col("doc_id").alias("keep_id"), "sha", F.col("body").alias("other"))
    if not seen.join(kept, ["keep_id", "sha"]).filter("body != other").isEmpty():
        raise ValueError("two texts have one SHA-256 digest")
