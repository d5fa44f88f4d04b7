"""Packing documents into training windows by lexical retrieval.

Each document's ids are cut into whole windows, which are sequences of their
own, and a rest.  Documents are range-sorted by content: by the id that weighs
most in them (count times rarity) among those that a quarter of all documents
have, then a sixteenth, and so on down to a shard's share, so documents on one
matter lie side by side.  Consecutive documents form a shard with an
inverted index of its own.  Seeds are taken by descending rest; the shard's
documents that share any of a seed's distinct ids are ranked by BM25 over all of
them, and the unused ones fill its window in that order.  The one that no longer
fits is cut, and what is left of it stays in the index.  When no neighbour is
left, the next unused documents of the shard fill the window.

Weights use statistics of the whole table.  The search is bounded by the shard:
a neighbour that lies in another one is not found, which keeps the work in
proportion to the table.  A shard is bounded in documents and in index entries,
and a task streams over its shards, so memory does not grow with the table.

Cuts inside a rest are at multiples of ``GRAIN`` ids, for which the encoding
task keeps running CRC-32 sums; a piece's sum follows from two of them, as
CRC-32 is linear, so no text is encoded twice and no ids are moved.

Defined cases: a null or empty text has the end id alone; repeated rows are
documents each; a null id is kept; an empty table gives no row; texts of any
length are packed whole; ties go to the document that comes first in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import KEPT_WORDS, encoder
from .shared import let_go, partitions, staged, take
from .tokenfiles import BLOCK, blocks

WINDOW = 4096
#: Ids between the places where a rest may be cut: a window has fewer than so many ids of padding, but for a shard's last.
GRAIN = 32
#: Documents of a shard at most, and index entries (distinct ids of its documents).
SHARD, ENTRIES = 8000, 4_000_000
#: Ids that at least one in so many of a shard's documents has are kept as whole rows of weights, which add faster than postings; scores are the same.
WHOLE_ROWS = 8
#: Seeds that are ranked at once.
BATCH = 64
#: Share of an index's documents that are unused at least; then the others are taken out.
MOSTLY = 0.85
#: Neighbours that are sorted at first; the others are sorted when these are used up.
NEAR = 64
K1, B = 1.2, 0.75
#: Weights are multiples of one part in so many, so sums do not depend on their order.
UNIT = 1024

_POLY = 0xEDB88320


def _step(bits: list[int], value: int) -> int:
    out = k = 0
    while value:
        if value & 1:
            out ^= bits[k]
        value >>= 1
        k += 1
    return out


def _shifts() -> list[list[int]]:
    """For each k the images of the 32 single bits when a CRC-32 is carried over 2**k zero bytes."""
    one = [_POLY, *(1 << k for k in range(31))]  # over one zero bit
    table = []
    for _ in range(3):
        one = [_step(one, x) for x in one]
    for _ in range(48):
        table.append(one)
        one = [_step(one, x) for x in one]
    return table


_SHIFTS = _shifts()


def crc_between(before: int, until: int, n_bytes: int) -> int:
    """CRC-32 of the last ``n_bytes`` of a text from the sums of what is before them and of the whole."""
    k = 0
    while n_bytes:
        if n_bytes & 1:
            before = _step(_SHIFTS[k], before)
        n_bytes >>= 1
        k += 1
    return before ^ until


_DOCS = "kind int, doc_id long, n long, whole binary, sums binary, terms binary, counts binary"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def encoded(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, grain: int = GRAIN, kept_words: int = KEPT_WORDS, block: int = BLOCK) -> DataFrame:
    """Rows of kind 0, a document each: n ids, CRC-32 of its whole windows, running sums of its rest, and its distinct ids with their counts; and of kind 1, a task each: how many documents have each id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, kept_words)
        have, n_docs, n_ids = np.zeros(enc.size + 1, np.int64), 0, 0
        end = np.array([end_id], enc.width)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts, block):
                rows = []
                for key, found in zip(keys[a:b], enc.batch(texts[a:b])):
                    ids = np.concatenate([found, end])
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cut = len(ids) - len(ids) % window
                    whole = [zlib.crc32(raw[k * 4 : (k + window) * 4]) for k in range(0, cut, window)]
                    sums, last = [0], 0
                    for k in range(cut * 4, len(raw), grain * 4):
                        last = zlib.crc32(raw[k : k + grain * 4], last)
                        sums.append(last)
                    terms, counts = np.unique(ids, return_counts=True)
                    have[terms] += 1
                    rows.append((0, key, len(ids), np.array(whole, "<u4").tobytes(), np.array(sums, "<u4").tobytes(), terms.astype(enc.width).tobytes(), counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()))
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids)
                yield _batch(rows)
        if n_docs:
            yield _batch([(1, n_docs, n_ids, None, None, have.astype("<i8").tobytes(), None)])

    return staged(take(docs, "doc_id", "text").mapInArrow(encode, _DOCS), "encoded")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], [x.split()[0] for x in _DOCS.split(", ")])


def statistics(rows: DataFrame) -> tuple[int, int, np.ndarray]:
    """Documents, ids and document frequencies of the whole table: one row of the vocabulary's size, summed in two levels."""

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        have = sum(np.frombuffer(x, "<i8") for x in pdf["terms"])
        return pd.DataFrame({"doc_id": [pdf["doc_id"].sum()], "n": [pdf["n"].sum()], "terms": [have.tobytes()]})

    kind = "doc_id long, n long, terms binary"
    some = rows.filter("kind = 1").groupBy((F.xxhash64("terms") % 32).alias("dealt")).applyInPandas(total, kind)  # a row a task
    found = some.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(total, kind).collect()
    return (found[0][0], found[0][1], np.frombuffer(found[0][2], "<i8")) if found else (0, 0, np.zeros(1, np.int64))


def uses(raw: bytes, n: int) -> np.ndarray:
    """Counts of n ids, as bytes or wider integers where one needs them."""
    return np.frombuffer(raw, f"<u{len(raw) // n}")


class Statistics:
    """Of the whole table: documents, ids a document, and BM25's rarity of each id."""

    def __init__(self, n_docs: int, mean: float, have: np.ndarray) -> None:
        self.n_docs, self.mean, self.have = n_docs, mean, have
        self.rarity = np.log1p((n_docs - have + 0.5) / (have + 0.5))

    def weights(self, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray | float) -> np.ndarray:
        """What each of a document's ids adds to a query that has it."""
        f = counts.astype(np.float64)
        return f * (K1 + 1) / (f + K1 * (1 - B + B * lengths / self.mean)) * self.rarity[terms]

    def key(self, terms: np.ndarray, counts: np.ndarray, levels: int) -> bytes:
        """The id with the largest count times rarity among those that a quarter of all documents have, then a sixteenth, and so on; big-endian, so bytes sort as ids do."""
        weight, share = counts * self.rarity[terms], self.have[terms] / self.n_docs
        at = [np.where(share >= 0.25**k, weight, -1.0).argmax() for k in range(1, levels + 1)]
        return terms[at].astype(">u4").tobytes()


def key_levels(n_docs: int, shard: int) -> int:
    """Ids in a sort key: two, and one more for each time that four parts of the table still hold more than a shard."""
    return 2 + int(np.ceil(np.log(max(1.0, n_docs / shard)) / np.log(4)))


class Shard:
    """A shard of the inverted index, with BM25 weights from the whole table's statistics."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, told: Statistics) -> None:
        sizes = np.array([*map(len, terms)], np.int64)
        every = np.concatenate(terms)
        of = np.repeat(np.arange(len(terms), dtype=np.int32), sizes)
        weight = np.rint(told.weights(every, np.concatenate(counts), lengths[of]) * UNIT).astype(np.int32)
        self.terms, self.n, self.numbers = terms, len(terms), np.arange(len(terms))
        have_here = np.bincount(every, minlength=len(told.have))
        common = np.flatnonzero(have_here * WHOLE_ROWS >= self.n)
        self.row = np.full(len(told.have), -1, np.int32)
        self.row[common] = np.arange(len(common), dtype=np.int32)
        self.rows = np.zeros((len(common), self.n))
        at = self.row[every]
        whole = at >= 0
        self.rows[at[whole], of[whole]] = weight[whole]
        rare = np.flatnonzero(~whole).astype(np.int32)
        rare = rare[np.argsort(every[rare], kind="stable")]
        self.docs, self.scores = of[rare], weight[rare]
        have_here[common] = 0
        self.edges = np.r_[0, np.cumsum(have_here)]

    def drop(self, alive: np.ndarray) -> None:
        """Take used documents out of the index, once there are enough of them."""
        if alive.sum() >= MOSTLY * self.n:
            return
        place, keep = np.cumsum(alive, dtype=np.int32) - 1, alive[self.docs]
        self.edges = np.r_[0, np.cumsum(keep)][self.edges]
        self.docs, self.scores, self.rows = place[self.docs[keep]], self.scores[keep], self.rows.compress(alive, axis=1)
        self.numbers = self.numbers[alive]
        self.n = len(self.numbers)

    def rank(self, seeds: list[int]) -> np.ndarray:
        """BM25 of every document that is in the index (``numbers``), a row for each seed; in whole numbers below 2**53, so sums are exact in any order."""
        asked = np.zeros((len(seeds), len(self.rows)))
        for k, seed in enumerate(seeds):
            row = self.row[self.terms[seed]]
            asked[k, row[row >= 0]] = 1
        total = asked @ self.rows
        for k, seed in enumerate(seeds):
            terms = self.terms[seed]
            rare = terms[self.row[terms] < 0].astype(np.int64)
            spans = [slice(a, b) for a, b in zip(self.edges[rare].tolist(), self.edges[rare + 1].tolist()) if a < b]
            if spans:
                total[k] += np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.scores[s] for s in spans]), self.n)
        return total

    def near(self, score: np.ndarray, left: np.ndarray) -> Iterator[int]:
        """The unused documents with a score, best first."""
        found = np.flatnonzero((score > 0) & (left[self.numbers] > 0))
        found, score = self.numbers[found], score[found]
        if len(found) > NEAR:
            edge = np.partition(score, len(score) - NEAR)[len(score) - NEAR]
            first = score >= edge
            yield from found[first][np.argsort(-score[first], kind="stable")].tolist()
            found, score = found[~first], score[~first]
        yield from found[np.argsort(-score, kind="stable")].tolist()


def fill(index: Shard, rests: np.ndarray, window: int = WINDOW, grain: int = GRAIN, batch: int = BATCH) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start in its rest, length); every id of every rest is in one of them."""
    left, at = rests.copy(), np.zeros(len(rests), np.int64)
    order = np.argsort(-rests, kind="stable")
    first = 0  # before it, all are used
    scores: dict[int, np.ndarray] = {}

    def put(doc: int, made: list[tuple[int, int, int]], space: int) -> int:
        taken = int(left[doc]) if left[doc] <= space else space - space % grain
        if taken:
            made.append((doc, int(at[doc]), taken))
            left[doc] -= taken
            at[doc] += taken
        return space - taken

    for place, seed in enumerate(order.tolist()):
        if not left[seed]:
            continue
        if seed not in scores:  # this seed's and the next ones' at once
            index.drop(left[index.numbers] > 0)
            some = order[place : place + 4 * batch]
            some = some[left[some] > 0][:batch].tolist()
            scores = dict(zip(some, index.rank(some)))
        made: list[tuple[int, int, int]] = []
        space = put(seed, made, window)
        if space >= grain:
            for other in index.near(scores[seed], left):
                space = put(other, made, space)
                if space < grain:
                    break
        first = max(first, place)
        while space >= grain and first < len(order):
            doc = int(order[first])
            space = put(doc, made, space)
            first += not left[doc]
        yield made


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, grain: int = GRAIN, shard: int = SHARD, kept_words: int = KEPT_WORDS, block: int = BLOCK) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``kept_words`` and ``block`` bound the memory of an encoding worker: the words it knows, and the characters it
    encodes at once.  ``shard`` is the number of documents that are searched for a seed's neighbours.
    """
    if window % grain:
        raise ValueError("the window must be a multiple of the grain")
    spark = docs.sparkSession
    rows = encoded(docs, tokenizer, end_id, window, grain, kept_words, block)
    n_docs, n_ids, have = statistics(rows)
    if not n_docs:
        return spark.createDataFrame([], _PIECES)
    shared = spark.sparkContext.broadcast((n_docs, n_ids / n_docs, have))  # of the vocabulary's size
    id_type, levels = "<u2" if len(have) <= (1 << 16) + 1 else "<u4", key_levels(n_docs, shard)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the encoder
        told = Statistics(*shared.value)
        for batch in batches:
            own = [np.frombuffer(x, id_type) for x in batch.column(4).to_pylist()]
            made = [told.key(t, uses(c, len(t)), levels) for t, c in zip(own, batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], _NAMES)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, number = Statistics(*shared.value), TaskContext.get().partitionId() << 40
        held: list[dict] = []
        entries = 0

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            lengths, terms = np.array([r["n"] for r in held], np.int64), [np.frombuffer(r["terms"], id_type) for r in held]
            rests, out = lengths % window, []
            for r, n in zip(held, lengths.tolist()):
                for j, crc in enumerate(np.frombuffer(r["whole"], "<u4").tolist()):
                    out.append((r["doc_id"], j * window, window, crc, n, number, 0))
                    number += 1
            index = Shard(terms, [uses(r["counts"], len(t)) for r, t in zip(held, terms)], lengths, told)
            for sequence in fill(index, rests, window, grain):
                offset = 0
                for doc, start, taken in sequence:
                    r, sums = held[doc], np.frombuffer(held[doc]["sums"], "<u4")
                    crc = crc_between(int(sums[start // grain]), int(sums[-(-(start + taken) // grain)]), taken * 4)
                    out.append((r["doc_id"], r["n"] - int(rests[doc]) + start, taken, crc, r["n"], number, offset))
                    offset += taken
                number += 1
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 20_000])], [x.split()[0] for x in _PIECES.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                held.append(r)
                entries += len(r["terms"]) // int(id_type[-1])
                if len(held) == shard or entries >= ENTRIES:
                    yield from packed()
                    held, entries = [], 0
        if held:
            yield from packed()

    names = _NAMES[:-1]
    keyed = rows.filter("kind = 0").select(*names).mapInArrow(keys, _KEYED)
    keyed = staged(keyed.withColumn("line", F.monotonically_increasing_id()), "keyed")  # deals equal rows
    shards = -(-n_docs // shard)
    parts = min(shards, max(partitions(spark), shards // 16))  # so many tasks, each over its shards in a row
    order = ("key", "n", "line")
    near = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return near.select(*names).mapInArrow(pieces, _PIECES)


_NAMES = ["doc_id", "n", "whole", "sums", "terms", "counts", "key"]
_KEYED = "doc_id long, n long, whole binary, sums binary, terms binary, counts binary, key binary"
