"""An inverted index as tables: postings with positions by term, and the scores of a query from them.

A posting is the places of a term in one field of a row, with the row's length
and the sequence number of its version.  Postings of a term lie together in
blocks, one for each group of rows whose words a task cut at once, so a table has
a row for each block.  Blocks lie in buckets by a hash of the term and are sorted
by term inside, so a query reads its terms' buckets and, by the files'
statistics, few row groups of them; no text is read.  A build writes a file of
each bucket where its texts are, so no posting is shuffled and no frequent term is
a single task; a merge deals postings over several files of a bucket by a hash of
the row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions import text as X

#: Files of a bucket that one merge writes at least, so that a frequent term is no single task, and postings of one file that more of them aim at.
SPREAD, FILE_ROWS = 4, 2_000_000
#: Bytes of text whose words a task groups at once; a longer row is a group of its own.
BYTES_AT_ONCE = 16 << 20
#: The bucket of blocks without a term.
ROWS = -1
#: How the tables of an index are laid out; folders of another layout are not read.
LAYOUT = "blocks"

_WORD, _ACCENTED, _PLAIN = re.compile(r"[^\W_]+"), re.compile(f"[{X.ACCENTED}]"), dict(zip(X.ACCENTED, X.PLAIN))


def words(text: str | None) -> list[str]:
    """The words of a text as queries see them (``text.searchable``), in order."""
    low = (text or "").lower()
    return _WORD.findall(low if low.isascii() else _ACCENTED.sub(lambda m: _PLAIN[m[0]], low))


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _groups(batches: Iterator[pa.RecordBatch], fields: int) -> Iterator[tuple]:
    """Of some rows at a time: keys, lengths, the words, and of postings by word, field and row: word, row, field, and where each one's places begin among all places."""
    for whole in batches:
        size = sum((pc.fill_null(pc.binary_length(whole.column(k + 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(fields)), np.zeros(whole.num_rows, np.int64))
        part = np.cumsum(size) // BYTES_AT_ONCE
        starts = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if len(part) else []
        for start, end in zip(starts, [*starts[1:], whole.num_rows]):
            rows = whole.slice(start, end - start)
            n, found, sizes = rows.num_rows, [], np.zeros((fields, rows.num_rows), np.int64)
            for k in range(fields):
                for r, text in enumerate(rows.column(k + 1).to_pylist()):
                    own = words(text)
                    sizes[k, r] = len(own)
                    found += own
            cells, total = sizes.ravel(), len(found)
            coded = pa.array(found, pa.string()).dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False)
            cell = np.repeat(np.arange(fields * n, dtype=np.int64), cells)
            place = (np.arange(total) - np.repeat(np.cumsum(cells) - cells, cells)).astype(np.int32)
            order = np.argsort(ids, kind="stable")  # cells and places stay ascending
            ids, cell = ids[order], cell[order]
            first = np.flatnonzero(np.r_[True, (np.diff(ids) != 0) | (np.diff(cell) != 0)]) if total else np.zeros(0, np.int64)
            yield rows.column(0), sizes.sum(0).astype(np.int32), coded.dictionary, ids[first], cell[first] % max(n, 1), (cell[first] // max(n, 1)).astype(np.int8), first, place[order]


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def _gathered(fields: tuple[str, ...], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, lengths, known, word, row, field, first, places in _groups(batches, len(fields)):
            n, length = len(keys), pa.array(lengths.astype(np.int64))
            yield pa.RecordBatch.from_arrays([keys, length, pa.nulls(n, pa.string()), pa.nulls(n, pa.int8()), pa.nulls(n, schema.field(4).type)], schema=schema)
            if len(first):
                made = [keys.take(pa.array(row)), length.take(pa.array(row)), known.take(pa.array(word)), pa.array(field), _lists(first, pa.array(places)).cast(schema.field(4).type)]
                yield pa.RecordBatch.from_arrays(made, schema=schema)

    return run


def _in_arrow(run: Callable, rows: DataFrame, out: str, fields: tuple[str, ...]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    return rows.mapInArrow(run(fields, to_arrow_schema(T.StructType.fromDDL(out))), out)


def gathered(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, length, term, field (number) and positions of each term of every field, and for each row one without a term, in one pass over the texts.

    A row's words are grouped where its text is, so nothing is shuffled for it.
    """
    kind = rows.schema[key].dataType.simpleString()
    return _in_arrow(_gathered, rows.select(key, *fields), f"{key} {kind}, length long, term string, field byte, positions array<int>", fields)


def _blocked(fields: tuple[str, ...], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(term: pa.Array, at: np.ndarray, keys: pa.Array, lengths: np.ndarray, field: np.ndarray, starts: np.ndarray, borders: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
            own = [_lists(at, v) for v in (keys, pa.array(lengths), pa.array(field), pa.array(starts))] if len(field) else [_lists(at, keys), _lists(at, pa.array(lengths))] + [_lists(np.zeros(len(at)), pa.array(field)), _lists(np.zeros(len(at)), pa.array(starts))]
            made = [term, *own, _lists(borders, pa.array(places))]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)

        none = np.zeros(0, np.int8), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)
        for keys, lengths, known, word, row, field, first, places in _groups(batches, len(fields)):
            yield block(pa.nulls(1, pa.string()), np.zeros(1, np.int64), keys, lengths, *none)
            if len(first):
                at = np.flatnonzero(np.r_[True, np.diff(word) != 0])
                borders = first[at]
                begin = (first - np.repeat(borders, np.diff(np.r_[at, len(first)]))).astype(np.int32)
                yield block(known.take(pa.array(word[at])), at, keys.take(pa.array(row)), lengths[row], field, begin, borders, places)

    return run


def _block_schema(kind: str) -> str:
    return f"term string, keys array<{kind}>, lengths array<int>, fields array<tinyint>, starts array<int>, positions array<int>"


def blocked(rows: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Blocks of postings: term, keys, lengths and fields (numbers) of its postings, all of their positions and where each one's begin; a block without a term has all rows of a group.

    As ``gathered``, in one pass and without a shuffle, with a row for each block instead of each posting.
    """
    return _in_arrow(_blocked, rows.select(key, *fields), _block_schema(rows.schema[key].dataType.simpleString()), fields)


def rows_of(blocks: DataFrame, key: str) -> DataFrame:
    """key and length of every row, from written blocks without a term."""
    own = blocks.filter(F.col("bucket") == ROWS).select(F.explode(F.arrays_zip("keys", "lengths")).alias("e"))
    return own.select(F.col("e.keys").alias(key), F.col("e.lengths").cast("long").alias("length"))


def entries(blocks: DataFrame, key: str) -> DataFrame:
    """term, key, field, length, positions, seq and bucket of each posting of blocks."""

    def one(k: Column) -> Column:
        begin = F.get("starts", k)
        own = F.slice("positions", begin + 1, F.coalesce(F.get("starts", k + 1), F.size("positions")) - begin)
        return F.struct(F.get("keys", k).alias("key"), F.get("fields", k).alias("field"), F.get("lengths", k).cast("long").alias("length"), own.alias("positions"))

    found = blocks.filter("term is not null").select("term", F.explode(F.transform(F.sequence(F.lit(0), F.size("starts") - 1), one)).alias("e"), "seq", "bucket")
    return found.select("term", F.col("e.key").alias(key), F.col("e.field").alias("field"), F.col("e.length").alias("length"), F.col("e.positions").alias("positions"), "seq", "bucket")


def postings(blocks: DataFrame, seq: int, buckets: int) -> DataFrame:
    """Blocks as ``blocked`` gives them with seq and bucket, sorted where they are for writing by bucket."""
    bucket = F.coalesce(F.crc32(F.col("term").cast("binary")) % buckets, F.lit(ROWS)).cast("int")
    return blocks.withColumns({"seq": F.lit(seq).cast("long"), "bucket": bucket}).sortWithinPartitions("bucket", "term")


def _packed(fields: tuple[str, ...], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            term, keys, field, length, places, seq, bucket = b.columns
            same = pc.and_(pc.equal(term[1:], term[:-1]), pc.equal(seq[1:], seq[:-1])).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.r_[True, ~same])
            size = pc.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            begin = (first - np.repeat(first[at], np.diff(np.r_[at, b.num_rows]))).astype(np.int32)
            made = [term.take(pa.array(at)), *(_lists(at, v) for v in (keys, length, field, pa.array(begin))), _lists(first[at], places.flatten()), seq.take(pa.array(at)), bucket.take(pa.array(at))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)

    return run


def packed(rows: DataFrame, key: str, spread: int = SPREAD) -> DataFrame:
    """Postings as ``entries`` gives them as blocks with seq and bucket again, sorted for writing by bucket."""
    kind = rows.schema[key].dataType.simpleString()
    dealt = rows.select("term", key, "field", "length", "positions", "seq", "bucket").repartition("bucket", F.pmod(F.hash(key), F.lit(spread))).sortWithinPartitions("bucket", "term", "seq")
    return _in_arrow(_packed, dealt, _block_schema(kind) + ", seq long, bucket int", ()).sortWithinPartitions("bucket", "term")


def spread_for(postings: int, buckets: int) -> int:
    """Files of a bucket for so many postings."""
    return max(SPREAD, -(-postings // (buckets * FILE_ROWS)))


def alive(rows: DataFrame, tombstones: DataFrame | None, key: str) -> DataFrame:
    """Rows (key, seq) that no later tombstone (key, seq) ends."""
    if tombstones is None:
        return rows
    last = tombstones.groupBy(F.col(key).alias("_gone")).agg(F.max("seq").alias("_since"))
    return rows.join(last, (F.col(key) == F.col("_gone")) & (F.col("seq") < F.col("_since")), "left_anti")


def _places(word: str, step: int) -> Column:
    """Where a phrase would begin that has the word after so many others, from the column ``places``."""
    return F.transform(F.coalesce(F.try_element_at("places", F.lit(word)), F.array().cast("array<int>")), lambda p: p - F.lit(step))


def counted(found: DataFrame, key: str, phrases: list[list[str]], weights: list[float]) -> DataFrame:
    """key, length and counts, the weighted occurrences of each phrase, of rows with at least one; ``found``: live postings of the phrases' words, ``weights`` by field number."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("field").cast("int") + 1)
    found = found.withColumn("weight", weight).filter("weight > 0")
    single = {p[0]: k for k, p in enumerate(phrases) if len(p) == 1}
    parts = []
    if single:
        known = F.create_map(*(F.lit(x) for pair in single.items() for x in pair))
        parts.append(found.filter(F.col("term").isin(*single)).select(key, "length", F.element_at(known, F.col("term")).alias("k"), (F.col("weight") * F.size("positions")).alias("count")))
    for k, phrase in enumerate(phrases):
        if len(phrase) > 1:
            own = found.filter(F.col("term").isin(*phrase)).groupBy(key, "field").agg(F.first("length").alias("length"), F.first("weight").alias("weight"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places"))
            starts = _places(phrase[0], 0)
            for step, word in enumerate(phrase[1:], 1):
                starts = F.array_intersect(starts, _places(word, step))
            parts.append(own.select(key, "length", F.lit(k).alias("k"), (F.col("weight") * F.size(starts)).alias("count")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = rows.groupBy(key).agg(F.first("length").alias("length"), *(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("count"))), F.lit(0.0)).alias(f"c{k}") for k in range(len(phrases))))
    return sums.select(key, "length", F.array(*(f"c{k}" for k in range(len(phrases)))).alias("counts")).filter(F.exists("counts", lambda x: x > 0))
