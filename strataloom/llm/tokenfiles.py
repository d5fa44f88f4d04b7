"""Token-id files: flat unsigned integers with 64-bit document offsets.

``write`` range-partitions the documents by id, and each task writes files in
threes: ``.bin`` has the ids of its documents in a row (two bytes each where
the vocabulary fits, else four), ``.idx`` the 64-bit offset at which each
document begins and the end of the last, ``.doc`` the 64-bit document ids.  A
task holds the ids of one file, and begins the next after ``FILE_BYTES`` of text.
Where a file begins in the whole set is the sum of the files before it, taken
over the manifest that has one row a file.  ``read`` maps the files into
memory.  A repeated task writes the same bytes under the same name.

Defined cases: a null or empty text has the end id alone; a null id sorts
first; of repeated rows each is a document, and rows with one id are dealt by
their texts; texts of any length are encoded whole; an empty table gives no file.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encode import encoder
from .shared import filesystem, partitions, scratch, staged, take, write_once

#: Bytes of text that a worker encodes at once.
BLOCK = 4 << 20
#: Characters of text after which a file ends.
FILE_BYTES = 64 << 20
#: In an index file for a document whose id is null.
NO_ID = np.iinfo(np.int64).min


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters each."""
    first = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


_MANIFEST = "part long, file long, path string, width string, n_docs long, n_tokens long"


def write(docs: DataFrame, tokenizer: str, end_id: int, parts: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending order of id; returns the manifest: part, file, path, width, n_docs, n_tokens, first_token."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.width).tobytes()
        pieces, lengths, ids, size, file = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            base = f"{folder}/part-{n:06d}-{file:06d}"
            write_once(f"{base}.bin", *pieces)
            write_once(f"{base}.idx", offsets.astype("<i8").tobytes())
            write_once(f"{base}.doc", np.concatenate(ids).astype("<i8").tobytes())
            return pa.RecordBatch.from_pydict({"part": [n], "file": [file], "path": [base], "width": [enc.width], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            for a, b in blocks(texts):
                some = enc.batch(texts[a:b])
                pieces.append(b"".join(x for found in some for x in (found.tobytes(), end)))
                lengths += [len(found) + 1 for found in some]
                ids.append(keys[a:b])
                size += sum(len(t or "") for t in texts[a:b])
                if size >= file_bytes:
                    yield out()
                    pieces, lengths, ids, size, file = [], [], [], 0, file + 1
        if lengths:
            yield out()

    order = ("doc_id", F.length("text"), F.xxhash64("text"))
    rows = take(docs, "doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    made = staged(rows.mapInArrow(part, _MANIFEST), "manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return made.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def mapped(uri: str) -> memoryview | bytes:
    """A file's bytes, mapped into memory where the file system is local."""
    system, path = filesystem(uri)
    if system.type_name == "local":
        with open(path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with system.open_input_file(path) as f:
        return f.read()


def read(manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(mapped(row["path"] + ".bin"), row["width"])
                offsets = np.frombuffer(mapped(row["path"] + ".idx"), "<i8")
                docs = np.frombuffer(mapped(row["path"] + ".doc"), "<i8")
                spans = zip(offsets[:-1].tolist(), offsets[1:].tolist())
                sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == NO_ID), pa.array(offsets[:-1] + row["first_token"]), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.repartition(partitions(manifest.sparkSession), "part", "file")
    return spread.select("path", "width", "first_token").mapInArrow(part, "doc_id long, start long, n_tokens long, ids_crc32 long")


def document_ids(manifest: DataFrame) -> DataFrame:
    """Each document of the files with its ids: doc_id, ids."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(mapped(row["path"] + ".bin"), row["width"])
                offsets = np.frombuffer(mapped(row["path"] + ".idx"), "<i8")
                docs = np.frombuffer(mapped(row["path"] + ".doc"), "<i8")
                step = 1000
                for a in range(0, len(docs), step):
                    cut = offsets[a : a + step + 1]
                    values = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(ids[cut[0] : cut[-1]].astype(np.int64)))
                    some = docs[a : a + step]
                    yield pa.RecordBatch.from_arrays([pa.array(some, mask=some == NO_ID), values], ["doc_id", "ids"])

    return manifest.select("path", "width").mapInArrow(part, "doc_id long, ids array<long>")
