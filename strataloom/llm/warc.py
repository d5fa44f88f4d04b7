"""WARC archives with revisits and a two-level capture index.

``write`` gives each page a record.  Payloads are grouped by SHA-256; of equal
ones that are long enough, the page with the smallest id gets a ``response``
record and the others ``revisit`` records without a payload that name it.
Every record is a gzip member of its own, so that a range of bytes is enough
to read it.  The capture index has one line a record: the URL with its host
reversed, the page, the file, offset and length.  Lines are range-sorted by
key and compressed in blocks of a fixed number of lines; the sparse directory
has the first and last key and the byte range of each block, in the order of
keys.  ``lookup`` finds the blocks of each key by bisection of the directory,
its lines by bisection of the block, and reads the records by their ranges;
``scan`` does so for every line of every block.  A task holds one file that it
writes, one block or one range that it reads.

Defined cases: a null page is an empty payload, a null URL the empty key; null
ids sort last; repeated rows are records each, and those with the smallest id
are all responses; texts of any length are one record; an empty table gives no
archive and no index.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, partitions, scratch, staged, take, write_once

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Lines of a compressed index block.
BLOCK_LINES = 1000
#: Bytes after which a new archive file, or index file, begins.
FILE_BYTES, INDEX_BYTES = 64 << 20, 16 << 20
#: Bytes between two records up to which they are read at once, and of such a read.
GAP, READ = 64 << 10, 4 << 20
_SPLIT = re.compile(rb"\r\n\r\n")


def url_key(url: str | None) -> str:
    """A URL with its host reversed, lower case, without scheme, port 80 or 443, user and fragment: ``com,example)/path?query``."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").split("#", 1)[0]
    host, cut, path = re.match(r"([^/?]*)([/?]?)(.*)", rest, re.S).groups()
    host = re.sub(r":(80|443)?$", "", host.rpartition("@")[2].lower())
    return ",".join(reversed(host.split("."))) + ")" + ("/" if cut != "/" else "") + cut + path


def record(row: dict) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    body = b"" if row["refers_to"] is not None else (row["html"] or "").encode("utf-8", "surrogatepass")
    page = "" if row["page_id"] is None else row["page_id"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', '', row['url'] or '')}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Payload-Length: {row['n_bytes']}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if row["refers_to"] is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    lines.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict:
    """What a gzip member says: headers by lower-case name, and the payload."""
    plain = zlib.decompress(raw, 31)
    head, body = _SPLIT.split(plain, maxsplit=1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    found = dict((name.lower(), value.strip()) for name, _, value in (x.partition(":") for x in lines[1:]))
    found["payload"] = body[: int(found["content-length"])]
    return found


def page_of(value: str | None) -> int | None:
    digits = re.search(r"<urn:page:(-?\d+)>", value or "")
    return int(digits[1]) if digits else None


_INDEX = "key string, page_id long, path string, offset long, length int"
_INDEX_NAMES = [x.split()[0] for x in _INDEX.split(", ")]
_INDEX_TYPES = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
_DIRECTORY = "part long, file long, first_key string, last_key string, path string, offset long, length long, n long"


def write(pages: DataFrame, least_bytes: int = LEAST_BYTES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Archives and index of ``pages`` (page_id, url, html); returns the directory: part, file, first_key, last_key, path, offset, length, n."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    rows = take(pages, "page_id", "url", "html")
    body = F.coalesce("html", F.lit(""))
    facts = rows.select("page_id", F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    groups = facts.filter(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    shared = staged(groups.filter("n > 1").select("digest", "first"), "payloads")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k, held, size, lines = TaskContext.get().partitionId(), 0, [], 0, []

        def out() -> Iterator[pa.RecordBatch]:
            write_once(lines[-1][2], *held)
            for a in range(0, len(lines), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines[a : a + 10_000]), _INDEX_TYPES)], _INDEX_NAMES)

        for batch in batches:
            for row in batch.to_pylist():
                raw = record(row)
                lines.append((url_key(row["url"]), row["page_id"], f"{folder}/part-{n:06d}-{k:04d}.warc.gz", size, len(raw)))
                held.append(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    yield from out()
                    k, held, size, lines = k + 1, [], 0, []
        if held:
            yield from out()

    digest = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).withColumn("n_bytes", F.octet_length(F.coalesce("html", F.lit(""))).cast("long"))
    told = digest.join(shared, "digest", "left")
    repeat = F.col("first").isNotNull() & (F.col("n_bytes") >= least_bytes)
    told = told.withColumn("refers_to", F.when(repeat & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    lines = staged(told.select("page_id", "url", "html", "digest", "n_bytes", "refers_to").mapInArrow(archive, _INDEX), "captures")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, file, held, size, made, out = TaskContext.get().partitionId(), 0, [], 0, [], []

        def block() -> None:
            nonlocal size, held
            raw = gzip.compress("".join(json.dumps(x, ensure_ascii=False) + "\n" for x in held).encode("utf-8", "surrogatepass"), 6, mtime=0)
            made.append((n, file, held[0][0], held[-1][0], f"{folder}/index-{n:06d}-{file:04d}.gz", size, len(raw), len(held)))
            out.append(raw)
            size, held = size + len(raw), []

        def told() -> pa.RecordBatch:
            write_once(made[-1][4], *out)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], [x.split()[0] for x in _DIRECTORY.split(", ")])

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c in _INDEX_NAMES)):
                held.append(line)
                if len(held) == block_lines:
                    block()
                    if size >= INDEX_BYTES:
                        yield told()
                        file, size, made, out = file + 1, 0, [], []
        if held:
            block()
        if made:
            yield told()

    order = ("key", "page_id", "path", "offset")  # so that a key of very many captures is dealt too
    ordered = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return staged(ordered.mapInArrow(index, _DIRECTORY), "directory")


def read_range(path: str, offset: int, length: int) -> bytes:
    system, own = filesystem(path)
    with system.open_input_file(own) as f:
        return f.read_at(length, offset)


def index_lines(path: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in gzip.decompress(read_range(path, offset, length)).decode("utf-8", "surrogatepass").split("\n")[:-1]]


def captures(directory: DataFrame) -> DataFrame:
    """Every line of the index, read block by block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = index_lines(row["path"], row["offset"], row["length"])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), _INDEX_TYPES)], _INDEX_NAMES)

    return directory.select("path", "offset", "length").mapInArrow(blocks, _INDEX)


def ranges(lines: list[dict]) -> Iterator[tuple[dict, bytes]]:
    """Lines in order of path and offset, each with the bytes of its record; near ones are read at once."""
    first = 0
    while first < len(lines):
        start, last, end = lines[first], first, lines[first]["offset"] + lines[first]["length"]
        while last + 1 < len(lines) and (x := lines[last + 1])["path"] == start["path"] and x["offset"] - end <= GAP and x["offset"] + x["length"] - start["offset"] <= READ:
            last, end = last + 1, max(end, x["offset"] + x["length"])
        raw = read_range(start["path"], start["offset"], end - start["offset"])
        for line in lines[first : last + 1]:
            at = line["offset"] - start["offset"]
            yield line, raw[at : at + line["length"]]
        first = last + 1


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def records(lines: DataFrame) -> DataFrame:
    """The records of index lines, read by their byte ranges; a response's payload is hashed again and compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, raw in ranges(batch.to_pylist()):
                found = parse(raw)
                digest, size = found["warc-payload-digest"].removeprefix("sha256:"), int(found["x-payload-length"])
                kind = found["warc-type"]
                if kind == "response" and (len(found["payload"]) != size or hashlib.sha256(found["payload"]).hexdigest() != digest):
                    raise ValueError(f"a record of {line['path']} does not match its digest")
                out.append((page_of(found["warc-record-id"]), size, digest, kind, page_of(found.get("warc-refers-to")), found["warc-target-uri"]))
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in _RECORD.split(", ")])

    n = partitions(lines.sparkSession)
    dealt = lines.select("path", "offset", "length").repartitionByRange(n, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(read, _RECORD)


def scan(directory: DataFrame) -> DataFrame:
    """Every record of the archives, by every line of every block of the index."""
    return records(captures(directory))


def lookup(directory: DataFrame, urls: list[str | None]) -> DataFrame:
    """The records of URLs: those blocks whose range of keys has one of theirs, the lines in them by bisection, then each record by its range."""
    keys = sorted({url_key(u) for u in urls})
    shared = directory.sparkSession.sparkContext.broadcast(keys)  # of the request

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                asked = wanted[bisect.bisect_left(wanted, row["first_key"]) : bisect.bisect_right(wanted, row["last_key"])]
                if not asked:
                    continue
                block = index_lines(row["path"], row["offset"], row["length"])
                names = [x[0] for x in block]
                found = [x for key in asked for x in block[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _INDEX_TYPES)], _INDEX_NAMES)

    if not keys:
        return records(captures(directory.limit(0)))
    some = directory.filter((F.col("last_key") >= keys[0]) & (F.col("first_key") <= keys[-1]))
    return records(some.select("first_key", "last_key", "path", "offset", "length").mapInArrow(lines, _INDEX))
