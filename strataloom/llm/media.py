"""Media columns: bytes as grey PNG pictures in binary columns, with perceptual hashes.

``png`` writes an 8-bit grey picture of a fixed width: signature, header, one
zlib chunk and end, each with its CRC-32; of the scan-line filters none, left
and up, each line has the one whose differences have the smallest sum.
``pixels`` tests every checksum, inflates and undoes all five filters with numpy.  ``cosine_hash``
reduces a picture to 32 x 32 means, takes the low 8 x 8 frequencies of its
cosine transform without the constant, and sets a bit for each above the median.

Defined cases: a null or empty payload is one line of zero bytes; equal
payloads give equal pictures and hashes; any length is stored whole; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import staged, take

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1)[None, :] * np.arange(LOW)[:, None] / (2 * SIDE))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(lines: np.ndarray) -> np.ndarray:
    """Lines behind the number of their filter: of none, left and up the one with the smallest sum of differences, the first on ties."""
    made = np.empty((3, *lines.shape), np.uint8)
    made[0] = lines
    made[1, :, 0], made[1, :, 1:] = lines[:, 0], lines[:, 1:] - lines[:, :-1]
    made[2, 0], made[2, 1:] = lines[0], lines[1:] - lines[:-1]
    kinds = np.abs(made.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    return np.column_stack([kinds.astype(np.uint8), made[kinds, np.arange(len(lines))]])


def png(samples: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey picture of the samples, whose number is a positive multiple of the width."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(filtered(lines).tobytes(), level)) + chunk(b"IEND", b"")


def pixels(raw: bytes) -> np.ndarray:
    """The samples of an 8-bit grey picture without interlacing, lines by columns; raises where a checksum or a length is wrong."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, data, size, ended = 8, [], None, False
    while at < len(raw) and not ended:
        (length,), kind = struct.unpack_from(">I", raw, at), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + length]
        if len(body) != length or raw[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlaced) != (8, 0, 0):
                raise ValueError("only 8-bit grey pictures without interlacing")
            size = (height, width)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if size is None or not ended:
        raise ValueError("a chunk is missing")
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(flat) != size[0] * (size[1] + 1):
        raise ValueError("the samples don't fill the picture")
    return unfilter(flat.reshape(size[0], size[1] + 1))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of lines that begin with their filter's number, one byte a sample."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    y, height = 0, len(out)
    while y < height:
        kind, end = kinds[y], y + 1
        while end < height and kinds[end] == kind:
            end += 1
        if kind == 1:  # running sums along each line
            out[y:end] = np.cumsum(out[y:end], axis=1, dtype=np.uint8)
        elif kind == 2:  # running sums down the lines
            above = out[y - 1] if y else np.zeros_like(out[0])
            out[y:end] = np.cumsum(np.vstack([above, out[y:end]]), axis=0, dtype=np.uint8)[1:]
        elif kind > 2:
            for k in range(y, end):
                above = (out[k - 1] if k else np.zeros_like(out[0])).astype(int)
                left = corner = 0
                for x, value in enumerate(out[k].tolist()):
                    up = int(above[x])
                    guess = (left + up) // 2 if kind == 3 else paeth(left, up, corner)
                    left, corner = (value + guess) & 255, up
                    out[k, x] = left
        y = end
    return out


def paeth(left: int, up: int, corner: int) -> int:
    """The neighbour nearest to left + up - corner; left, then up on ties."""
    guess = left + up - corner
    return min((left, up, corner), key=lambda v: abs(guess - v))


def shrink(picture: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Means over a grid of side x side cells; lines or columns that are fewer than the side repeat."""
    picture = picture.astype(np.float64)
    for axis in (0, 1):
        n = picture.shape[axis]
        if n < side:
            picture = np.take(picture, np.arange(side) * n // side, axis)
        else:
            edges = np.arange(side + 1) * n // side
            total = np.add.reduceat(picture, edges[:-1], axis)
            shape = (-1, 1) if axis == 0 else (1, -1)
            picture = total / np.diff(edges).reshape(shape)
    return picture


def cosine_hash(picture: np.ndarray) -> str:
    """64 bits in hexadecimal: the low 8 x 8 frequencies above the median of all but the constant; the constant's bit is 0."""
    low = np.round(_COSINES @ shrink(picture) @ _COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def pad(body: bytes, width: int = WIDTH) -> bytes:
    return body + bytes(-len(body) % width or (0 if body else width))


def store(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A table in the shared folder: the key, n_bytes of the UTF-8 text, and its picture in the binary column ``media``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = [(x or "").encode("utf-8", "surrogatepass") for x in part.column(1).to_pylist()]
                media = [png(pad(x)) for x in bodies]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([*map(len, bodies)], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    return staged(take(rows, key, text).mapInArrow(write, "key long, n_bytes long, media binary"), "media")


_FACTS = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame, width: int = WIDTH) -> DataFrame:
    """What the stored pictures hold, from their bytes: digests of the samples and of the file, the CRC-32 of the last line and the cosine hash."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column(2).to_pylist():
                picture = pixels(raw)
                samples = picture.tobytes()
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-width:]), len(raw), hashlib.sha256(raw).hexdigest(), cosine_hash(picture)))
            if out:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [x.split()[0] for x in _FACTS.split(", ")])

    return stored.mapInArrow(look, _FACTS)
