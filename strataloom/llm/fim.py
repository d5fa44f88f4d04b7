"""Fill-in-middle transformation by succinct rank and select.

The texts of a batch lie in one buffer of UTF-8 bytes.  Two bit vectors mark the
bytes at which a unit begins (a run of ASCII letters or any other character) and
at which a character begins.  ``Bits`` keeps a vector packed into words with a
directory of the ones before each block, so a text's number of units is a
difference of two ranks, a cut after a number of units is one select, and a
piece's characters are again a difference of ranks.  No text is split into a
list of its units.

A text is cut at two places drawn from its id and written in one of two orders,
prefix-suffix-middle or suffix-prefix-middle, or left plain.  ``restored``
rebuilds the text from the output and the form alone, as a column expression:
the marks occur once each, as texts that hold one stay plain.

Defined cases: a null text is the empty one, which stays plain, with 0 units;
a null id draws as the empty id; rows with one id have the same draws; repeated
rows are rows each; texts of any length are cut whole; an empty table gives no
row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import take

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that stay plain from here on, and of the others that are written suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Bytes of text whose bit vectors are held at a time; a longer text is held by itself.
SLICE_BYTES = 4 << 20
WORDS = 8  # words of 64 bits in a block of the directory


class Bits:
    """A packed bit vector with the number of ones before each block."""

    def __init__(self, flags: np.ndarray) -> None:
        blocks = len(flags) // (64 * WORDS) + 1  # so that the end has a block too
        packed = np.zeros(blocks * WORDS * 8, np.uint8)
        packed[: -(-len(flags) // 8)] = np.packbits(flags, bitorder="little")
        self.words = packed.view("<u8").reshape(blocks, WORDS)
        self.ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.ones.sum(axis=1))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block, word, bit = at >> 9, (at >> 6) & (WORDS - 1), (at & 63).astype(np.uint64)
        full = np.where(np.arange(WORDS) < word[:, None], self.ones[block], 0).sum(axis=1)
        part = self.words[block, word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[block] + full + np.bitwise_count(part)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Positions of the ones with these numbers, from 0; each must be there."""
        block = np.searchsorted(self.before, k, side="right") - 1
        upto = self.before[block][:, None] + np.cumsum(self.ones[block], axis=1)
        word = (upto <= k[:, None]).sum(axis=1)
        rest = k - (upto[np.arange(len(k)), word] - self.ones[block, word])
        bits = np.unpackbits(self.words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 64 * WORDS + word * 64 + (np.cumsum(bits, axis=1) <= rest[:, None]).sum(axis=1)


def marks(raw: np.ndarray, starts: np.ndarray) -> tuple[Bits, Bits]:
    """Where units and where characters begin in the bytes of texts that begin at ``starts``."""
    low = raw | 32
    letter = (low >= 97) & (low <= 122)
    lead = (raw & 0xC0) != 0x80
    after = np.zeros(len(raw), bool)
    after[1:] = letter[1:] & letter[:-1]
    after[starts[starts < len(raw)]] = False
    return Bits(lead & ~after), Bits(lead)


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    """Four 32-bit numbers of an id: the first groups of eight digits of a SHA-256."""
    found = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(found[k : k + 8], 16) for k in range(0, 32, 8))


def runs(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` bytes together, or one longer text."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end
        at = end


def cut(ids: list[int | None], offsets: np.ndarray, raw: np.ndarray, seed: int) -> list[tuple]:
    """n, form, prefix_chars, middle_chars and output of texts, the k-th of which is the bytes from ``offsets[k]`` to the next."""
    units, characters = marks(raw, offsets[:-1])
    first = units.rank(offsets)
    n = np.diff(first)
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    places = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    ends = np.repeat(offsets[1:], 2).reshape(-1, 2)
    inside = places < n[:, None]
    ends[inside] = units.select((first[:-1, None] + places)[inside])
    begin, middle, suffix = offsets[:-1], ends[:, 0], ends[:, 1]
    chars = [characters.rank(x) for x in (begin, middle, suffix)]
    out = []
    for k in range(len(ids)):
        text = raw[offsets[k] : offsets[k + 1]].tobytes()
        if not text or h[k, 2] % 100 >= PLAIN_FROM or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
            out.append((n[k], "plain", None, None, text))
            continue
        a, b = middle[k] - begin[k], suffix[k] - begin[k]
        head, mid, tail = text[:a], text[a:b], text[b:]
        spm = h[k, 3] % 100 < SUFFIX_FIRST
        made = (SUFFIX, tail, PREFIX, head, MIDDLE, mid) if spm else (PREFIX, head, SUFFIX, tail, MIDDLE, mid)
        out.append((n[k], "spm" if spm else "psm", chars[1][k] - chars[0][k], chars[2][k] - chars[1][k], b"".join(made)))
    return out


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output, for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            where, data = texts.buffers()[1:]
            offsets = np.frombuffer(where, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
            for at, end in runs(offsets):
                own = offsets[at : end + 1]
                ids = batch.column(0).slice(at, end - at)
                n, form, prefix, middle, output = zip(*cut(ids.to_pylist(), own - own[0], raw[own[0] : own[-1]], seed))
                columns = [ids, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCHEMA.split(", ")])

    rows = take(docs, "doc_id", "text")
    return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text of an output and its form."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    first, last = (lambda c, mark: F.substring_index(c, mark, 1)), (lambda c, mark: F.substring_index(c, mark, -1))
    from_fourth = lambda c: F.substr(c, F.lit(4))  # noqa: E731  behind the mark that it begins with
    psm = F.concat(from_fourth(first(output, s)), last(output, m), first(last(output, s), m))
    spm = F.concat(first(last(output, p), m), last(output, m), from_fourth(first(output, p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
