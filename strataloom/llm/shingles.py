"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once with numpy.

Words are runs of bytes that are no ASCII white space, with A-Z in lower case.
A word's hash is a polynomial over its bytes, cut out of running sums over the
whole block of texts and then mixed; a shingle's hash combines the hashes of
its words.  A text with fewer words than a shingle has is one shingle of its
own kind, and one without words has none.
"""

from __future__ import annotations

import numpy as np

from .shared import SPACES

WIDTH = 5
#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[*SPACES.encode()]] = True
_power = np.ones(1, np.uint64)
_back = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _back
    if len(_power) < n:
        size = 1 << int(n - 1).bit_length()
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _power, _back = made
    return _power, _back


def word_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and the number of words of each."""
    raw = np.frombuffer(b" " + b" ".join(bodies) + b" ", np.uint8)
    power, back = _powers(len(raw))
    space = _SPACE[raw]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    sums = np.cumsum(_BYTES[raw] * power[: len(raw)])
    words = mix((sums[ends - 1] - sums[starts - 1]) * back[starts])
    limits = np.cumsum([len(b) + 1 for b in bodies]) + 1 if bodies else np.zeros(0, int)
    until = np.searchsorted(starts, limits)
    return words, np.diff(until, prepend=0)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    bodies = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    first = 0
    while first < len(bodies):
        last, size = first, 0
        while last < len(bodies) and (last == first or size + len(bodies[last]) <= BLOCK):
            size += len(bodies[last])
            last += 1
        words, counts = word_hashes(bodies[first:last])
        n = len(words) - width + 1
        runs = words[:0]
        if n > 0:
            runs = words[:n].copy()
            for k in range(1, width):
                runs *= _STEP
                runs += words[k : k + n]
            runs = mix(runs)
        at = 0
        for count in counts.tolist():
            if count >= width:
                out.append(np.unique(runs[at : at + count - width + 1]))
            elif count:
                short = np.array([count], np.uint64) * np.uint64(0xA24BAED4963EE407)
                for w in words[at : at + count]:
                    short = short * _STEP + w
                out.append(mix(short))
            else:
                out.append(words[:0])
            at += count
        first = last
    return out
