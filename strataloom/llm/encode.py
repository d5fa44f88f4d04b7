"""Whole-text token ids from the tokenizers library, each distinct word encoded once per worker.

Both vocabularies split a text before any merge, and always at a single space
(or, for the vocabulary that drops white space, at any white space), so the
ids of a text are the ids of its words in a row.  A block of texts is split
and its distinct words are numbered by Arrow; a worker keeps the ids of words
that it has met in a table of bounded size and lets the library encode the
others, many in one call.  Texts for which that rule is not certain go to the
library whole.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import kept

#: Words kept by a worker, the first it meets; others, and words with marks that a block has once, are put together for each block.
KEPT_WORDS = 600_000
#: Runs of marks kept by a worker.
KEPT_MARKS = 10_000
MARKS = string.punctuation
SPECIAL = ("<|endoftext|>", "<|startoftext|>")
ODD_SPACES = "\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACES = "\x85\xa0\u1680\u180e\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


class Encoder:
    """Token ids of texts by one vocabulary file of the tokenizers library."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.spaced = self.library.normalizer is None
        self.size = self.library.get_vocab_size()
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}
        self.kept_words = kept_words
        #: Stands between words given to the library in one text: a token of its own that no plain word holds.
        self.mark = "\n" if self.spaced else " \x01 "
        self.mark_ids = self._plain(self.mark)
        self.line = self.mark_ids.tobytes() if self.spaced else b""
        self.tails: dict[str, bytes] = {}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none) as unsigned integers of the vocabulary's width."""
        odd = [bool(text) and self._odd(text) for text in texts]
        if self.spaced:  # a word that begins a line is looked up with the line end; that of the text's begin is cut off below
            plain = ["\n" + text.replace("\n", " \n") if text and not o else None for text, o in zip(texts, odd)]
            words = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        else:
            words = pc.ascii_split_whitespace(pa.array([text.lower() if text and not o else None for text, o in zip(texts, odd)], pa.large_string()))
        edges, width = words.offsets.to_numpy(), int(self.width[-1])
        numbered = words.values.dictionary_encode()
        at, known = numbered.indices.to_numpy(), self.words
        names = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = [*map(known.get, names)]
        fresh = [k for k, g in enumerate(got) if g is None]
        if fresh:
            times = np.bincount(at, minlength=len(names))
            late = self._learn([names[k] for k in fresh])
            for k in fresh:
                name = names[k]
                got[k] = late[name]
                if (times[k] > 1 or name[-1:] not in MARKS) and len(known) < self.kept_words:
                    known[name] = got[k]
        lengths = np.fromiter(map(len, got), np.int64, len(got)) // width
        starts, ids = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(got), self.width)
        own = lengths[at]
        until = np.r_[0, np.cumsum(own)]
        flat = ids[np.repeat(starts[at] - until[:-1], own) + np.arange(until[-1])]
        cuts, skip = until[edges].tolist(), len(self.line) // width
        out = [flat[a + skip : b] if b > a else flat[:0] for a, b in zip(cuts, cuts[1:])]
        for k, text in enumerate(texts):
            if odd[k]:
                out[k] = self._plain(text)
        return out

    def _odd(self, text: str) -> bool:
        """Whether words may not be cut at the plain spaces of a text."""
        if any(c in text for c in ODD_SPACES) or (not text.isascii() and any(c in text for c in WIDE_SPACES)) or ("<|" in text and any(s in text for s in SPECIAL)):
            return True
        if not self.spaced:
            return "\x01" in text or "Σ" in text  # whose lower case depends on what follows
        return "\t" in text or "\r" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"

    def _learn(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of words that are not known.  A letters-only word and the marks after it are two pieces to the vocabulary, so such words share their stem."""
        stems, plain, known, tails, found = {}, set(), self.words, self.tails, {}
        for w in fresh:
            stem = w.rstrip(MARKS)
            if stem != w and stem.isalpha() and max(stem) < "ɐ":
                stems[w] = stem
                if stem not in known:
                    plain.add(stem)
            elif w:
                plain.add(w)
            else:
                found[w] = b""
        found |= self._encode(list(plain))
        for w, stem in stems.items():
            mark = w[len(stem) :]
            if mark not in tails:
                if len(tails) >= KEPT_MARKS:
                    tails.clear()
                tails[mark] = self._plain(mark).tobytes()
            own = known.get(stem)
            if own is None:
                own = found[stem]
                if len(known) < self.kept_words:
                    known[stem] = own
            found[w] = own + tails[mark]
        return found

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        found, step = {}, len(self.mark_ids)
        for start in range(0, len(words), 200):
            some = words[start : start + 200]
            if self.spaced:
                ids = self._plain("\n".join(w[1:] if w[0] == "\n" else " " + w for w in some))
                ends = np.flatnonzero(ids == self.mark_ids[0])
            else:
                ids = self._plain(self.mark.join(some))
                hit = np.ones(max(0, len(ids) - step + 1), bool)
                for k, x in enumerate(self.mark_ids):
                    hit &= ids[k : len(ids) - step + 1 + k] == x
                ends = np.flatnonzero(hit)
            if len(ends) != len(some) - 1:
                raise ValueError("the library did not keep the words apart")
            raw, width, first = ids.tobytes(), ids.itemsize, 0
            for w, end in zip(some, [*ends.tolist(), len(ids)]):
                own = raw[first * width : end * width]
                found[w] = self.line + own if self.spaced and w[0] == "\n" else own
                first = end + step
        return found


def encoder(path: str, kept_words: int = KEPT_WORDS) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return kept(f"encoder {path} {kept_words}", lambda: Encoder(path, kept_words))
