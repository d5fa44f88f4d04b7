"""Language of a text by unigrams over a fixed public vocabulary, summed over all segmentations.

A word's likelihood in a language is the sum, over all ways to cut it into
pieces of the vocabulary, of the product of the pieces' probabilities; a
forward pass adds them up.  Words of up to ``TOGETHER`` characters go through it
many at a time; of a longer one the pass keeps the sums of the last positions
that a piece can reach back to, so memory does not grow with the word and no
segmentation is left out.  Piece probabilities are fitted for each language
by expectation maximisation over a bounded sample of labelled texts: all words
of the ``SAMPLE`` documents of each language with the smallest MD5 of their id
(a parameter), those of more than ``FITTED`` characters in parts of so many;
executors count the words, and the driver gets the counts.  A text's score for
a language is the sum over all its words; the answer is the most likely
language and its posterior with equal priors.

Only pieces that are lower case count, and texts are put in lower case.  A
character that is no piece costs the same in all languages.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
with nothing learned every text is ``und``; ties go to the smaller name; texts
and words of any length are scored whole; repeated rows get equal values, and
of rows with one id and language the fit takes the smallest text; an empty table
gives no row.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import first_by_hash, kept, position, small_batches, take

#: Documents of each language that a model is fitted to.
SAMPLE = 400
#: Characters of a word that is scored with others, and of a block of a longer one.
TOGETHER = 1024
#: Characters up to which a word's sums in all languages have one scale.
ALIKE = 32
#: Characters of a word that is fitted to, and of one whose likelihoods a worker keeps.
FITTED = 64
ROUNDS = 4
#: Probability that a character has outside the vocabulary, and the weight of the even share in each fitted probability.
FLOOR, EVEN = 1e-6, 0.02
#: Words whose likelihoods a worker keeps, the first it meets.
KEPT_WORDS = 300_000
START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def pieces_of(path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [p for p in every if p == p.lower()]


class Lattice:
    """Where the pieces of a vocabulary stand in words."""

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(1, self.n)))) + 3)
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int32)
        for k, key in enumerate(keys.tolist()):
            at = self._slot(np.uint64(key))
            while self.ids[at] >= 0:
                at = (at + 1) % len(self.ids)
            self.keys[at], self.ids[at] = key, k
        self.probes = 1
        for at in np.flatnonzero(self.ids >= 0).tolist():
            self.probes = max(self.probes, (at - int(self._slot(self.keys[at]))) % len(self.ids) + 1)

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        out, power = 0, 1
        for c in piece:
            out += (ord(c) + 1) * power
            power = power * int(_BASE)
        return out % (1 << 64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int32)
        for _ in range(self.probes):
            hit = (self.keys[at] == keys) & (out < 0)
            out[hit] = self.ids[at[hit]]
            at = (at + 1) % len(self.ids)
        return out

    def cut(self, words: list[str], start: str = START) -> np.ndarray:
        """Piece ids by (word, start, length - 1) for words of like length, each behind ``start``; -1: no piece."""
        words = [start + w for w in words]
        width = max(map(len, words))
        flat = np.frombuffer("".join(w + "\0" * (width - len(w)) for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        codes = flat.reshape(len(words), width) + np.uint64(1)
        sums = np.zeros((len(words), width + 1), np.uint64)
        np.cumsum(codes * _powers(_BASE, width), axis=1, out=sums[:, 1:])
        back = _powers(_BACK, width)
        ends = np.array([*map(len, words)])
        longest = min(self.longest, width)
        out = np.full((len(words), width, longest), -1, np.int32)
        for size in range(1, longest + 1):
            starts = width - size + 1
            keys = (sums[:, size:] - sums[:, :starts]) * back[:starts]
            ids = self.find(keys.ravel()).reshape(len(words), starts)
            ids[np.arange(starts)[None, :] + size > ends[:, None]] = -1
            out[:, :starts, size - 1] = ids
        return out


def groups(words: list[str], limit: int = 60_000) -> Iterator[list[int]]:
    """Indices of words by ascending length, in groups of about ``limit`` characters of like length."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    first = 0
    while first < len(order):
        least, last = len(words[order[first]]), first + 1
        while last < len(order) and len(words[order[last]]) <= least + max(3, least // 16) and (last - first) * (least + 4) < limit:
            last += 1
        yield order[first:last]
        first = last


@dataclass
class Model:
    """Languages by name, and each piece's probability in each."""

    names: list[str]
    pieces: list[str]
    table: np.ndarray  # (pieces + 1, languages); the last row: no piece

    def __post_init__(self) -> None:
        self.lattice = Lattice(self.pieces)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Logarithms by (word, language)."""
        out = np.empty((len(words), len(self.names)), np.float64)
        short = [k for k, w in enumerate(words) if len(w) <= TOGETHER]
        for some in groups([words[k] for k in short]):
            some = [short[k] for k in some]
            own = [words[k] for k in some]
            out[some] = forward(self.lattice.cut(own), np.array([len(w) + 1 for w in own]), self.table)[1]
        for k, w in enumerate(words):
            if len(w) > TOGETHER:
                out[k] = long_forward(self.lattice, START + w, self.table)
        return out


def step(ids: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """Probabilities of the pieces of one length; a single character that is no piece has the floor's."""
    found = table[ids]  # -1 is the last row
    return np.where((ids < 0)[:, None], FLOOR, found) if size == 1 else found


def forward(cut: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward sums by (position, word, language), the words' logarithms, and the scales' by (position, word, language or 1).

    In words of more than ``ALIKE`` characters each language has a scale of its own, as its sums may be too small beside another's.
    """
    n, width, longest = cut.shape
    apart = width > ALIKE + 1
    sums = np.zeros((width + 1, n, table.shape[1]))
    scale = np.zeros((width + 1, n, table.shape[1] if apart else 1))
    sums[0] = 1
    out = np.zeros((n, table.shape[1]))
    for end in range(1, width + 1):
        now = np.zeros((n, table.shape[1]))
        for size in range(1, min(longest, end) + 1):
            ids = cut[:, end - size, size - 1]
            if size > 1 and not (ids >= 0).any():
                continue
            back = sums[end - size] * np.exp(scale[end - size] - scale[end - 1])
            now += back * step(ids, table, size)
        top = np.maximum(now if apart else now.max(axis=1, keepdims=True, initial=0.0), 1e-300)
        sums[end] = now / top
        scale[end] = scale[end - 1] + np.log(top)
        done = ends == end
        out[done] = np.log(np.maximum(sums[end][done], 1e-300)) + scale[end][done]
    return sums, out, scale


def long_forward(lattice: Lattice, word: str, table: np.ndarray, block: int = TOGETHER) -> np.ndarray:
    """Logarithms of one word's sums by language, with the sums of no more positions than a piece is long."""
    longest = lattice.longest
    ahead, log = np.zeros((longest + 1, table.shape[1])), np.zeros(table.shape[1])  # sums so far at this position and the next ones, over exp(log) of each language
    ahead[0] = 1
    for begin in range(0, len(word), block):
        ids = lattice.cut([word[begin : begin + block + longest - 1]], "")[0]
        chances = table[ids]  # -1 is the last row, zero
        chances[ids[:, 0] < 0, 0] = FLOOR
        reach = chances.shape[1]
        for own in chances[:block]:
            top = np.maximum(ahead.max(axis=0), 1e-300)
            log += np.log(top)
            ahead /= top
            ahead[1 : reach + 1] += ahead[0] * own
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
    return np.log(np.maximum(ahead[0], 1e-300)) + log


def expected(lattice: Lattice, words: list[str], counts: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of counted words."""
    table = np.append(probabilities, 0.0)[:, None]
    uses = np.zeros(lattice.n)
    for some in groups(words):
        own = [words[k] for k in some]
        cut, ends = lattice.cut(own), np.array([len(words[k]) + 1 for k in some])
        sums, whole, scale = forward(cut, ends, table)
        scale = scale[:, :, 0]  # there is one language
        n, width, longest = cut.shape
        later = np.zeros((width + 1, n))  # sums from a position to the word's end, times the scale up to there, over the word's likelihood
        for at in range(width, -1, -1):
            later[at][ends == at] = np.exp(scale[at] - whole[:, 0])[ends == at]
            for size in range(1, min(longest, width - at) + 1):
                ids = cut[:, at, size - 1]
                p = step(ids, table, size)[:, 0]
                here = np.where(at + size <= ends, later[at + size] * p * np.exp(scale[at] - scale[at + size]), 0.0)
                later[at] += here
                use = sums[at][:, 0] * here
                hit = ids >= 0
                uses += np.bincount(ids[hit], (use * counts[some])[hit], lattice.n)
    return uses


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    return (text or "").lower().split()


def fitted_words(text: str | None) -> list[str]:
    """The words of a text that a model is fitted to, long ones in parts."""
    return [w[k : k + FITTED] for w in words_of(text) for k in range(0, len(w), FITTED)]


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> Model:
    """A model of the words of labelled texts: how often each occurs, by language."""
    lattice, names, columns = Lattice(pieces), sorted(counts), []
    for name in names:
        own = sorted(counts[name])
        times = np.array([counts[name][w] for w in own], np.float64)
        p = np.full(len(pieces), 1 / max(1, len(pieces)))
        for _ in range(rounds if own else 0):
            uses = expected(lattice, own, times, p)
            p = (1 - EVEN) * uses / max(uses.sum(), 1e-300) + EVEN / len(pieces)
        columns.append(np.append(p, 0.0))
    return Model(names, pieces, np.array(columns).T if columns else np.zeros((len(pieces) + 1, 0)))


def learn(docs: DataFrame, pieces_path: str, sample: int = SAMPLE) -> Model:
    """Fit to ``docs`` (doc_id, text, lang), all of which may be learned from; rows without a language are left out."""
    rows = take(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull())
    chosen = first_by_hash(rows.select("doc_id", "lang").distinct(), "lang", sample).select("place", F.col("doc_id").alias("chosen"), F.col("lang").alias("of"))
    same = (F.col("lang") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("chosen"))
    texts = rows.join(F.broadcast(chosen), same).groupBy("lang", "place").agg(F.min("text").alias("text"))  # at most `sample` ids a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(name, Counter()).update(fitted_words(text))
            for name, words in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array([*words], pa.string()), pa.array([*words.values()], pa.int64())], ["lang", "word", "n"])

    counted = texts.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {r[0]: {} for r in texts.select("lang").distinct().collect()}
    for name, word, n in counted.collect():  # distinct words of the sample
        counts[name][word] = n
    return fit(counts, pieces_of(pieces_path))


class Scorer:
    """Scores texts, with the likelihoods of words it has met in a table of bounded size."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((KEPT_WORDS, len(model.names)))

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        names = self.model.names
        split = [words_of(t) for t in texts]
        got = [[*map(self.known.get, words)] for words in split]
        fresh = list({w for words, g in zip(split, got) if None in g for w, k in zip(words, g) if k is None})
        late, extra = {}, np.zeros((0, len(names)))
        if fresh:
            fresh.sort(key=lambda w: len(w) > FITTED)  # long words are not kept
            found, first = self.model.likelihoods(fresh), len(self.known)
            room = min(sum(len(w) <= FITTED for w in fresh), KEPT_WORDS - first)
            self.known.update(zip(fresh[:room], range(first, first + room)))
            self.table[first : first + room] = found[:room]
            late = {w: -1 - k for k, w in enumerate(fresh[room:])}
            extra = found[room:]
        out = []
        for text, words, at in zip(texts, split, got):
            if not names or not text or not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
                continue
            new: list[int] = []
            if None in at:  # met in these texts: in the table by now, or only in ``extra``
                at = [(self.known[w] if w in self.known else late[w]) if k is None else k for w, k in zip(words, at)]
                new = [-1 - k for k in at if k < 0]
                at = [k for k in at if k >= 0]
            total = self.table[at].sum(axis=0) + extra[new].sum(axis=0)
            best = int(np.argmax(total))
            out.append((names[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predictions(docs: DataFrame, model: Model, name: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``docs`` (with ``text``), and the language and its posterior."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.names, model.pieces, model.table.astype(np.float32)))  # vocabulary x languages
    at, key = position(docs, "text"), uuid.uuid4().hex

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make() -> Scorer:
            names, pieces, table = shared.value
            return Scorer(Model(names, pieces, table.astype(np.float64)))

        scorer = kept(key, make)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = scorer.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*part.schema.names, name, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(label, schema)
