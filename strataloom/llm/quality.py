"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in blocks with either dictionary; a block of its own keeps
long texts from being their own dictionary.  The difference of the two sizes
over the larger one is the text's margin, and a logistic curve fitted to the
margins of labelled texts that no dictionary has seen makes it a probability.

The fit takes a bounded sample of labelled rows: of each label the ``SAMPLE``
documents with the smallest MD5 of their id (a parameter), the first half for the
dictionaries and the rest for the curve, which weighs each label by its number
of all labelled rows.

Defined cases: null and empty texts have margin 0 and the score of that margin;
without labels of both kinds every score is the share of label 1, or 0.5; of
repeated labels of a document the largest counts, and of rows with one id the
fit takes the smallest text; texts of any length are read whole, also those of
the fit, which are on the driver; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import first_by_hash, kept, position, slices, small_batches, take

#: Labelled documents of each label in the fit.
SAMPLE = 800
BLOCK = 512
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def __post_init__(self) -> None:
        self.packers = []
        for raw in (self.good, self.bad):
            kept = zstandard.ZstdCompressionDict(raw) if raw else None
            if kept is not None:
                kept.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False))

    def margin(self, text: str | None) -> float:
        """From -1 (like bad text) to 1 (like good text)."""
        if not text or not (self.good and self.bad):
            return 0.0
        body = text.encode("utf-8", "surrogatepass")
        blocks = [body[k : k + BLOCK] for k in range(0, len(body), BLOCK)]
        good, bad = (sum(map(len, map(packer.compress, blocks))) for packer in self.packers)
        return (bad - good) / max(good, bad)

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of all of the texts' blocks, in a fixed mixed order."""
    blocks = [body[k : k + BLOCK] for t in texts for body in [(t or "").encode("utf-8", "surrogatepass")] for k in range(0, len(body), BLOCK)]
    np.random.default_rng(0).shuffle(blocks)
    size = min(DICTIONARY_BYTES, sum(map(len, blocks)) // 4)
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes() if size >= 256 else b""
    except zstandard.ZstdError:  # too little text to find anything in
        return b""


def curve(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve with the largest weighted likelihood, lightly held back."""
    design, fit = np.column_stack([margins, np.ones(len(margins))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ fit, -30, 30)))
        pull = np.array([1e-3, 1e-6])
        step = np.linalg.solve((design * (weights * p * (1 - p))[:, None]).T @ design + np.diag(pull), design.T @ (weights * (labels - p)) - pull * fit)
        fit = fit + np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-9:
            break
    return float(fit[0]), float(fit[1])


def fit(good: list[str], bad: list[str], n_good: int, n_bad: int) -> Model:
    """From texts of either label, the first half of each for the dictionaries; n_good and n_bad: labelled rows in all."""
    share = (n_good + 1) / (n_good + n_bad + 2)
    model = Model(dictionary(good[: (len(good) + 1) // 2]), dictionary(bad[: (len(bad) + 1) // 2]), 0.0, float(np.log(share / (1 - share))))
    held = [good[(len(good) + 1) // 2 :], bad[(len(bad) + 1) // 2 :]]
    if model.good and model.bad and all(held):
        margins = np.array([model.margin(t) for some in held for t in some])
        labels = np.repeat([1.0, 0.0], [*map(len, held)])
        weights = np.where(labels == 1, n_good / len(held[0]), n_bad / len(held[1])) / (n_good + n_bad) * len(labels)
        model.slope, model.offset = curve(margins, labels, weights)
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit to ``docs`` (doc_id, text), all of which may be learned from, and ``labels`` (doc_id and the label)."""
    known = take(labels, "doc_id", label).toDF("doc_id", "label").filter("label is not null and doc_id is not null").groupBy("doc_id").agg((F.max("label") > 0).alias("label"))
    rows = take(docs, "doc_id", "text")
    known = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    chosen = first_by_hash(known, "label", sample)
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("label", "place").agg(F.min("text").alias("text")).collect()  # 2 x `sample` rows at most
    by = {k: [r[2] for r in sorted((r for r in found if r[0] is k), key=lambda r: (r[1], r[2] or ""))] for k in (True, False)}
    return fit(by[True], by[False], totals.get(True, 0), totals.get(False, 0))


def scores(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """All columns of ``docs`` (with ``text``) and the probability of label 1."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.slope, model.offset))  # two dictionaries of bounded size
    at, key = position(docs, "text"), uuid.uuid4().hex

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(key, lambda: Model(*shared.value))
        for batch in (part for whole in batches for part in slices(whole)):
            found = [own.score(own.margin(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))
