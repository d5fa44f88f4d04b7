"""Vectors in ``array<float>`` columns: norm, cosine, signatures, Hamming distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 128
# The constants of the signature's hyperplanes.
SEED, BY_DIMENSION, BY_BIT, BY_INDEX = 0x6A09E667F3BCC909, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def is_valid(a: Column) -> Column:
    """Of 1 to 4,096 finite components, not all of them zero."""
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.size(a).between(1, 4096) & finite & F.exists(a, lambda x: x != 0), F.lit(False))


def hyperplanes(dimension: int) -> np.ndarray:
    """+1 or -1 by (bit, index), from a mix of 64-bit words."""
    with np.errstate(over="ignore"):
        bit, index = np.arange(BITS, dtype=np.uint64)[:, None], np.arange(dimension, dtype=np.uint64)[None, :]
        x = np.uint64(SEED) ^ (np.uint64(dimension) * np.uint64(BY_DIMENSION)) ^ (bit * np.uint64(BY_BIT)) ^ (index * np.uint64(BY_INDEX))
        for shift, by in ((30, BY_BIT), (27, BY_INDEX)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        x ^= x >> np.uint64(31)
    return np.where(x & np.uint64(1), -1.0, 1.0)


@F.pandas_udf(T.StructType().add("low", T.LongType()).add("high", T.LongType()))
def signature(vectors: pd.Series) -> pd.DataFrame:
    """The signs of a vector's products with 128 fixed hyperplanes, as two words, lowest bit first."""
    out, planes = np.zeros((len(vectors), 2), np.uint64), {}
    for k, v in enumerate(vectors):
        if v is None:
            continue
        v = np.asarray(v, np.float64)
        if len(v) not in planes:
            planes[len(v)] = hyperplanes(len(v))
        bits = (planes[len(v)] @ v < 0).astype(np.uint8)
        out[k] = np.packbits(bits, bitorder="little").view("<u8")
    return pd.DataFrame(out.view(np.int64), columns=["low", "high"])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a["low"].bitwiseXOR(b["low"])) + F.bit_count(a["high"].bitwiseXOR(b["high"]))
