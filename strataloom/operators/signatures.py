"""The nearest of 128-bit signatures by Hamming distance, exactly, from a kept index of their bands.

A signature is cut into 8 bands of 16 bits.  The index has a row for each signature and band, in a folder (slot) for each
band and each value of the band's first ``bits`` bits.  Two signatures that differ in at most 8 r + 7 bits have a band
in which they differ in at most r, so the folders within r bits of the query's, of all bands, hold all of them.  ``nearest``
lets r grow, reading each folder once, until as many as are wanted are that near; then no other row can be nearer.  Where the
folders to read would hold more rows than there are signatures, it reads one band whole instead, which holds all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import vectors as V
from strataloom.index import named
from strataloom.sources.scratch import remove, scratch, settled, staged

BANDS, WIDTH = 8, 16
#: Signatures to a slot that the number of bits aims at, and most bits: 8,192 folders.
SLOT_ROWS, MOST_BITS = 256, 10


def bits_for(n: int) -> int:
    return min(MOST_BITS, max(2, math.ceil(math.log2(max(n, 1) / SLOT_ROWS))))


def ring(signature: tuple[int, int], bits: int, radius: int) -> list[int]:
    """The slots, of all bands, whose value differs from the signature's in exactly ``radius`` bits; 8 times 2^bits at most."""
    out = []
    for band in range(BANDS):
        own = (signature[band // 4] >> WIDTH * (band % 4)) % (1 << WIDTH) >> (WIDTH - bits)
        out += [band << WIDTH | v for v in range(1 << bits) if (own ^ v).bit_count() == radius]
    return out


def share(bits: int, radius: int) -> float:
    """Rows in the slots within a radius, in times the number of signatures, if the bits are evenly spread."""
    return BANDS * sum(math.comb(bits, k) for k in range(radius + 1)) / (1 << bits)


def of_vector(vector: tuple[float, ...]) -> tuple[int, int]:
    """The signature of one vector, as ``vectors.signature`` gives it."""
    import numpy as np
    import pandas as pd

    found = V.signature.func(pd.Series([np.asarray(vector, np.float32)]))
    return int(found["low"][0]), int(found["high"][0])


class Signatures:
    """An index of (key columns, low, high) in a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(path)
        self.bits = (self.rows.select("bits").first() or (MOST_BITS,))[0]
        self.key = [c for c in self.rows.columns if c not in ("low", "high", "bits", "slot")]

    def slots(self, slots: list[int]) -> DataFrame:
        return self.rows.filter(F.col("slot").isin(slots)).select(*self.key, "low", "high")

    def whole(self) -> DataFrame:
        """Each signature once: the first band's slots."""
        return self.slots(list(range(1 << self.bits)))

    def grown(self, signature: tuple[int, int], most: int, live: DataFrame) -> tuple[DataFrame, int | None]:
        """Rows of ``live`` (the key's columns) with their distance, the nearest ``most`` and perhaps others among them; the last radius, or none if all were read."""
        far = F.bit_count(F.col("low").bitwiseXOR(F.lit(signature[0]))) + F.bit_count(F.col("high").bitwiseXOR(F.lit(signature[1])))
        told = lambda df: df.withColumn("distance", far).drop("low", "high").join(live, self.key, "left_semi").distinct()
        found, radius = None, 0
        while radius <= self.bits and share(self.bits, radius) <= 1:
            new = told(self.slots(ring(signature, self.bits, radius)))
            found = staged(new if found is None else found.union(new).distinct(), "near")
            if found.filter(F.col("distance") < BANDS * (radius + 1)).limit(most).count() == most:
                return found, radius
            radius += 1
        return told(self.whole()), None

    def nearest(self, signature: tuple[int, int], most: int, live: DataFrame) -> DataFrame:
        """Of rows of ``live`` those with the ``most`` least (distance, key), with their distance."""
        return settled(live.sparkSession, "nearest", lambda: self.grown(signature, most, live)[0].orderBy("distance", *self.key).limit(most))


def slot_columns(bits: int) -> list[Column]:
    own = lambda band: F.shiftrightunsigned(F.col("low" if band < 4 else "high"), WIDTH * (band % 4)).bitwiseAND(F.lit((1 << WIDTH) - 1))
    return [(F.lit(band << WIDTH) + F.shiftright(own(band), WIDTH - bits)).cast("int") for band in range(BANDS)]


def write(rows: DataFrame, path: str, bits: int | None = None) -> None:
    """Write the index of ``rows`` (key columns, signature) to a folder that must not exist yet.  A row with a null key or signature is left out; equal rows count once.

    Slots that hold many rows are split between tasks by adaptive execution.
    """
    spark = rows.sparkSession
    key = [c for c in rows.columns if c != "signature"]
    flat = staged(rows.select(*key, "signature.low", "signature.high").dropna().distinct(), "signatures")
    n = flat.count()
    bits = bits or bits_for(n)
    entries = flat.withColumn("slot", F.explode(F.array(*slot_columns(bits)))).withColumn("bits", F.lit(bits))
    made = scratch(spark, "signatures")
    if n:
        entries.hint("rebalance", "slot").write.partitionBy("bits", "slot").parquet(made)
    else:
        entries.write.parquet(made)  # no folders would have no schema
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(fs_path(path)) and not files.rename(fs_path(made), fs_path(path)):
        raise OSError(f"cannot rename to {path}")
    remove(spark, made)


def kept(spark: SparkSession, name: str, sources: list[DataFrame], make) -> Signatures:
    """The index of what ``make`` gives, built in the shared folder the first time and found there after, by the sources' files."""
    path = named(spark, f"signatures-{name}", sources)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        write(make(), path)
    return Signatures(spark, path)
