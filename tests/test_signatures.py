"""The index of signatures against a scan of all distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.operators import signatures as N


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def made(rng, n, near):
    """``near`` signatures within 6 bits of a query's, and others at random."""
    query = rng.getrandbits(128)
    own = [query]
    for _ in range(near):
        x = query
        for bit in rng.sample(range(128), rng.randrange(7)):
            x ^= 1 << bit
        own.append(x)
    own += [rng.getrandbits(128) for _ in range(n - len(own))]
    rng.shuffle(own)
    return query, own


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    query, own = made(random.Random(7), 20_000, 700)
    path = str(tmp_path_factory.mktemp("signatures") / "index")
    rows = spark.createDataFrame([(k, signed(x % (1 << 64)), signed(x >> 64)) for k, x in enumerate(own)], "id long, low long, high long").select("id", F.struct("low", "high").alias("signature"))
    extra = spark.createDataFrame([(None, 1, 2)], "id long, low long, high long").select("id", F.struct("low", "high").alias("signature"))
    N.write(rows.union(rows.limit(5)).union(extra), path, bits=8)
    return query, own, N.Signatures(spark, path)


def scanned(own, query, most, live):
    return sorted(((own[k] ^ query).bit_count(), k) for k in live)[:most]


def asked(query):
    return signed(query % (1 << 64)), signed(query >> 64)


def test_near_ones_are_found_in_a_share_of_the_table(spark, table):
    query, own, index = table
    live = spark.range(20_000)
    got = sorted((r["distance"], r["id"]) for r in index.nearest(asked(query), 512, live).collect())
    assert got == scanned(own, query, 512, range(20_000))
    assert index.grown(asked(query), 512, live)[1] == 0
    read = index.slots(N.ring(asked(query), 8, 0))
    assert read.count() < 0.3 * 20_000  # 8 of 2,048 folders: a 32nd, and the near ones in several bands each
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and index.whole().count() == 20_000


@pytest.mark.parametrize("most, every", [(10, 1), (512, 20), (1000, 1), (30_000, 1), (1, 7)])
def test_equal_to_a_scan(spark, table, most, every):
    query, own, index = table
    live = spark.range(0, 20_000, every)
    got = sorted((r["distance"], r["id"]) for r in index.nearest(asked(query), most, live).collect())
    assert got == scanned(own, query, most, range(0, 20_000, every))
    far = query ^ ((1 << 128) - 1)  # nothing is near: all of a band is read
    rows, radius = index.grown(asked(far), 5, live)
    assert radius is None and sorted((r["distance"], r["id"]) for r in rows.orderBy("distance", "id").limit(5).collect()) == scanned(own, far, 5, range(0, 20_000, every))


def test_ties_and_empty_tables(spark, tmp_path):
    rows = spark.range(50).select("id", F.struct(F.lit(3).cast("long").alias("low"), F.lit(-1).cast("long").alias("high")).alias("signature"))
    N.write(rows, str(tmp_path / "ties"))
    index = N.Signatures(spark, str(tmp_path / "ties"))
    assert sorted(r["id"] for r in index.nearest((3, -1), 7, spark.range(10, 50)).collect()) == [*range(10, 17)]  # ties go to lower keys
    assert index.nearest((3, -1), 7, spark.range(0)).count() == 0
    N.write(rows.limit(0), str(tmp_path / "none"))
    assert N.Signatures(spark, str(tmp_path / "none")).nearest((3, -1), 7, spark.range(9)).count() == 0


def test_bits_grow_with_the_table():
    assert [N.bits_for(n) for n in (0, 1000, 1 << 14, 1 << 16, 1 << 40)] == [2, 2, 6, 8, N.MOST_BITS]
    assert N.share(8, 0) == 8 / 256 and N.share(8, 8) == N.BANDS and sum(len(N.ring((5, 9), 4, r)) for r in range(5)) == 8 * 16


def test_the_vector_channel_compares_all_vectors_of_a_large_table(spark):
    """5,000 eligible vectors: the best by cosine, not the best of those with near signatures."""
    from types import SimpleNamespace

    from strataloom.operators import retrieval as R

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(5000, 6)).astype(np.float32)
    frame = spark.createDataFrame([(k, 1, "h", v.tolist()) for k, v in enumerate(vectors)], "memory_id long, revision long, content_hash string, vector array<float>")
    live = frame.select("memory_id", "revision", "content_hash", F.col("memory_id").alias("updated_seq"))
    got = R.dense(SimpleNamespace(projections=frame), R.Request("", "n", vector=tuple(map(float, vectors[7])), min_similarity=-1.0), live=live)
    wide = vectors.astype(np.float64)
    cosines = wide @ wide[7] / (np.linalg.norm(wide, axis=1) * np.linalg.norm(wide[7]))
    best = sorted(range(5000), key=lambda k: (-cosines[k], k))[:512]
    assert [r["memory_id"] for r in got.orderBy("rank").collect()] == best
