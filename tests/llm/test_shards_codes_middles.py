"""Histogram sort, vector codes and fill-in-middle against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import fim, queries, sharding, vectorcodes

from ..compare import same

TEXT = "doc_id long, text string"
ODD = ["", None, " ", "abc", "a b", "é", "日本 語x", "x<P>y", "<S>", "<M", "ends with <S", "a<" * 5, "w" * 700, "1 2\n\n\t3", "\x00a\x00", "🙂🙂 ok🙂", "Aa" * 40 + "é" * 40]


def plain_middle(doc_id, text):
    """The contract of op13, one text at a time."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, found = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(found[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text or ""
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def test_rank_and_select():
    rng = np.random.default_rng(5)
    for size in (0, 1, 63, 64, 511, 512, 513, 5000):
        for density in (0.0, 0.02, 0.5, 1.0):
            flags = rng.random(size) < density
            bits, ones = fim.Bits(flags), np.flatnonzero(flags)
            at = np.arange(size + 1)
            assert bits.rank(at).tolist() == np.concatenate([[0], np.cumsum(flags)]).tolist()
            assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


def test_middles_equal_a_plain_version(spark):
    rng = random.Random(2)
    mixed = ["".join(rng.choice(["the", " ", "é", "日", "\n", "X1", "<", "S>", "🙂"]) for _ in range(rng.randrange(200))) for _ in range(300)]
    texts = [*ODD, *mixed, "long wörd 9 " * 200_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "no id at all"), (7, "same id"), (7, "same id")]
    found = fim.transform(spark.createDataFrame(rows, TEXT).repartition(5)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r) for r in found.collect()), key=key)
    want = sorted(((i, *plain_middle(i, t), t or "") for i, t in rows), key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_middles_sql_and_cases(spark, sf_dir):
    same(spark, sf_dir, queries.QUERIES["op13_fill_in_middle"], queries.SQL["op13_fill_in_middle"])
    clash = spark.createDataFrame([(1, "a b c", "x", "y")], "doc_id long, text string, TEXT string, output string")
    assert tuple(fim.transform(clash).first())[1:] == plain_middle(1, "a b c")
    assert fim.transform(spark.createDataFrame([], TEXT)).count() == 0


def shard_facts(rows, given, n, tolerance):
    """What holds for any shards of ``given`` (doc_id, text)."""
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in rows) == sorted((str(i), str(t)) for i, t in given)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    for k in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    line = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    texts = [r["text"] for r in line]
    first, last = {}, {}
    for at, t in enumerate(texts):
        first.setdefault(t, at)
        last[t] = at
    assert all(last[t] - first[t] + 1 == texts.count(t) for t in first)  # equal texts are neighbours
    ends = np.cumsum([0, *(r["size"] for r in line)])
    total = ends[-1]
    for k in range(1, n):
        at = sum(r["shard"] < k for r in line)
        off, slack = abs(ends[at] - total * k // n), total / n * tolerance
        nearest = np.abs(ends - total * k // n).min()
        assert off <= slack or off == nearest
        if 0 < at < len(line) and texts[at - 1] == texts[at]:  # a group is cut where its borders are too far off alone
            assert all(abs(ends[x] - total * k // n) > slack for x in (first[texts[at]], last[texts[at]] + 1))


@pytest.mark.parametrize("n,probes,task_bytes", [(8, 8, 128 << 20), (3, 2, 500), (1, 8, 128 << 20)])
def test_shards(spark, n, probes, task_bytes):
    rng = random.Random(n)
    some = [(k, "w" * rng.randrange(60)) for k in range(300)] + [(k, "hot copy " * 3) for k in range(1000, 1250)]
    some += [(None, "no id"), (None, "no id"), (5, None), (6, None), (7, ""), (9, "same"), (9, "same"), (10, "one long text " * 200)]
    docs = spark.createDataFrame(some, TEXT).repartition(6)
    shard_facts(sharding.shards(docs, n, probes=probes, task_bytes=task_bytes).collect(), some, n, sharding.TOLERANCE)


def test_shards_of_repeated_rows_and_cases(spark, sf_dir):
    given = [(3, "again")] * 400 + [(None, None)] * 50
    rows = sharding.shards(spark.createDataFrame(given, TEXT), 8).collect()
    shard_facts(rows, given, 8, sharding.TOLERANCE)
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 12  # two rows
    assert sharding.shards(spark.createDataFrame([], TEXT), 8).count() == 0
    assert sharding.shards(spark.createDataFrame([(1, "x")], TEXT), 8).count() == 1
    clash = spark.createDataFrame([(k, str(k), 5, 6) for k in range(20)], "doc_id long, text string, shard int, SIZE int")
    shard_facts(sharding.shards(clash, 2).collect(), [(k, str(k)) for k in range(20)], 2, sharding.TOLERANCE)
    frame = queries.op11_shards(spark, sf_dir).toPandas()
    docs = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(frame["doc_id"]) == sorted(docs) and set(frame["law"]) == {"bytes"} and frame["grown_shard"].isna().all()
    assert all(zlib.crc32(docs[d].encode()) == c for d, c in zip(frame["doc_id"], frame["text_crc32"]))


@pytest.mark.parametrize("seed", range(4))
def test_splitters_are_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 5, 6, 1 << 61, rng.randrange(1 << 62)]), rng.choice([1, rng.randrange(1 << 62)]), k, rng.choice([1, 1, 9, 400])) for k in range(200)]
    frame = spark.createDataFrame(rows, "k1 long, k2 long, k3 long, size long").repartition(3)
    total = sum(r[3] for r in rows)
    targets = [(total * t // 10, rng.choice([0, 0.5, 30])) for t in range(11)]
    line = sorted((a << 128 | b << 64 | c, s) for a, b, c, s in rows)
    ends = np.cumsum([0, *(s for _, s in line)])
    for (target, slack), (key, below, count) in zip(targets, sharding.splitters(frame, targets, (total, len(rows)), 3)):
        assert (below, count) == (sum(s for k, s in line if k < key), sum(k < key for k, _ in line))
        assert abs(below - target) <= slack or abs(below - target) == np.abs(ends - target).min()


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """Lloyd's rounds with every distance: {row number: (code, error)} and the books."""
    kept = [k for k, (_, v, _) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(rows[k][1])))
    if not kept:
        return {}, None
    length = len(rows[order[0]][1])
    same_length = [k for k in kept if len(rows[k][1]) == length]
    whole = {k: np.floor(np.array(rows[k][1], np.float32).astype(np.float64) * 4096).astype(int).reshape(parts, -1) for k in same_length}
    books = [[whole[k][p].tolist() for k in order[:entries] if k in whole] for p in range(parts)]
    for r in range(rounds + 1):
        best = {k: [min((sum((int(x) - c) ** 2 for x, c in zip(v[p], entry)), j) for j, entry in enumerate(books[p])) for p in range(parts)] for k, v in whole.items()}
        if r < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    if mine := [whole[k][p] for k in whole if best[k][p][1] == j]:
                        books[p][j] = [int(sum(map(int, c))) // len(mine) for c in zip(*mine)]
    found = {k: ("".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for k, b in best.items()}
    return found | {k: (None, None) for k in kept if k not in whole}, books


SPACE = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("case", ["spread", "ties", "few", "large", "odd"])
def test_codes_equal_plain_lloyd(spark, case):
    rng = np.random.default_rng(11)
    vector = {
        "spread": lambda: rng.normal(0, 0.2, 32),
        "ties": lambda: rng.integers(-2, 3, 32) / 4096,
        "few": lambda: rng.normal(0, 1, 16),
        "large": lambda: rng.normal(0, 900, 16),
        "odd": lambda: rng.integers(-3, 4, 8) / 4.0,
    }[case]
    rows = [(k, [float(np.float32(x)) for x in vector()], int(k % 5) or None) for k in range({"few": 9}.get(case, 400))]
    if case == "odd":
        width = 8
        rows += [(401, None, 1), (402, [None] + [0.0] * (width - 1), 1), (403, [float("nan")] * width, 1), (404, [float("inf")] * width, 2), (None, [0.25] * width, None), (405, [1.0] * 16, 3), (406, [], 3)]
        rows += [(3, [0.5] * width, 1), (3, [0.5] * width, 1), (3, [-0.5] * width, 1)] + [(2000 + k, [0.75] * width, 4) for k in range(300)]
    want, books = plain_codes(rows)
    made = vectorcodes.compress(spark.createDataFrame(rows, SPACE).repartition(5))
    got = vectorcodes.with_label_errors(made.codes).collect()
    assert made.digest == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["id"], r["label"], r["code"], r["error"]) for r in got), key=key) == sorted(((rows[k][0], rows[k][2], *v) for k, v in want.items()), key=key)
    for label in {r["label"] for r in got}:
        sums = {r["label_error"] for r in got if r["label"] == label}
        assert sums == {sum(v[1] or 0 for k, v in want.items() if rows[k][2] == label)} or sums == {None}


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 3000, (16, 2, 8))
    vectors = (centres[rng.integers(0, 16, 3000)] + rng.normal(0, 300, (3000, 2, 8))).astype(np.int64)
    for unit in (1, 8):
        books = vectors[:16].transpose(1, 0, 2).copy()
        b = vectorcodes.Bounds.of(vectors, books, unit)
        full = b.measured
        for _ in range(6):
            sums = b.sums(16)
            new = np.where(sums[:, :, -1:] > 0, sums[:, :, :-1] // np.maximum(sums[:, :, -1:], 1), books)
            b.shift(vectorcodes.moved(books, new, unit))
            books, b.measured = new, 0
            b.assign(books, unit)
            for p in range(2):
                squares = vectorcodes.apart(vectors[:, p], books[p])
                assert (b.entry[:, p] == squares.argmin(axis=1)).all()
                true = np.sqrt(squares.astype(float)) / unit
                assert (b.upper[:, p] >= true.min(axis=1) - 1e-9).all() and (b.lower[:, p] <= true + 1e-9).all()
        assert b.measured < full / 4  # most entries are passed over


def test_codes_sql_and_cases(spark, sf_dir):
    same(spark, sf_dir, queries.QUERIES["op12_vector_codes"], queries.SQL["op12_vector_codes"])
    assert vectorcodes.with_label_errors(vectorcodes.compress(spark.createDataFrame([], SPACE)).codes).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1)], SPACE)).codes.count() == 0
    clash = spark.createDataFrame([(k, [k / 8.0] * 8, 1, "x", "y") for k in range(40)], SPACE + ", entry string, LABEL string")
    assert vectorcodes.compress(clash).codes.select("code").distinct().count() == 16
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [1.0] * 9, 1)], SPACE))
    with pytest.raises(ValueError):
        vectorcodes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], SPACE))
