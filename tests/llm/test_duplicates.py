"""Exact and near duplicates, mixing and the pipeline against plain versions."""

import random
import re

import numpy as np
import pytest

from strataloom.llm import exactdedup, jaccard, mixing, queries
from strataloom.llm.shared import take

from ..compare import same


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) by all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    lists = {}
    for k, s in enumerate(sets):
        both = {}
        for x in s:
            for j in lists.setdefault(x, []):
                both[j] = both.get(j, 0) + 1
            lists[x].append(k)
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[max(root(k), root(j))] = min(root(k), root(j))
    least = {}
    for k, (d, _) in enumerate(rows):
        least.setdefault(root(k), []).append(d)
    return sorted((d, len(sets[k]), min(least[root(k)])) for k, (d, _) in enumerate(rows))


def crowd(seed, n, bases):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [r.choice(words) for _ in range(40)]
    texts = [[r.choice(words) for _ in range(r.randrange(3, 80))] for _ in range(bases)]
    out = []
    for k in range(n):
        t = list(texts[min(int(r.expovariate(5 / bases)), bases - 1)])
        for _ in range(r.randrange(0, 2 + len(t) // 18)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append((k, " ".join(t + (passage[: r.randrange(5, 40)] if r.random() < 0.2 else []))))
    return out


@pytest.mark.parametrize("seed, n, bases, limit", [(1, 400, 30, 400_000), (2, 400, 4, 300)])
def test_jaccard(spark, monkeypatch, seed, n, bases, limit):
    monkeypatch.setattr(jaccard.class_links, "__defaults__", (limit,))
    rows = [*crowd(seed, n, bases), (1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, " \n"), (1005, "x " * 4000), (1006, "x " * 4000)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r)[:3] for r in got.collect()) == near(rows)


def test_jaccard_template_crowds(spark):
    # documents that share most of their shingles but not enough to link, with planted pairs that do, and long ones
    r, template, pool = random.Random(5), [f"t{k}" for k in range(14)], [f"p{k}" for k in range(12)]
    rows = []
    for k in range(0, 500, 2):
        own = [f"a{r.random()}", f"b{r.random()}"] if k % 4 else [r.choice(pool), r.choice(pool)]
        rows += [(k, " ".join(template + own)), (k + 1, " ".join(template + own + ["x"] * (k % 3)))]
    rows += [(1000, "y " * 300_000 + "z"), (1001, "y " * 200_000 + "z"), (1002, "y" * 1_000_000)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(tuple(x)[:3] for x in got.collect()) == near(rows)


def test_jaccard_inside_a_group():
    r = np.random.default_rng(8)
    for _ in range(30):
        base = [r.integers(0, 60, 25) for _ in range(3)]
        sets = [np.unique(np.r_[base[k % 3][: 25 - k % 4], r.integers(60, 90, r.integers(0, 6))]).astype(np.uint64) for k in range(24)]
        index = jaccard.Inverted(sets, 80, 16)
        for k, own in enumerate(sets):
            want = [j for j in range(16) if j != k and 100 * len(np.intersect1d(own, sets[j])) >= 80 * len(np.union1d(own, sets[j]))]
            assert index.linked(k).tolist() == want


def test_jaccard_repeated_tasks_name_chunks_alike(spark, monkeypatch):
    docs, seen, plain = spark.createDataFrame(crowd(3, 300, 20), "doc_id long, text string").repartition(5, "doc_id"), [], jaccard.staged
    monkeypatch.setattr(jaccard, "CHUNK", 1000)
    monkeypatch.setattr(jaccard, "staged", lambda df, name: seen.append(sorted((x["chunk"], x["kind"], x["a"], x["b"]) for x in plain(df, name).collect())) or plain(df, name))
    for _ in range(2):
        jaccard.screen(docs, 5, 80).count()
    assert seen[0] == seen[1] and len({x[0] for x in seen[0]}) >= 5


def test_jaccard_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op1_jaccard_join(spark, sf_dir).collect())) == near(rows)


def test_jaccard_repeated_and_null_ids(spark):
    a, b = "one two three four five six seven", "other words stand here in this one"
    rows = spark.createDataFrame([(3, a, 1), (3, b, 2), (3, b, 2), (None, a, 3), (9, a + " x", 4)], "doc_id long, text string, Component_Id long")
    got = sorted(map(tuple, jaccard.jaccard_components(rows).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(3, 3, 3), (3, 3, 3), (3, 3, 3), (None, 3, 3), (9, 4, 9)], key=str)
    assert jaccard.jaccard_components(rows.limit(0)).count() == 0


@pytest.mark.parametrize("memtable", [1, 300, 1 << 20])
def test_exact(spark, memtable):
    r = random.Random(memtable)
    texts = [None, "", " \t", "a b", "ab", "a\nb ", "é", "é", *("w" * r.randrange(1, 6) + " " * r.randrange(3) for _ in range(60)), "z" * 100_000]
    rows = [(k // 2 if k > 40 else k, t) for k, t in enumerate(texts)]
    got = exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), memtable).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    want = sorted((d, min(g)[1], len(g)) for g in groups.values() for _, d in g)
    assert sorted((x["doc_id"], x["keep_id"], x["group_size"]) for x in got) == want
    assert sum(x["kept"] for x in got) == len(groups)


def test_exact_sql_and_cases(spark, sf_dir):
    same(spark, sf_dir, queries.op7_exact_dedup, queries.SQL["op7_exact_dedup"])
    rows = spark.createDataFrame([(None, "a", 1), (None, "a ", 1), (4, "a", 1)], "doc_id long, text string, Keep_Id long")
    got = exactdedup.exact_duplicates(rows).collect()
    same_digest = exactdedup.exact_duplicates(rows.repartition(3), memtable=1).collect()  # a run a row: rows without an id are verified too
    assert sorted(map(str, same_digest)) == sorted(map(str, got))
    assert {(x["doc_id"], x["keep_id"], x["kept"]) for x in got} == {(None, None, True), (None, None, False), (4, None, False)} and len(got) == 3
    assert exactdedup.exact_duplicates(rows.limit(0)).count() == 0


def test_clashing_names_in_the_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    text = "the words of one document that stands here as it is"
    rows = spark.createDataFrame([(1, text, "en", "a", 9, 1, "x"), (1, text + " x", "en", "a", 9, 1, "x"), (None, "other " * 9, "en", None, 9, 2, "y")], "doc_id long, text string, lang string, source string, n_chars long, DOC_ID long, Text string")
    for name, stage in P.STAGES[1:4]:
        got = stage(spark, rows, sf_dir)
        assert got.columns == rows.columns and 0 < got.count() <= 6, name
    assert P.pack(spark, rows, sf_dir).count() == 3


def test_mix(spark, sf_dir):
    same(spark, sf_dir, queries.op9_mix, queries.SQL["op9_mix"])
    schema = "doc_id long, text string, source string, SIZE long"
    rows = [(k, "w " * (k % 7), ["a", "b", None, "c"][k % 4], 1) for k in range(200)] + [(7, "x y", "a", 1), (7, "x y", "a", 1), (None, None, "b", 1), (300, "long " * 5000, "c", 1)]
    docs, packet = spark.createDataFrame(rows, schema), 8
    got = mixing.mix(docs, packet=packet).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(1.5 * total)
    assert sum(r["taken"] for r in got) == int(1.5 * total + 0.5)
    for x in by.values():
        assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= packet * len(by) and x[0]["target"] <= 2 * x[0]["source_size"]
    line = mixing.schedule(docs, packet=packet).collect()
    line.sort(key=lambda r: (r["position"], r["finish"]))
    assert [r["position"] for r in line] == np.cumsum([r["words"] for r in line]).tolist()
    finishes = [r["finish"] for r in line]
    assert finishes == sorted(finishes) and max(r["words"] for r in line) == packet
    budget = int(1.5 * total + 0.5)
    assert all(r["taken"] == max(0, min(r["words"], budget - r["position"] + r["words"])) for r in line)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), packet=packet).collect()))  # however the rows are dealt
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r["target"] for r in mixing.mix(spark.createDataFrame([(1, None, "a", 1), (2, " ", "b", 1)], schema)).collect()] == [0.0, 0.0]


def test_take_by_position(spark):
    rows = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, TEXT string")
    assert take(rows, "text").first()[0] == "a"


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made, before = {}, docs
    for name, stage in P.STAGES:
        rows = stage(spark, before, sf_dir)
        before = spark.createDataFrame(rows.collect(), rows.schema)
        made[name] = before
        if name != "pack":
            assert before.columns == docs.columns
    rows = {n: [tuple(r) for r in d.select("doc_id", "text").collect()] for n, d in made.items() if n != "pack"}
    letters = {(d, t) for d, t in map(tuple, docs.select("doc_id", "text").collect()) if any(map(str.isalpha, t or ""))}
    assert set(rows["language_id"]) <= letters and len(rows["language_id"]) >= 0.98 * len(letters)
    best = {}
    for d, t in rows["language_id"]:
        key = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), d))
    assert sorted(d for d, _ in rows["exact_dedup"]) == sorted(d for _, d in best.values())
    assert sorted(d for d, _ in rows["near_dedup"]) == sorted(d for d, _, c in near(rows["exact_dedup"]) if d == c)
    times = {}
    for d, _ in rows["mix_sources"]:
        times[d] = times.get(d, 0) + 1
    assert set(times) <= {d for d, _ in rows["near_dedup"]} and max(times.values()) <= 2
    packed = made["pack"].groupBy("doc_id").sum("length").collect()
    assert {r[0] for r in packed} == set(times)


def test_pipeline_packs_with_the_operators_search(monkeypatch):
    import corpus_pipeline

    asked = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda *args, **more: asked.update(more))
    corpus_pipeline.pack(None, None, "")
    assert set(asked) <= {"kept_words", "block"}  # neither bounds what is searched


def test_pipeline_keeps_rows_with_equal_ids(spark, sf_dir):
    import corpus_pipeline as P

    long = "one two three four five six seven eight nine ten eleven"
    rows = spark.createDataFrame([(1, long, "en", "a", 1), (1, long, "en", "a", 1), (1, "other words stand here alone", "en", "b", 1), (None, long, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.exact_dedup(spark, rows, sf_dir)
    assert sorted(map(tuple, kept.select("doc_id", "text").collect())) == [(1, long), (1, "other words stand here alone")]
    assert P.near_dedup(spark, kept, sf_dir).count() == 2
    assert P.mix_sources(spark, kept, sf_dir).columns == rows.columns
