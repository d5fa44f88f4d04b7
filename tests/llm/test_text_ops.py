"""Token files, packing, WARC, media, quality and language against plain versions."""

import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from strataloom.llm import langid, licenses, media, packing, quality, queries, tokenfiles, warc
from strataloom.llm.encode import Encoder

from ..compare import same

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD = ["", None, " ", "\n", "a  b", " a", "a\n\nb", "\na", "a\n", "tab\tx", "x<|endoftext|>y", "İß ǅ", "é é", "1 2 33 ½ ²", "Σς ΑΣ", "…a “b” €5", "ſa ⁞b", "q \x01 z\x01", "don't 'll\n'quote'", "x." * 9, "日本 語", "a\x1cb", "é x", "w" * 5000]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_encoder_equals_library(name, texts):
    e = Encoder(queries.vocabulary(name))
    rng = random.Random(3)
    mixed = ["".join(rng.choice(["the ", "Of,", "\n", " ", "é.", "x1", "'s", "!!", "A", "日"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    for some in (ODD, texts, mixed, mixed):
        for text, ids in zip(some, e.batch(some)):
            assert ids.tolist() == ([] if not text else e.library.encode(text, add_special_tokens=False).ids), text


def test_token_files(spark, texts):
    path = queries.vocabulary("byte_bpe_50k.json")
    rows = [*texts[:40], *ODD]
    library = Encoder(path).library
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in rows]
    manifest = tokenfiles.write(docs_of(spark, rows), path, 2, 5)
    start = np.cumsum([0, *map(len, ids)])
    want = [(k, int(start[k]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids)]
    assert sorted(map(tuple, tokenfiles.read(manifest).collect())) == want
    assert {r[0]: r[1] for r in tokenfiles.document_ids(manifest).collect()} == dict(enumerate(ids))
    assert tokenfiles.read(tokenfiles.write(docs_of(spark, []), path, 2, 3)).count() == 0


def test_crc_between():
    raw = random.Random(1).randbytes(5000)
    for a, b in ((0, 5000), (17, 4096), (40, 41), (7, 7)):
        assert packing.crc_between(zlib.crc32(raw[:a]), zlib.crc32(raw[:b]), b - a) == zlib.crc32(raw[a:b])


def test_packing(spark, texts):
    path = queries.vocabulary("word_bpe_49k.json")
    rows = [*texts, *ODD, "word " * 20_000, *texts[:5]]
    library = Encoder(path).library
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in rows]
    got = packing.pack(docs_of(spark, rows), path, 2, shard=100).toPandas()
    for k, g in got.groupby("doc_id"):
        g, x = g.sort_values("start"), ids[k]
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() == len(x) == g["doc_tokens"].iloc[0]
        assert all(zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) == c for s, n, c in zip(g["start"], g["length"], g["ids_crc32"]))
    assert got["doc_id"].nunique() == len(rows)
    padding = 0
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
        padding += 4096 - g["length"].sum()
    assert padding / (got["sequence_id"].nunique() * 4096) < 0.05
    assert packing.pack(docs_of(spark, []), path, 2).count() == 0


def plain_bm25(terms, counts, lengths, told, query, doc):
    """BM25 of a document for the ids of another, written out."""
    score = 0.0
    for t, f in zip(terms[doc].tolist(), counts[doc].tolist()):
        if t in set(terms[query].tolist()):
            have = int(told.have[t])
            score += np.log(1 + (told.n_docs - have + 0.5) / (have + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * lengths[doc] / told.mean))
    return score


def table_of(terms, lengths):
    have = np.bincount(np.concatenate(terms), minlength=max(int(t.max()) for t in terms) + 1)
    return packing.Statistics(len(terms), float(np.mean(lengths)), have)


def test_packing_ranks_by_bm25():
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.integers(0, 400, rng.integers(1, 90)) ** 2 // 300).astype("<u2") for _ in range(120)]
    counts = [rng.integers(1, 900, len(t)).astype("<u2") for t in terms]
    lengths = np.array([int(c.sum()) for c in counts])
    told = table_of(terms, lengths)
    shard, left = packing.Shard(terms, counts, lengths, told), np.ones(120, int)
    for seed in range(0, 120, 4):
        want = np.array([plain_bm25(terms, counts, lengths, told, seed, d) for d in range(120)])
        shard.drop(left[shard.numbers] > 0)
        score = shard.rank([seed])[0]
        assert np.abs(score / packing.UNIT - want[shard.numbers]).max() < 0.05
        left[seed] = 0
        found = [*shard.near(score, left)]
        assert all(want[a] >= want[b] - 0.1 for a, b in zip(found, found[1:])) and sorted(found) == np.flatnonzero((want > 0) & (left > 0)).tolist()
        left[found[:2]] = 0  # used documents leave the index after a while
    assert shard.n < 120


def test_packing_prefers_neighbours():
    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 40, 30) + (k % 2) * 50).astype("<u2") for k in range(40)]
    lengths = np.full(40, 1000)
    shard = packing.Shard(terms, [np.ones(len(t), np.uint8) for t in terms], lengths, table_of(terms, lengths))
    kinds = [{d % 2 for d, _, _ in s} for s in packing.fill(shard, lengths)]
    assert sum(len(k) == 1 for k in kinds) >= len(kinds) - 2


def test_packing_asks_all_ids():
    # the seed's 20 heaviest ids are in no other document, and what it shares with the shortest weighs less
    terms = [np.r_[0:20, 30:50].astype("<u2"), np.r_[60:80].astype("<u2"), np.r_[30:50].astype("<u2")]
    lengths = np.array([3000, 1090, 1000])
    shard = packing.Shard(terms, [np.ones(len(t), np.uint8) for t in terms], lengths, table_of(terms, lengths))
    assert [d for d, _, _ in next(packing.fill(shard, lengths))][:2] == [0, 2]


def test_packing_sorts_by_content(spark):
    # two matters, mixed by id, with a word of their own: hardly a sequence has both
    rng = np.random.default_rng(1)
    words = [[f"{a}{b}{c}{d}" for a in head for b in "aeiou" for c in "bdgklmnt" for d in "aeiou"] for head in ("rstv", "fhjz")]
    rows = [" ".join([*rng.choice(words[k % 2], 20), *[("zebra", "lemon")[k % 2]] * 150]) for k in range(400)]
    got = packing.pack(docs_of(spark, rows), queries.vocabulary("word_bpe_49k.json"), 2, shard=50).toPandas()
    kinds = got.assign(kind=got["doc_id"] % 2).groupby("sequence_id")["kind"].nunique()
    assert (kinds == 1).mean() > 0.9


def test_packing_counts_beyond_a_byte(spark):
    rows = ["word " * 70_000, "word " * 300, "word other"]
    got = packing.encoded(docs_of(spark, rows), queries.vocabulary("word_bpe_49k.json"), 2).filter("kind = 0").orderBy("doc_id").collect()
    assert [packing.uses(r["counts"], len(r["terms"]) // 2).max() for r in got] == [70_000, 300, 1]


def test_warc(spark, sf_dir):
    same(spark, sf_dir, queries.op3_warc, queries.SQL["op3_warc"])
    page = "x" * 200
    rows = [(5, "http://User@b.Example.com:80/p?q=1#f", page), (2, "https://b.example.com/p?q=1", page), (7, None, None), (8, "http://a.com", ""), (9, "http://c.org/" + "y" * 3000, "é" * 50), (9, "http://c.org/z", "short"), (None, "http://d.org", page)]
    directory = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), block_lines=2)
    got = {(r["page_id"], r["payload_bytes"]): (r["record_type"], r["refers_to"]) for r in warc.scan(directory).collect()}
    assert got == {(5, 200): ("revisit", 2), (2, 200): ("response", None), (7, 0): ("response", None), (8, 0): ("response", None), (9, 100): ("response", None), (9, 5): ("response", None), (None, 200): ("revisit", 2)}
    found = warc.lookup(directory, ["http://b.example.com/p?q=1"]).collect()
    assert {r["page_id"] for r in found} == {2, 5}
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.lookup(directory, ["http://c.org/z", "http://nowhere.net/"]).collect()] == [(9, 5)]
    assert warc.lookup(directory, []).count() == 0 and warc.lookup(directory, [None]).count() == 1
    again = spark.createDataFrame([(1, "http://a.com/", page, 1), (1, "http://a.com/", page, 1), (3, "http://a.com/", page + "z" * 3_000_000, 2)], "page_id long, url string, html string, URL_KEY long")
    assert sorted((r["page_id"], r["record_type"], r["payload_bytes"]) for r in warc.scan(warc.write(again)).collect()) == [(1, "response", 200), (1, "response", 200), (3, "response", 3_000_200)]
    assert warc.scan(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert warc.url_key("http://www.Example.com/A?b#c") == "com,example,www)/A?b"


def test_media(spark):
    rows = ["", None, "a", "b" * 64, "b" * 65, "é" * 3000, "b" * 64]
    got = media.features(media.store(docs_of(spark, rows))).orderBy("key").collect()
    for r, text in zip(got, rows):
        body = (text or "").encode()
        full = body + bytes(-len(body) % 64 or (0 if body else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest() and r["tail_crc32"] == zlib.crc32(full[-64:])
    assert got[3]["feature"] == got[6]["feature"] and got[3]["media_sha256"] == got[6]["media_sha256"]
    raw = bytearray(media.png(bytes(128)))
    raw[45] ^= 1
    with pytest.raises(ValueError):
        media.pixels(bytes(raw))


def test_media_equals_a_plain_reader(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 9 = 0")
    stored = media.store(docs).collect()
    kinds = set()
    told = {r["key"]: r for r in media.features(media.store(docs)).collect()}
    for r in stored:
        raw, plain = zlib.decompress(r["media"][41:-16]), []
        for y in range(len(raw) // 65):  # signature 8, header 25, then length and kind of the data
            kind, line, up = raw[y * 65], raw[y * 65 + 1 : y * 65 + 65], plain[-1] if plain else [0] * 64
            kinds.add(kind)
            out = []
            for x, v in enumerate(line):
                left = out[-1] if out else 0
                out.append((v + [0, left, up[x]][kind]) & 255)
            plain.append(out)
        cells = np.array([[np.mean([p for row in _cells(plain, j) for p in _cells(row, i)]) for i in range(32)] for j in range(32)])
        low = [round(sum(cells[y, x] * np.cos(np.pi * (2 * y + 1) * v / 64) * np.cos(np.pi * (2 * x + 1) * u / 64) for y in range(32) for x in range(32)), 6) for v in range(8) for u in range(8)] if r["key"] % 27 == 0 else None
        own = told[r["key"]]
        assert own["payload_sha256"] == hashlib.sha256(bytes(sum(plain, []))).hexdigest() and own["media_bytes"] == len(r["media"]) and own["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        if low:
            bits = [0] + [int(v > np.median(low[1:])) for v in low[1:]]
            assert own["feature"] == f"{int(''.join(map(str, bits)), 2):016x}"
    assert kinds <= {0, 1, 2} and len(kinds) > 1
    assert media.features(media.store(docs.limit(0))).count() == 0


def _cells(items, k):
    """The k-th of 32 parts of a sequence; of fewer items one each, repeated."""
    n = len(items)
    return [items[k * n // 32]] if n < 32 else items[k * n // 32 : (k + 1) * n // 32]


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    picture = np.random.default_rng(kind).integers(0, 256, (6, 9), np.uint8)
    lines = np.zeros((6, 10), np.uint8)
    lines[:, 0] = kind
    for y in range(6):
        for x in range(9):
            left, up, corner = (int(picture[y, x - 1]) if x else 0), (int(picture[y - 1, x]) if y else 0), (int(picture[y - 1, x - 1]) if x and y else 0)
            guess = [0, left, up, (left + up) // 2, media.paeth(left, up, corner)][kind]
            lines[y, x + 1] = (int(picture[y, x]) - guess) & 255
    assert (media.unfilter(lines) == picture).all()


def test_licenses(spark, sf_dir):
    same(spark, sf_dir, queries.op4_license_scan, queries.SQL["op4_license_scan"])
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
    rows = ["intro\nReleased under the MIT license!\nend", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0. ok", None, "", mit, "the license is under dispute"]
    got = [r["license"] for r in licenses.scan(docs_of(spark, rows)).orderBy("doc_id").collect()]
    assert got == ["MIT", "CC-BY-NC-4.0", "Apache-2.0", None, None, None, None]
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_license_runs(spark, sf_dir):
    known = {name: text for name, text in licenses.TEMPLATES if len(text) > 150}
    wrapped = lambda text, mark: "\n".join(mark + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    rows = [
        f"# A tool.\n# Copyright 2020 A. Person\n#\n{wrapped(known['GPL-3.0'], '# ')}\n#\n# It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;\n# without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\n# GNU General Public License for more details.\nimport os",
        f"/*\n * Copyright\n *\n{wrapped(known['MIT'], ' * ')}\n *\n * THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,\n * INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR\n * PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM\n */\nint x;",
        "Released under the MIT License. See the LICENSE file.",
        "intro\nReleased under the MIT license!\nend", None, "", "the license is under dispute", "word",
    ]
    got = [(r["license"], r["score"]) for r in licenses.scan_runs(docs_of(spark, rows)).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == ["GPL-3.0", "MIT", "MIT", "MIT", None, None, None, None]
    assert [g[1] for g in got[:4]] == [1.0] * 4
    assert [r["license"] for r in licenses.scan(docs_of(spark, rows[:3])).collect()] == [None] * 3  # units alone
    units = {r[0]: r[1] for r in queries.op4_license_scan(spark, sf_dir).select("doc_id", "score").collect()}
    runs = {r[0]: r[1] for r in queries.op4_license_runs(spark, sf_dir).select("doc_id", "score").collect()}
    assert units.keys() == runs.keys() and all(runs[k] >= units[k] for k in units)


def runs_plainly(text, templates, threshold):
    """The best (license, score) over all runs of words that are no longer than a match of the template can be, and how many templates match."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text or "").lower().split()
    own = [f"{a} {b}" for a, b in zip(words, words[1:])]
    found = []
    for name, notice in templates:
        grams = set(licenses.bigrams_of(notice))
        most = len(grams) / (threshold / (2 - threshold))
        every = (set(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1) if j - i <= most)
        best = max((2 * len(run & grams) / (len(run) + len(grams)) for run in every), default=0)
        if grams and best >= threshold:
            found.append((-best, name))
    return (min(found)[1], round(-min(found)[0], 9), len(found)) if found else (None, 0.0, 0)


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_license_runs_against_all_runs(spark, threshold):
    rng = random.Random(17)
    words = "a b c d e f g h".split()
    templates = [("two", "a b c d a c"), ("one", "a b c d a c"), ("long", "h g f e d c b a h a g"), ("short", "e f g"), ("none", "word")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]
    for _ in range(60):  # a notice with some words changed, among others
        notice = rng.choice(templates)[1].split()
        for _ in range(rng.randrange(3)):
            notice[rng.randrange(len(notice))] = rng.choice(words)
        texts.append(" ".join([*rng.choices(words, k=rng.randrange(9)), *notice, *rng.choices(words, k=rng.randrange(9))]))
    texts += ["", None, "a", "A, B: c\n# D a-c", "e f g", "e f g", "x " * 20_000 + "a b c d a c " + "y z " * 20_000]
    docs = spark.createDataFrame([(k, t, "license", 1) for k, t in enumerate(texts)], "doc_id long, text string, License string, hits int").union(spark.createDataFrame([(None, "e f g", "x", 2), (3, "e f g", "x", 2), (3, "e f g", "x", 2)], "doc_id long, text string, a string, b int"))
    got = [(r["doc_id"], r["license"], round(r["score"], 9), r["n_matches"]) for r in licenses.scan_runs(docs, templates, threshold).collect()]
    kept = [t for t in texts if t is None or len(t) < 1000]
    want = [(k, *runs_plainly(t, templates, threshold)) for k, t in enumerate(texts) if t in kept]
    want += [(len(texts) - 1, "one", 1.0, 2), *((k, *runs_plainly("e f g", templates, threshold)) for k in (None, 3, 3))]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(w[1] is not None for w in want) > 30
    assert licenses.scan_runs(docs.limit(0), templates, threshold).count() == 0


def test_packing_sums_are_whole_for_long_documents():
    """Sums of thousands of rare ids are those of whole numbers, which single floats don't hold."""
    rng = np.random.default_rng(3)
    terms = [np.unique(rng.integers(0, 9000, 4000)) for _ in range(16)]
    counts = [rng.integers(1, 9, len(t)) for t in terms]
    lengths = np.array([int(c.sum()) for c in counts])
    told = packing.Statistics(10**7, float(lengths.mean()), np.full(9000, 3))
    shard = packing.Shard(terms, counts, lengths, told)
    weights = [dict(zip(t.tolist(), np.rint(told.weights(t, c, n) * packing.UNIT).astype(int).tolist())) for t, c, n in zip(terms, counts, lengths)]
    want = [[sum(w.get(x, 0) for x in asked.tolist()) for w in weights] for asked in terms]
    assert max(map(max, want)) > 1 << 24 and shard.rank([*range(16)]).tolist() == want


def test_quality(spark, sf_dir):
    rows = queries.op6_quality(spark, sf_dir.replace("0.001", "0.01")).collect()
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet").select("doc_id", "quality").collect()}
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    good, bad = ([s for s, q, _ in held if q == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([p == q for _, q, p in held]) > 0.9
    model = quality.fit([], [], 0, 0)
    assert model.score(model.margin("x")) == 0.5 and model.margin(None) == 0.0


def test_dictionary_of_all_blocks(monkeypatch):
    given, train = [], quality.zstandard.train_dictionary
    monkeypatch.setattr(quality.zstandard, "train_dictionary", lambda size, blocks: given.extend(blocks) or train(size, blocks))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(2000)) for _ in range(400)]
    assert quality.dictionary(texts)
    assert sum(map(len, given)) == sum(map(len, texts)) and len(given) > 6000


def test_language(spark, sf_dir):
    rows = queries.op8_language(spark, sf_dir.replace("0.001", "0.01")).collect()
    langs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.97
    counts = {"en": {"the": 40, "cat": 20, "and": 20, "hat": 20}, "fr": {"le": 20, "chat": 20, "et": 20, "la": 20, "souris": 20}}
    model = langid.fit(counts, langid.pieces_of(queries.vocabulary("piece_bpe_32k.model")))
    got = langid.predictions(docs_of(spark, [None, "", "12 !?", "the hat", "la souris", "z" * 3000]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][:5] == ["und", "und", "und", "en", "fr"] and got[5]["lang_pred"] in ("en", "fr")
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_equals_a_plain_scorer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.learn(docs.filter(queries.remainder(5) != 0), queries.vocabulary("piece_bpe_32k.model"))
    known = {p: model.table[k].astype(np.float32).astype(float) for k, p in enumerate(model.pieces)}

    @functools.lru_cache(None)
    def word(w):  # all segmentations, by the definition, with logarithms kept in range
        w = langid.START + w
        sums, log = [np.ones(len(model.names))], np.zeros(len(model.names))
        for end in range(1, len(w) + 1):
            total = sum((sums[s] * known[w[s:end]] for s in range(max(0, end - model.lattice.longest), end) if w[s:end] in known), np.zeros(len(model.names)))
            sums.append(total + (sums[end - 1] * langid.FLOOR if w[end - 1] not in known else 0))
            log, sums = log + np.log(sums[-1]), [s / sums[-1] for s in sums]
        return log

    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    for r in queries.op8_language(spark, sf_dir).collect()[::4]:
        text = texts[r["doc_id"]]
        if not any(map(str.isalpha, text or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = sum(map(word, text.lower().split()))
        best = int(np.argmax(total))
        assert r["lang_pred"] == model.names[best] and r["score"] == pytest.approx(1 / np.exp(total - total[best]).sum(), rel=1e-6)


def test_language_cases(spark):
    rows = [(None, "the cat and the hat", "en", 1.0), (None, "le chat et la souris", "fr", 1.0), (7, "the cat", "en", 1.0), (7, "the cat", "en", 1.0), (7, "zz", None, 1.0), (8, "a" * 200_000, "fr", 1.0), (9, None, "fr", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score double")
    model = langid.learn(docs, queries.vocabulary("piece_bpe_32k.model"))
    assert model.names == ["en", "fr"]
    got = langid.predictions(docs, model, "found", "posterior")
    assert got.columns == [*docs.columns, "found", "posterior"] and got.count() == 7
    assert [r["found"] for r in got.collect()][:4] == ["en", "fr", "en", "en"]
    assert langid.predictions(docs.limit(0), langid.learn(docs.limit(0), queries.vocabulary("piece_bpe_32k.model"))).count() == 0
    assert langid.fitted_words("ab " + "x" * 130) == ["ab", "x" * 64, "x" * 64, "xx"]
    tie = langid.Model(["a", "b"], ["▁"], np.full((2, 2), 0.5))
    assert langid.Scorer(tie).scores(["word"])[0] == ("a", 0.5)


def test_quality_equals_a_plain_scorer(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs.filter(queries.remainder(4) != 2), labels)
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}

    def size(body, dictionary):
        packer = quality.zstandard.ZstdCompressor(level=3, dict_data=quality.zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(packer.compress(body[k : k + 512])) for k in range(0, len(body), 512))

    for r in queries.op6_quality(spark, sf_dir).collect()[::3]:
        body = (texts[r["doc_id"]] or "").encode()
        good, bad = size(body, model.good), size(body, model.bad)
        margin = (bad - good) / max(good, bad) if body else 0.0
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), rel=1e-9)
        assert r["predicted"] == (r["score"] >= 0.7)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(1, "x", 0.0), (1, "x", 0.0), (None, None, 0.0), (2, "", 0.0), (3, "long " * 200_000, 0.0)], "doc_id long, text string, QUALITY double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.scores(docs, quality.learn(docs, labels)).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1 and 0.5 < got[0]["score"] < 1  # one label alone: its share
    assert quality.scores(docs.limit(0), quality.learn(docs.limit(0), labels.limit(0))).count() == 0


def test_words_of_any_length_are_scored_whole():
    """The pass over blocks equals the one over the whole word, and a sum over a word of 100,000 characters the plain one."""
    rng = random.Random(4)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "abba", "bbbbb"]
    table = np.vstack([np.random.default_rng(1).random((len(pieces), 3)) / 4, np.zeros((1, 3))])
    model = langid.Model(["x", "y", "z"], pieces, table)
    word = lambda n: "".join(rng.choice("aabbc") for _ in range(n))
    words = [word(n) for n in (1, 5, 64, 65, 700, 1024)]
    whole = model.likelihoods(words)
    assert np.array([langid.long_forward(model.lattice, "▁" + w, table, 7) for w in words]) == pytest.approx(whole, rel=1e-9)
    long = word(100_000)
    sums, log, behind = [np.ones(3)], np.zeros(3), "▁" + long  # of the last positions
    for end in range(1, len(behind) + 1):
        text = behind[max(0, end - 9) : end]
        now = sum((sums[-size] * table[pieces.index(text[-size:])] for size in range(1, 6) if size <= len(sums) and text[-size:] in pieces), np.zeros(3))
        if text[-1] not in pieces:
            now = now + sums[-1] * langid.FLOOR
        log, sums = log + np.log(now), [s / now for s in [*sums[-5:], now]]
    assert model.likelihoods([long])[0] == pytest.approx(log, rel=1e-9)
    scorer = langid.Scorer(model)
    assert scorer.scores([long, "ab " + long, "ab"])[0] == langid.Scorer(model).scores([long])[0] and set(scorer.known) == {"ab"}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab"]
    p = np.array([0.2, 0.1, 0.15, 0.25, 0.05, 0.1, 0.15])
    model = langid.Model(["x"], pieces, np.append(p, 0.0)[:, None])

    def total(rest):
        if not rest:
            return 1.0
        known = [k for k in range(1, len(rest) + 1) if rest[:k] in pieces]
        return sum(p[pieces.index(rest[:k])] * total(rest[k:]) for k in known) + (0 if rest[0] in pieces else langid.FLOOR * total(rest[1:]))

    words = ["ab", "abab", "ba", "acb", "aabba"]
    assert np.exp(model.likelihoods(words)[:, 0]) == pytest.approx([total("▁" + w) for w in words], rel=1e-9)
    uses = langid.expected(model.lattice, ["ab"], np.array([1.0]), p)
    ways = collections.Counter({("▁", "a", "b"): 0.2 * 0.1 * 0.15, ("▁", "ab"): 0.2 * 0.25, ("▁a", "b"): 0.05 * 0.15, ("▁ab",): 0.15})
    want = [sum(v * w.count(x) for w, v in ways.items()) / sum(ways.values()) for x in pieces]
    assert uses == pytest.approx(want)
