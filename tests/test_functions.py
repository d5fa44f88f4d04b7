import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import text as X
from strataloom.functions import vectors as V
from strataloom.functions.aliases import code_aliases, term
from strataloom.operators import selection
from strataloom.operators.retrieval import identifier_terms, terms_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_terms():
    assert terms_of("The and AND not a fn_name the x1", 24) == ["the", "fn_name", "x1"]
    assert terms_of("x" * 130, 24) == ["x" * 64, "xx"]  # cut at 64 bytes; an equal piece is no new term
    assert identifier_terms("fix src/a.rs in MemStore::get, now (Again)") == ["again", "memstore::get", "src/a.rs"]


def test_aliases():
    assert {"memory", "engine", "memoryengine"} <= set(code_aliases("MemoryEngine", "", ()).split())
    assert {"oom", "memoryexhaustion"} <= set(code_aliases("", "ran out of the memory here", ()).split())
    assert "oom" not in code_aliases("", "ran out. Of memory", ())
    assert term("123456") is None and term("12345") == "12345" and term("é1") is None and term("a" * 65) is None


def test_redaction(spark):
    text, n = X.redact_plain('password = "hunter2hunter2" and sk-abcdefghijklmnopqrst')
    assert n == 2 and "hunter2" not in text and "[REDACTED:openai_key]" in text
    got = one(spark, X.redacted(F.lit('password = "hunter2hunter2" and sk-abcdefghijklmnopqrst')))
    assert (got["text"], got["count"]) == (text, 2)
    value, n = X.redact_value({"auth-token": [1, None, "x"], "k": {"a": "Bearer abcdefghijklmnopqrst"}})
    assert n == 4 and value["auth-token"] == ["[REDACTED:sensitive_number]", "[REDACTED:sensitive_null]", "[REDACTED:sensitive_string]"]


@pytest.mark.parametrize("path, want", [(" a\\b//./c ", "a/b/c"), ("/a", None), ("../a", None), ("C:/a", None), ("./", None), ("a/C:/b", "a/C:/b")])
def test_paths(spark, path, want):
    assert one(spark, X.normal_path(F.lit(path))) == want


@pytest.mark.parametrize(
    "remote, want",
    [("https://u:p@Host.com/a/b.git/?q#f", "host.com/a/b"), ("git@Host.com:a/b.git", "host.com/a/b"), ("file:///srv/r.git", "file:///srv/r"), ("C:\\r", "C:/r"), (" ", None)],
)
def test_remotes(spark, remote, want):
    assert one(spark, X.normal_remote(F.lit(remote))) == want


def test_small_functions(spark):
    assert one(spark, X.is_verification(F.lit("cd a && Pytest -q"))) and not one(spark, X.is_verification(F.lit("echo pytest")))
    assert [one(spark, X.tool_kind(F.lit(n))) for n in ("mcp__Shell", "MultiEdit", "search")] == ["command_result", "file_change", "tool_result"]
    assert [one(spark, X.language_of(F.lit(p))) for p in ("a/b.RS", "x.tar.py", "Makefile", ".py")] == ["rust", "python", None, None]
    assert one(spark, X.token_estimate(F.lit(""))) == 1 and one(spark, X.token_estimate(F.lit("abcd"))) == 2
    assert X.cut_to_tokens("One two. Three four five", 4) == "One two.…" and X.cut_to_tokens("abc", 1) == "abc"


def test_vectors(spark):
    a, b = [1.0, 2.0, -2.0], [2.0, 0.0, 1.0]
    f = lambda v: F.array(*(F.lit(x).cast("float") for x in v))
    assert one(spark, V.cosine(f(a), f(b))) == pytest.approx(0.0) and one(spark, V.norm(f(a))) == 3.0
    assert not one(spark, V.is_valid(f([0.0, 0.0]))) and one(spark, V.is_valid(f(a)))
    rng = np.random.default_rng(1)
    x = rng.normal(size=64)
    rows = spark.createDataFrame([(x.tolist(),), ((x + rng.normal(size=64) * 0.1).tolist(),), ((-x).tolist(),)], "v array<float>").coalesce(1)
    s = rows.select(V.signature("v").alias("s")).collect()
    gap = lambda p, q: sum(bin((p[c] ^ q[c]) & (2**64 - 1)).count("1") for c in ("low", "high"))
    assert gap(s[0][0], s[1][0]) < 20 < 100 < gap(s[0][0], s[2][0])


def quadratic(rows, limit, mix=0.78):
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    top, sets, out = max(rows[0][1], 2.220446049250313e-16), {r[0]: selection.token_set(r[2]) for r in rows}, []
    while len(out) < min(limit, len(rows)):
        left = [r for r in rows if r[0] not in out]
        value = lambda r: mix * (r[1] / top) - (1 - mix) * max((selection.similarity(sets[r[0]], sets[p]) for p in out), default=0.0)
        out.append(min(left, key=lambda r: (-value(r), r[0]))[0])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("limit", [0, 1, 12, 60])
def test_diverse_equals_quadratic(seed, limit):
    r = random.Random(seed)
    rows = [(k, r.randrange(1, 6) / 5, " ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(8))) for k in range(50)]
    assert selection.diverse(rows, limit) == quadratic(rows, limit)


def test_packing():
    hit = lambda k, n, **x: {"memory_id": k, "revision": 1, "title": f"t{k}", "body": "word " * n, "kind": "fact", "state": "active", "applicability": "exact"} | x
    for budget in (64, 100, 150, 400, 1000):
        out, text, total = selection.packed([hit(1, 200), hit(2, 3, kind="decision"), hit(3, 5, state="contested")], budget)
        assert total <= budget and all(i["body"] in "word " * 200 or i["body"].endswith("…") for i in out)
    assert text.index("[decisions]") < text.index("[relevant_history]") < text.index("[warnings]")
    assert selection.packed([], 100) == ([], "", 0)
    assert "&lt;b&gt;\n  x" in selection.packed([hit(1, 1, body="<b>\nx")], 500)[1]


def test_signature_distance_of_whole_vectors(spark, tmp_path):
    from strataloom.plans.catalog import QUERIES

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(40, 70))
    vectors[1] = vectors[0]
    vectors[1, 62:] *= -30  # what differs is after coordinate 62
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r[0]: r[1] for r in QUERIES["signature_distance"](spark, str(tmp_path)).collect()}
    signs = vectors.astype(np.float32).astype(np.float64) @ V.hyperplanes(70).T < 0
    assert got == {k: int((signs[k] != signs[0]).sum()) for k in range(40)} and got[1] > 0


def test_framed_keys_of_whole_pages(spark, tmp_path):
    from strataloom.plans.catalog import QUERIES

    spark.createDataFrame([(k, "u", "x" * 100 + t) for k, t in enumerate("aab")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    a, b, c = (r[1] for r in QUERIES["framed_keys"](spark, str(tmp_path)).orderBy("page_id").collect())
    assert a == b != c


def test_a_repeated_word_is_cut_once():
    """A worker cuts each word once, however often its texts have it; the aliases stay as they were."""
    from strataloom.functions import aliases

    aliases._unit.cache_clear()
    texts = ["fooBar baz_qux stack overflow in fooBar", "fooBar; stack\noverflow", "Stack very overflow"]
    found = [code_aliases("", (t + "\n") * 50, ()) for t in texts]
    assert found == ["callstack recursionlimit stackoverflow bar baz bazqux foo foobar qux", "bar foo foobar", "callstack recursionlimit stackoverflow"]
    assert aliases._unit.cache_info().misses <= 10


def test_envelopes_of_blank_and_null_bodies(spark, tmp_path):
    """A blank body stands in the envelope and a null one gives null, as in the SQL; a recall that rendered nothing has no envelope."""
    from strataloom.plans.catalog import QUERIES, SQL
    from tests.compare import same

    texts = [None, "", " ", "\n", " \t\r\n", "\x0b", "\xa0", "\u3000", "a", "\na\n"]
    rows = [(k, t, "en", "src0") for k, t in enumerate(t for t in texts for _ in range(5))]  # one of each text's numbers is divisible by 5
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path), QUERIES["context_envelope"], SQL["context_envelope"])
    got = {r[0]: r[1] for r in QUERIES["context_envelope"](spark, str(tmp_path)).collect()}
    assert got[0] == got[5] == "" and got[1] is None and got[6] == "".join(X.ENVELOPE) and got[11] == " ".join(X.ENVELOPE)
    assert one(spark, X.enveloped(F.lit(" \n"))) == one(spark, X.enveloped(F.lit(None).cast("string"))) == ""
