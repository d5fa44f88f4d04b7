"""Terms grouped where their texts are, against plain Python."""

from strataloom.operators import retrieval  # noqa: F401
from strataloom.operators import postings as P


def test_terms_are_grouped_without_a_shuffle(spark):
    rows = [(k, "b a b" if k % 3 else None, ("w%d x " % (k % 7)) * (k % 5)) for k in range(1200)] + [(5000, "", "!!")]
    frame = spark.createDataFrame(rows, "id long, title string, body string").repartition(2)
    found = P.gathered(frame, "id", ("title", "body"))
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "hashpartitioning" not in found._jdf.queryExecution().toString()
    want = []
    for key, *texts in rows:
        words = [(t or "").replace("!", "").split() for t in texts]
        length = sum(map(len, words))
        want.append((key, length, None, None, None))
        want += [(key, length, w, f, [p for p, x in enumerate(own) if x == w]) for f, own in enumerate(words) for w in set(own)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_large_builds_have_more_files():
    assert P.spread_for(10, 32) == P.SPREAD and P.spread_for(600_000_000, 32) == 10
