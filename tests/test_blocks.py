"""Blocks of postings, against plain Python."""

from pyspark.sql import functions as F

from strataloom.operators import postings as P
from strataloom.operators import retrieval  # noqa: F401
from strataloom.index import Index  # after the operators, which it reads and which read it


def test_postings_lie_in_blocks_and_are_not_shuffled(spark, tmp_path):
    rows = [(k, "b a b" if k % 3 else None, ("w%d É-x " % (k % 7)) * (k % 5)) for k in range(700)] + [(5000, "", "!!")]
    frame = spark.createDataFrame(rows, "memory_id long, title string, body string").repartition(2)
    plan = P.postings(P.blocked(frame, "memory_id", ("title", "body")), 1, 4)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning" not in plan
    index = Index(spark, str(tmp_path / "i"), "memory_id", "bigint", ("title", "body"), buckets=4)
    index.add(frame)
    want = []
    for key, *texts in rows:
        words = [(t or "").replace("!", "").replace("-", " ").replace("É", "e").split() for t in texts]
        want += [(w, key, f, sum(map(len, words)), [p for p, x in enumerate(own) if x == w]) for f, own in enumerate(words) for w in set(own)]
    found = index.live_postings().select("term", "memory_id", "field", "length", "positions").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert index.table("postings").count() < len(want) / 10  # a row for each block
    assert index.manifest().notes["totals"] == [len(rows), sum({r[1]: r[3] for r in map(tuple, found)}.values())]
    for _ in range(2):
        index.add(frame.filter("memory_id < 3").withColumn("title", F.lit("c")))
    assert index.merge(2) and index.live().count() == len(rows)
    assert {r[0] for r in index.live_postings().filter("term = 'c'").select("memory_id").collect()} == {0, 1, 2}
