"""Trees over ordered rows: what differs is found, and only the paths to it are opened."""

import json

import pytest
from pyspark.sql import functions as F

from strataloom.sources import merkle as M
from strataloom.sources import snapshot

N = 20_000


def tree(df, keys=("id",)):
    return M.tree(M.ordered(df, list(keys)))


def found(mine, theirs):
    return sorted((json.loads(r["key"])["id"], r["change"], r["mine"], r["theirs"]) for r in M.changes(mine, theirs).collect())


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(N).select("id", F.sha2(F.col("id").cast("string"), 256).alias("Text"), F.lit(None).cast("int").alias("text_"))


@pytest.fixture(scope="module")
def mine(base):
    return tree(base)


def test_levels_and_partitionings(base, mine):
    sizes = [level.count() for level in mine]
    assert sizes[0] == N and N / 512 < sizes[1] < N / 128 and sizes[-1] == 1
    assert M.root(mine) == M.root(tree(base.repartition(7))) is not None
    assert mine[0].groupBy("up").count().agg(F.max("count")).first()[0] <= M.LEAF[1]
    assert sorted(r["n"] for r in mine[1].collect()) == [*range(sizes[1])]


def test_changed_removed_and_added_rows(spark, base, mine):
    text = F.when(F.col("id") == 777, F.lit("other")).otherwise(F.col("Text")).alias("Text")
    other = base.filter("id <> 5000").select("id", text, "text_").union(spark.createDataFrame([(N + 3, "new", None)], "id long, Text string, text_ int"))
    theirs = tree(other)
    assert M.root(theirs) != M.root(mine)
    assert found(mine, theirs) == [(777, "changed", 777, 777), (778, "moved", 778, 778), (5000, "removed", 5000, None), (5001, "moved", 5001, 5000), (N + 3, "added", None, N - 1)]
    opened = M.differing(mine, theirs)
    assert all(side.count() < N / 5 for side in opened)  # three leaves and the ones behind them
    assert found(mine, mine) == [] and all(side.isEmpty() for side in M.differing(mine, mine))


def test_moved_and_swapped_rows_by_their_order(spark, base, mine):
    """The same rows in another order: 100 is behind 15,000 now, and 300 and 301 have changed places."""
    own = F.get_json_object("key", "$.id").cast("long")
    place = F.when(own == 100, 15000.5).when(own == 300, 301.0).when(own == 301, 300.0).otherwise(own.cast("double"))
    rows = M.ordered(base, ["id"]).select("key", "row", place.alias("place"))
    numbered = M.numbered(rows, ["place"]).select("n", "key", "row", F.sha2("row", 256).alias("digest"))
    theirs = M.tree(M.preceded(numbered, F.col("n")))
    assert M.root(theirs) != M.root(mine)
    assert [r[:2] for r in found(mine, theirs)] == [(k, "moved") for k in (100, 101, 300, 301, 302, 15001)]


def test_repeated_rows_and_empty_tables(spark):
    same = lambda n: spark.range(n).select(F.lit(1).alias("id"))
    many, more = tree(same(30_000)), tree(same(30_002))
    assert [r[1] for r in found(many, more)] == ["added", "added"] and [r[1] for r in found(more, many)] == ["removed", "removed"]
    none = tree(same(0))
    assert M.root(none) is None and found(none, none) == [] and len(found(none, tree(same(3)))) == 3
    nulls = tree(spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "id long, x string"))
    assert found(nulls, nulls) == [] and nulls[0].count() == 3


def test_snapshots_in_order(spark, base, tmp_path):
    small = base.limit(300)
    snapshot.export({"t": small, "u": small}, str(tmp_path / "a"), order={"t": ["id"]})
    assert sorted(map(tuple, snapshot.load(spark, str(tmp_path / "a"))["t"].collect())) == sorted(map(tuple, small.collect()))
    snapshot.export({"t": small.filter("id <> 7")}, str(tmp_path / "b"), order={"t": ["id"]})
    told = snapshot.changes(spark, str(tmp_path / "a"), str(tmp_path / "b"), "t", ["id"]).collect()
    assert sorted((r["key"], r["change"]) for r in told) == [('{"id":7}', "removed"), ('{"id":8}', "moved")]
    edited = 0
    for part in (tmp_path / "a/rows").glob("part-*"):
        text = part.read_text()
        swapped = text.replace('"n":3}', '"n":x}').replace('"n":4}', '"n":3}').replace('"n":x}', '"n":4}')
        edited += text != swapped
        part.write_text(swapped)
    for crc in (tmp_path / "a/rows").glob(".*.crc"):
        crc.unlink()
    assert edited
    with pytest.raises(ValueError, match="order"):
        snapshot.load(spark, str(tmp_path / "a"))
