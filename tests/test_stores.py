import pytest

from strataloom.operators import ledger as L
from strataloom.sources import snapshot
from strataloom.sources.corpus import Corpus
from strataloom.streaming import sessions


def test_snapshot_round_trip(spark, sf_dir, tmp_path):
    c = Corpus(spark, sf_dir)
    tables = {"feedback": c.feedback, "links": c.links, "tags": c.tags}
    snapshot.export(tables, str(tmp_path / "s"))
    back = snapshot.load(spark, str(tmp_path / "s"))
    for name, df in tables.items():
        assert sorted(map(tuple, back[name].collect())) == sorted(map(tuple, df.collect()))
    part = next(p for p in sorted((tmp_path / "s/rows").glob("part-*")) if "helpful" in p.read_text())
    text = part.read_text()
    part.write_text(text.replace("helpful", "harmful", 1))
    assert part.read_text() != text
    for crc in (tmp_path / "s/rows").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        snapshot.load(spark, str(tmp_path / "s"))


def test_snapshot_digest_sees_swapped_rows(spark):
    one = spark.createDataFrame([("t", "a"), ("t", "b")], "table string, row string")
    two = spark.createDataFrame([("t", "a"), ("t", "c")], "table string, row string")
    told = lambda df: snapshot.footer(df).collect()
    assert told(one) == told(one.repartition(2)) != told(two) and len(told(one)[0]["digest"].split("-")) == 4


def test_stream_equals_table(spark, sf_dir, tmp_path):
    log = Corpus(spark, sf_dir).log.select("session_id", "seq", "kind", L.succeeded(__import__("pyspark").sql.functions.col("attributes")).alias("succeeded"))
    rows = log.orderBy("seq").collect()
    for k in range(0, len(rows), 400):  # files in order of time
        spark.createDataFrame(rows[k : k + 400], log.schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{k:05d}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    done = sessions.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination(120)
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, sessions.fold_table(log).collect()))


def test_session_limit(spark):
    rows = spark.createDataFrame([(1, k, "tool_result") for k in range(10)], "session_id long, seq long, kind string")
    from pyspark.sql import functions as F

    assert L.session_slice(rows, F.col("kind") == "checkpoint", F.lit(False), limit=4).count() == 4


def test_attempts_fold_in_any_order():
    import random

    from strataloom.streaming.attempts import _carry, folded

    rng = random.Random(7)
    rows = [(seq, f"r{seq}", rng.random() < 0.5, rng.choice([None, "verification", "failed_execution", "explicit_salience"])) for seq in range(12)]
    want = None
    for r in rows:
        want = folded(want, *r)
    failed = [r for r in rows if not r[2]]
    assert want[:5] == (rows[-1][1], rows[-1][2], failed[0][1], 11, 12)
    for _ in range(20):
        rng.shuffle(rows)
        got = None
        for r in rows:
            got = folded(got, *r)
        assert got == want

    class State:  # as Spark hands it over
        exists, hasTimedOut, get, left = True, False, want, None

        def update(self, value):
            self.get = value

        def setTimeoutDuration(self, ms):
            self.left = ms

        def remove(self):
            self.exists = False

    import pandas as pd

    state, run = State(), _carry(5000)
    out = [*run(("s", "k"), iter([pd.DataFrame([(20, "fine", True, None)], columns=["seq", "result", "succeeded", "reason"])]), state)]
    assert out[0].iloc[0].tolist()[:4] == ["s", "k", "fine", True] and state.get[4] == 13 and state.left == 5000
    state.hasTimedOut = True
    assert [*run(("s", "k"), iter([]), state)] == [] and not state.exists


def test_session_slice_is_a_two_level_limit(spark):
    """A session's newest events are taken in each task before the shuffle, so a session of any length sends the limit times the tasks."""
    from pyspark.sql import functions as F

    rows = spark.range(10000).select((F.col("id") % 2).alias("session_id"), F.expr("id div 2").alias("seq"), F.lit("tool_result").alias("kind")).repartition(5)
    found = L.session_slice(rows, F.col("kind") == "checkpoint", F.lit(False))
    assert sorted(r["seq"] for r in found.collect() if r["session_id"]) == [*range(5000 - 128, 5000)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2, plan
