"""Replayed tables of several files a batch, and folds of a task's rows."""

import random

from strataloom.streaming import attempts as A


def test_folds_of_parts_are_the_fold_of_all():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(seq, rng.choice("xyz"), rng.random() < 0.5, rng.choice(["verification", "explicit_salience", "failed_execution", None])) for seq in range(rng.randrange(1, 12))]
        rng.shuffle(rows)
        whole, parts = None, [None, None, None]
        for row in rows:
            whole, k = A.folded(whole, *row), rng.randrange(3)
            parts[k] = A.folded(parts[k], *row)
        got = None
        for part in filter(None, parts):
            got = A.merged(got, part)
        assert got == whole


def test_a_large_part_has_several_files_and_is_one_batch(spark, tmp_path):
    table = spark.range(4000).selectExpr("id as seq", "'s' as scope", "concat('k', id % 3) as key", "'r' as result", "id % 2 = 0 as succeeded", "'verification' as reason")
    path = f"file://{tmp_path}"
    changes = A.written(A.carried(A.replayed(table, path, "seq", rows=400)), path, "update")
    assert len(spark.read.parquet(f"{path}/in/f0000").inputFiles()) == 3
    assert sorted({r["batch"] for r in changes.select("batch").collect()}) == [0, 1, 2, 3]
    want = [("s", f"k{k}", max(range(k, 4000, 3)), len(range(k, 4000, 3))) for k in range(3)]
    assert sorted((r["scope"], r["key"], r["last_order"], r["runs"]) for r in A.latest(changes).collect()) == want
    assert A.replayed(table.limit(2), f"{path}/few", "seq", rows=1).isStreaming


def test_a_task_sends_a_key_once_for_each_batch_of_rows():
    import pandas as pd

    rows = pd.DataFrame({"scope": "s", "key": ["a", "b"] * 500, "seq": range(1000), "result": "r", "succeeded": [False, True] * 500, "reason": "verification"})
    (found,) = A._parts(iter([rows]))
    assert found[["key", "runs", "last_order", "first_order", "failed"]].values.tolist() == [["a", 500, 998, 0, True], ["b", 500, 999, 0, False]]


def test_a_key_takes_attempts_and_folds_of_them_alike():
    import pandas as pd

    class State:  # as Spark hands it over
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

    rows = pd.DataFrame({"scope": "s", "key": "a", "seq": range(12), "result": [f"r{k}" for k in range(12)], "succeeded": [True, False, True] * 4, "reason": ["verification", None, "failed_execution"] * 4})
    bare, mixed = State(), State()
    (out,) = A._carry(None)(("s", "a"), iter([rows]), bare)
    (same,) = A._carry(None)(("s", "a"), iter([*A._parts(iter([rows[6:]])), rows[:3], *A._parts(iter([rows[3:6]]))]), mixed)
    assert bare.get == mixed.get == ("r11", True, "r1", 11, 12, "verification", 1, 9)
    assert out.values.tolist() == same.values.tolist() == [["s", "a", "r11", True, "r1", 11, 12, "verification"]]
