"""Relations of commits against the closure of their graph in plain Python."""

import random

import pytest

from strataloom.operators import history as H


def closure(edges):
    """Ancestors of each commit, itself included."""
    parents = {}
    for c, p in edges:
        parents.setdefault(c, set()).update({p} - {None})
        if p is not None:
            parents.setdefault(p, set())
    found = {}
    for c in parents:
        seen, todo = {c}, [c]
        while todo:
            for p in parents[todo.pop()] - seen:
                seen.add(p)
                todo.append(p)
        found[c] = seen
    return found


def told(stored, current, below):
    if stored is None or current is None:
        return stored, current, "unknown", 0, 0
    s, c = below.get(stored, set()), below.get(current, set())
    behind, ahead = len(s - c), len(c - s)
    kind = "same" if stored == current else "unknown" if not s & c else "ancestor" if not behind else "descendant" if not ahead else "diverged"
    return stored, current, kind, ahead, behind


@pytest.mark.parametrize("seed", range(3))
def test_relations_of_random_histories(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = [(k, rng.randrange(max(0, k - (3, 12, 60)[seed]), k)) for k in range(1, n) for _ in range(rng.choice((0, 1, 1, 2, 3)))]
    rng.shuffle(edges)
    edges += edges[:3] + [(n + 5, None)]  # repeated rows, and a commit with no parent at all
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(150)] + [(3, 3), (n + 5, 3), (999, 4), (4, 999), (999, 999), (None, 4), (4, None), (4, 5), (4, 5)]
    numbers = list(range(n + 10))
    rng.shuffle(numbers)  # ids that say nothing about the order
    name = lambda k: numbers[k] if k is not None and k < len(numbers) else k
    edges, pairs = [(name(a), name(b)) for a, b in edges], [(name(a), name(b)) for a, b in pairs]
    frame = spark.createDataFrame([(a, b, "x") for a, b in edges], "commit_id long, parent_id long, Commit_Time string")
    got = H.relation(spark.createDataFrame(pairs, "stored long, current long"), frame).collect()
    below = closure(edges)
    assert sorted(map(str, map(tuple, got))) == sorted(str(told(*p, below)) for p in set(pairs))


def test_a_line_of_100000_commits_has_a_row_each(spark):
    n = 100_000
    line = spark.range(1, n).selectExpr("id as commit_id", "id - 1 as parent_id")
    places = H.placed(line)
    assert places.count() == n and places.select("chain").distinct().count() == 1 and H.steps(line, places).isEmpty()
    asked = [10, 50_000, n - 1]
    assert sorted((r["asked"], r["count"]) for r in H.reached(spark.createDataFrame([(a,) for a in asked], "commit_id long"), line).collect()) == [(a, a + 1) for a in asked]


def test_merged_branches_take_a_row_for_each_chain(spark):
    """A main line of 3,000 commits that takes in a branch of two commits at every tenth: an asked commit has one row for each branch below it."""
    edges = [(k, k - 1) for k in range(1, 3000)] + [e for k in range(20, 3000, 10) for e in ((10_000 + k, k - 15), (20_000 + k, 10_000 + k), (k, 20_000 + k))]
    below = closure(edges)
    frame = spark.createDataFrame(edges, "commit_id long, parent_id long")
    pairs = [(2999, 1500), (1500, 2999), (11_500, 2999), (2999, 21_500), (12_000, 11_500)]
    got = H.relation(spark.createDataFrame(pairs, "stored long, current long"), frame).collect()
    assert sorted(map(tuple, got)) == sorted(told(*p, below) for p in pairs)
    assert H.reached(spark.createDataFrame([(2999,)], "commit_id long"), frame).count() == 1 + 298


def test_empty_histories_and_cycles(spark):
    empty = spark.createDataFrame([], "commit_id long, parent_id long")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "stored long, current long")
    assert sorted(map(tuple, H.relation(pairs, empty).collect())) == [(1, 1, "same", 0, 0), (1, 2, "unknown", 0, 0)]
    assert H.relation(pairs.limit(0), empty).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        H.relation(pairs, spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "commit_id long, parent_id long"))


def test_a_line_that_leaves_its_lowest_child_at_every_ninth_commit(spark):
    """Ways to the root change chains a few times, where ones of lowest children would do so at every ninth commit, and every commit's relation is right."""
    n = 250
    edges = [(k, k - 3 if k % 9 == 8 else k - 1) for k in range(1, n)] + [e for k in range(1, n) for e in ((k, k - 1),) * (k % 27 == 26) + ((k, k - 11),) * (k % 27 == 17)]
    frame = spark.createDataFrame(edges, "commit_id long, parent_id long")
    assert H.ways(H.laid(frame)).groupBy("chain").count().agg({"count": "max"}).first()[0] <= 3
    below, pairs = closure(edges), [(k, k * 7 % 64) for k in range(n)]
    got = H.relation(spark.createDataFrame(pairs, "stored long, current long"), frame).collect()
    assert sorted(map(tuple, got)) == sorted(told(*p, below) for p in pairs)
