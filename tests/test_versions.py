"""Versions, the kept index, its upkeep as a stream, and the store on both, against plain versions and scans."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.index import Index
from strataloom.operators import retrieval as R
from strataloom.operators.retrieval import Request
from strataloom.sources.versions import Conflict, Versions
from strataloom.store import Store
from strataloom.streaming.maintain import Maintainer

SCOPE = {"namespace": "n", "workspace_id": "w", "repo_id": "r", "branch": "main"}
ASK = {"namespace": "n", "workspace_id": "w", "repo_id": "r", "branch": "main", "as_of_ms": 1 << 45}
FIELDS = ("title", "body")
WEIGHTS = {"title": 4.0, "body": 1.0}


def frame(spark, rows):
    return spark.createDataFrame(rows, "memory_id long, title string, body string")


def scores(df):
    return sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())


def scanned(rows, terms, weights=WEIGHTS):
    return scores(R.bm25(rows, terms, weights, FIELDS))


def test_versions(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    schema = T.StructType.fromDDL("x long")
    rows = lambda m: sorted(r[0] for r in v.read(m, "t", schema).collect())
    none = v.manifest()
    one = v.commit(none, {"t": [v.write("t", spark.range(3).toDF("x"))]})
    two = v.commit(one, {"t": [v.write("t", spark.range(3, 5).toDF("x"))]}, notes={"n": 1})
    assert (rows(none), rows(one), rows(v.manifest())) == ([], [0, 1, 2], [0, 1, 2, 3, 4]) and v.manifest().notes == {"n": 1}
    with pytest.raises(Conflict):
        v.commit(one, {"t": [v.write("t", spark.range(9).toDF("x"))]})  # someone else was first
    assert rows(v.manifest()) == [0, 1, 2, 3, 4] and v.numbers() == [1, 2]
    three = v.compact(two, "t", schema, tier=2)
    assert len(three.entries("t")) == 1 and rows(three) == rows(two) == [0, 1, 2, 3, 4]
    assert v.compact(three, "t", schema, tier=2) == three
    assert v.vacuum() == 3 and rows(v.manifest()) == [0, 1, 2, 3, 4]  # two that were merged, one of the refused commit


def test_index_equals_scan(spark, tmp_path):
    base = [(k, f"note {k % 7}", f"alpha beta group_{k % 5} gamma {'delta ' * (k % 4)}Été") for k in range(60)]
    base += [(60, None, "alpha"), (61, "", None), (62, "A-B", "group 3 group_3 x group 3")]
    index = Index(spark, str(tmp_path / "i"), "memory_id", "bigint", FIELDS, buckets=4)
    index.add(frame(spark, base))
    for terms in (["alpha"], ["group_3", "ete"], ["delta", "note", "x"], ["missing"], ["group_3", "missing", "7"]):
        assert scores(index.scores(terms, WEIGHTS)) == scanned(frame(spark, base), terms), terms
        assert scores(index.scores(terms, {"title": 4.0})) == scanned(frame(spark, base), terms, {"title": 4.0})
    assert index.scores([], WEIGHTS).count() == 0
    plan = index.scores(["alpha"], WEIGHTS)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "title" not in plan and "body" not in plan


def test_increments_merges_and_readers(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), "memory_id", "bigint", FIELDS, buckets=4)
    now = {}
    for step in range(6):
        changed = {k: (k, f"title {k} s{step}", f"body word{(k * step) % 5} common {'again ' * (step % 3)}") for k in range(step, 40, 3 + step)}
        gone = [k for k in range(step * 2, 40, 9) if k not in changed]
        index.add(frame(spark, [*changed.values()]), spark.createDataFrame([(k,) for k in gone], "memory_id long"))
        now |= changed
        now = {k: v for k, v in now.items() if k not in gone}
        if step == 2:
            held, then = index.at(), frame(spark, [*now.values()])
            before = scanned(then, ["common", "word3"])
    live = frame(spark, [*now.values()])
    asks = (["common"], ["word3", "again"], ["s5", "title"])
    expect = [scanned(live, terms) for terms in asks]
    assert [scores(index.scores(terms, WEIGHTS)) for terms in asks] == expect
    assert scores(held.scores(["common", "word3"], WEIGHTS)) == before
    segments = len(index.manifest().entries("rows"))
    assert index.merge(2) and len(index.manifest().entries("rows")) < segments
    while index.merge(2):
        pass
    assert len(index.manifest().entries("rows")) == 1 and not index.manifest().entries("tombstones")
    assert [scores(index.scores(terms, WEIGHTS)) for terms in asks] == expect and index.live().count() == len(now)
    fresh = Index(spark, str(tmp_path / "j"), "memory_id", "bigint", FIELDS, buckets=4)
    fresh.add(live)
    columns = ["term", "memory_id", "field", "length", "positions"]
    assert sorted(map(str, fresh.live_postings().select(columns).collect())) == sorted(map(str, index.live_postings().select(columns).collect()))
    index.rebuild(live)
    assert [scores(index.scores(terms, WEIGHTS)) for terms in asks] == expect


def test_upkeep_as_a_stream(spark, tmp_path):
    """However the changes are cut into batches, with late changes and a batch run twice, the index is that of the newest changes."""
    changes = [(k % 25, s, s % 11 == 7, f"title {s % 4}", f"common w{s % 6} k{k}") for s, k in enumerate(list(range(60)) + list(range(0, 120, 5)))]
    schema = "memory_id long, seq long, removed boolean, title string, body string"
    newest = {}
    for c in changes:
        newest[c[0]] = max(newest.get(c[0], c), c, key=lambda x: x[1])
    live = frame(spark, [(c[0], *c[3:]) for c in newest.values() if not c[2]])
    asks = (["common"], ["w3", "title"], ["k7", "2"])
    expect = [scanned(live, terms) for terms in asks]
    for n, order in ((1, 1), (3, 1), (4, -1)):
        folder, files = tmp_path / f"s{n}{order}", [changes[k::n] for k in range(n)]
        for k, part in enumerate(files[::order]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"in/f{k}"))
        index = Index(spark, str(folder / "index"), "memory_id", "bigint", FIELDS, buckets=2)
        keeper = Maintainer(index, "changes")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
        keeper.run(stream, str(folder / "checkpoint")).awaitTermination()
        done = index.manifest().version
        keeper.take(spark.createDataFrame(changes[:5], schema), 0)  # as after a failure
        assert index.manifest().version == done
        assert [scores(index.scores(terms, WEIGHTS)) for terms in asks] == expect, (n, order)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_writes_are_whole(spark, store, monkeypatch):
    """A write that fails in the middle leaves no trace, and its retry writes once."""
    store.remember(SCOPE | {"memory_id": "a", "title": "one", "body": "alpha"})
    was, write, calls = store.status(), store.versions.write, []

    def failing(table, df, *args, **more):
        calls.append(table)
        if len(calls) == 3:
            raise OSError("disk")
        return write(table, df, *args, **more)

    monkeypatch.setattr(store.versions, "write", failing)
    ask = SCOPE | {"goal": "g", "open_tasks": ["t"], "idempotency_key": "k"}
    with pytest.raises(OSError):
        store.checkpoint(ask)
    assert len(calls) == 3 and store.status() == was
    monkeypatch.undo()
    first = store.checkpoint(ask)
    assert store.checkpoint(ask) == first | {"replayed": True}
    assert store.status()["states"] == {"active": 3} and store.table("events").filter("kind = 'checkpoint'").count() == 1
    base = store.at()
    store.observe(SCOPE | {"content": "between"})
    with pytest.raises(Conflict):
        store.append({"feedback": [("a", "helpful", 1)]}, base.pinned)
    with pytest.raises(Conflict):
        base.observe(SCOPE | {"content": "a pinned store is not written to"})
    store.versions.vacuum()
    store.compact()
    assert store.status()["states"] == {"active": 3}


def test_recall_pins_its_revisions(store):
    store.remember(SCOPE | {"memory_id": "a", "title": "Cache", "body": "The cache holds 40 entries."})
    found = store.stage_recall(Request("cache entries", **ASK))
    store.remember(SCOPE | {"memory_id": "a", "title": "Cache", "body": "The cache holds 90 entries."})
    store.retract("a")
    told = store.hydrate(found)
    assert "40 entries" in told["rendered"] and told["hits"][0]["state"] == "active" and told["hits"][0]["revision"] == 1
    assert store.get("a")["state"] == "retracted" and store.recall(Request("cache entries", **ASK))["hits"] == []
    assert store.at(1).recall(Request("cache entries", **ASK))["hits"][0]["body"] == "The cache holds 40 entries."


def test_recall_from_kept_indexes(spark, store):
    kept = Store(spark, store.path, indexed=True)
    ask = lambda s, q: [(h["memory_id"], h["signals"], round(h["score"], 9)) for h in s.recall(Request(q, **ASK))["hits"]]
    store.remember_many([SCOPE | {"memory_id": f"m{k}", "title": f"Retry policy {k}", "body": f"back off group_{k % 3} after {k} tries", "tags": ["net"]} for k in range(8)])
    for query in ("group_2 tries",):
        assert ask(kept, query) == ask(store, query) != []
    store.remember(SCOPE | {"memory_id": "m3", "title": "Pool size", "body": "EADDRINUSE at start"})
    store.retract("m4")
    for query in ("retry policy", "portinuse"):
        assert ask(kept, query) == ask(store, query) != []
    versions = [kept.index("text").manifest().version]
    ask(kept, "pool")
    assert versions == [kept.index("text").manifest().version]  # nothing new, nothing written
    assert {r[0] for r in kept.index("text").live().select("memory_id").collect()} == {f"m{k}" for k in range(8)} - {"m4"}


def test_hashes_that_nobody_looked_at(spark, store, tmp_path):
    import hashlib

    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.txt").write_text("one")
    now = hashlib.sha256(b"one").hexdigest()
    store.remember(SCOPE | {"memory_id": "a", "title": "Floor", "body": "version floor", "artifacts": [{"path": "a.txt", "content_hash": now}]})
    one = lambda request, **more: store.recall(request, **more)["hits"][0]
    ask = Request("version floor", include_stale=True, **ASK)
    unseen = one(ask)
    assert unseen["applicability"] == "unversioned" and "artifact_verified" not in unseen["signals"]
    seen = one(ask, root=str(tree))
    assert seen["applicability"] == "exact" and "artifact_verified" in seen["signals"]
    (tree / "a.txt").write_text("two")
    assert one(ask, root=str(tree))["applicability"] == "stale"
    hinted = Request("version floor", include_stale=True, artifacts={("r", "a.txt", None): now}, **ASK)
    assert one(hinted, root=str(tree))["applicability"] == "exact"  # a caller's hint goes before a look-up


def test_the_first_hint_counts(spark):
    from strataloom.operators import applicability as A

    artifacts = spark.createDataFrame([("x", "r", "p", None, "h", "looked")], "artifact_id string, repo_id string, path string, symbol string, stored_hash string, current_hash string")
    told = lambda rows: A.hinted(artifacts, spark.createDataFrame(rows, "repo_id string, path string, symbol string, content_hash string, place int")).first()["current_hash"]
    assert told([("r", "p", None, "zzz", 1), ("r", "p", None, "aaa", 0)]) == "aaa"
    assert told([("r", "p", None, "zzz", 1), ("r", "p", None, None, 0)]) is None
    assert told([("r", "p", "s", "zzz", 1)]) == "looked"


def test_fingerprints_and_aliases_are_kept(spark, store, tmp_path):
    from strataloom.operators.aliasing import Aliases

    file = lambda path, **more: {"path": path} | more
    store.remember(SCOPE | {"memory_id": "a", "title": "Lock order", "body": "GuardLock", "artifacts": [file("x.rs", content_hash="h"), file("y.rs")]})
    scope = ("n", "w", "r", "main")
    count = lambda **more: {n: 0 for n in ("referenced", "canonical", "projected", "valid", "missing", "corrupt", "orphaned", "unverifiable")} | more
    assert store.artifact_status(*scope) == count(referenced=2, canonical=2, missing=2, unverifiable=1, degraded=True)
    assert store.artifact_status("n", "other") == count(degraded=False)
    assert store.repair_fingerprints() == 2 and store.repair_fingerprints() == 0
    assert store.artifact_status(*scope) == count(referenced=2, canonical=2, projected=2, valid=2, unverifiable=1, degraded=False)
    one = store.kept_fingerprints.filter("identity is not null").first()[0]
    store.append({"fingerprint_rows": [(one, "bad", "bad", 1 << 40)]})
    assert store.artifact_status(*scope)["corrupt"] == 1 and store.artifact_status(*scope)["degraded"]
    kept = Aliases(spark, str(tmp_path / "aliases"), "string")
    store.remember(SCOPE | {"memory_id": "b", "title": "Other", "body": "text_here"})
    assert (kept.repair(store), kept.repair(store)) == (2, 0)
    store.remember(SCOPE | {"memory_id": "b", "title": "Other", "body": "CamelCase now"})
    assert kept.repair(store) == 1 and "camelcase" in {r["memory_id"]: r["aliases"] for r in kept.rows().collect()}["b"]
    assert Aliases(spark, str(tmp_path / "aliases"), "string", "aliases-2").repair(store) == 2  # another generator: all


def test_snapshots_of_format_1(spark, store, tmp_path):
    """Texts and states are restored, metadata counts as complete for the head's own revision alone, links get the revision that made them."""
    from strataloom.sources import legacy, snapshot

    store.remember(SCOPE | {"memory_id": "t", "title": "target", "body": "b"})
    store.remember(SCOPE | {"memory_id": "a", "title": "one", "body": "first text", "importance": 0.2, "canonical_key": "k", "links": [{"target": "t", "relation": "documents", "weight": 400}]})
    store.remember(SCOPE | {"memory_id": "a", "title": "two", "body": "second text", "importance": 0.9, "canonical_key": "k"})
    store.remember(SCOPE | {"memory_id": "c", "title": "same key", "body": "another head", "kind": "fact"})
    store.retract("t")
    events = store.table("events").select("event_id", "seq")
    # what format 1 holds of this store; the retraction had changed t's head, so its updated_seq is later than its revision
    heads = store.heads.withColumn("updated_seq", F.when(F.col("memory_id") == "t", F.col("updated_seq") + 4).otherwise(F.col("updated_seq"))).withColumn("canonical_key", F.lit("k"))
    links = store.table("links").join(events.withColumnRenamed("seq", "created_seq"), "created_seq").withColumnRenamed("event_id", "created_event_id")
    old = {"heads": heads, "revisions": store.table("revisions"), "links": links}
    old = {name: old[name].select(*(x.split()[0] for x in legacy.TABLES[name].split(", "))) for name in old} | {name: store.table(name) for name in ("events", "tag_rows", "feedback")}
    snapshot.export(old, str(tmp_path / "v1"), version=1)
    other = Store(spark, str(tmp_path / "other"))
    other.load(str(tmp_path / "v1"))
    assert other.get("t")["state"] == "retracted" and other.get("a")["body"] == "second text" and other.get("a")["canonical_key"] == other.get("c")["canonical_key"] == "k"
    past = other.history("a")
    assert [(r["body"], r["metadata_complete"]) for r in past["revisions"]] == [("first text", False), ("second text", True)]
    assert [(x["source_revision"], x["target_id"], x["relation"], x["weight"]) for x in past["links"]] == [(1, "t", "documents", 400)]
    assert [r["metadata_complete"] for r in other.history("t")["revisions"]] == [False]
    other.export(str(tmp_path / "v2"))
    again = Store(spark, str(tmp_path / "again"))
    again.load(str(tmp_path / "v2"))
    ends = lambda s: sorted(map(tuple, snapshot.footer(snapshot.lines({n: s.table(n) for n in ("events", "revisions", "links", "facts")})).collect()))
    assert ends(again) == ends(other)
    bad = {"heads": old["heads"].withColumn("extra", F.lit(1)), "revisions": old["revisions"], "events": old["events"]}
    snapshot.export(bad, str(tmp_path / "bad"), version=1)
    empty = Store(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError):
        empty.load(str(tmp_path / "bad"))
    assert empty.versions.numbers() == []
