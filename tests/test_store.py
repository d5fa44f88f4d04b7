"""The write path and the whole read path on small cases."""

import pytest

from strataloom.operators.retrieval import Request
from strataloom.store import Conflict, Store

SCOPE = {"namespace": "n", "workspace_id": "w", "repo_id": "r", "branch": "main"}
ASK = {"namespace": "n", "workspace_id": "w", "repo_id": "r", "branch": "main", "as_of_ms": 1 << 45}


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def ids(found):
    return [h["memory_id"] for h in found["hits"]]


def test_recall_scopes_and_states(store):
    a = store.remember(SCOPE | {"memory_id": "a", "title": "Lock order", "body": "Take the guard lock before the queue lock.", "kind": "procedure", "tags": ["locking"], "idempotency_key": "k1"})
    assert store.remember(SCOPE | {"memory_id": "a", "title": "Lock order", "body": "Take the guard lock before the queue lock.", "kind": "procedure", "tags": ["locking"], "idempotency_key": "k1"}) == a | {"replayed": True}
    with pytest.raises(Conflict):
        store.remember(SCOPE | {"memory_id": "a", "title": "Other", "idempotency_key": "k1"})
    store.remember_many([
        SCOPE | {"repo_id": "other", "memory_id": "b", "title": "Lock order elsewhere", "body": "guard lock queue lock"},
        SCOPE | {"workspace_id": "x", "memory_id": "c", "title": "Lock order there", "body": "guard lock"},
        SCOPE | {"memory_id": "d", "title": "Address in use", "body": "port 80 fails with EADDRINUSE", "entities": [{"kind": "service", "canonical": "web_front", "display": "Web Front"}], "attributes": {"error_fingerprint": "f1"}},
        SCOPE | {"memory_id": "e", "title": "Divergent note", "body": "guard lock on a branch", "branch": "dev"},
    ])
    found = store.recall(Request("guard lock", **ASK))
    assert "a" in ids(found) and not {"b", "c", "e"} & set(ids(found)) and "[procedures]" in found["rendered"]
    assert "e" in ids(store.recall(Request("guard lock", include_divergent=True, **ASK)))
    assert ids(store.recall(Request("portinuse", **ASK)))[0] == "d"  # by an alias of the error's name
    assert ids(store.recall(Request("nothing", entities=("web front",), **ASK)))[0] == "d"
    assert ids(store.recall(Request("nothing", error_fingerprint="f1", **ASK)))[0] == "d"
    store.remember(SCOPE | {"memory_id": "a2", "title": "Lock order, new", "body": "Take the queue lock first.", "links": [{"target": "a", "relation": "supersedes"}]})
    assert store.get("a")["state"] == "superseded" and "a" not in ids(store.recall(Request("guard lock", **ASK)))
    with pytest.raises(Conflict):
        store.remember(SCOPE | {"memory_id": "a", "title": "late"})
    store.remember(SCOPE | {"memory_id": "f", "title": "No", "body": "doubtful", "links": [{"target": "d", "relation": "contests"}]})
    assert {store.get(k)["state"] for k in "df"} == {"contested"} and "[warnings]" in store.recall(Request("portinuse", **ASK))["rendered"]
    store.retract("d")
    assert store.get("d")["state"] == "retracted" and "d" not in ids(store.recall(Request("portinuse", include_superseded=True, **ASK)))
    assert store.status()["states"] == {"active": 4, "contested": 1, "superseded": 1, "retracted": 1}


def test_canonical_revisions_and_stale_artifacts(store):
    one = store.remember(SCOPE | {"title": "Version", "body": "The floor is 1.70", "canonical_key": "msrv", "artifacts": [{"path": "Cargo.toml", "content_hash": "h1"}]})
    assert ids(store.recall(Request("version floor", **ASK))) == [one["memory_id"]]
    store.append({"current_files": [("r", "Cargo.toml", "h2", 1)]})
    assert ids(store.recall(Request("version floor", **ASK))) == []
    assert store.recall(Request("version floor", include_stale=True, **ASK))["hits"][0]["applicability"] == "stale"
    two = store.remember(SCOPE | {"title": "Version", "body": "The floor is 1.80", "canonical_key": "msrv"})
    assert (two["memory_id"], two["revision"]) == (one["memory_id"], 2)
    found = store.recall(Request("version floor", **ASK))
    assert "1.80" in found["rendered"] and "1.70" not in found["rendered"]
    past = store.history(one["memory_id"])
    assert [r["revision"] for r in past["revisions"]] == [1, 2] and past["revisions"][0]["retired_at_ms"] is not None


def test_projections(store):
    r = store.remember(SCOPE | {"memory_id": "a", "title": "t", "body": "alpha"})
    store.register_profile("p", "m", 2)
    with pytest.raises(Conflict):
        store.register_profile("p", "m2", 2)
    assert [x["memory_id"] for x in store.pending("p").collect()] == ["a"]
    own = {"memory_id": "a", "revision": 1, "content_hash": r["content_hash"], "expansions": ["first letter"], "vector": [1.0, 0.5]}
    assert store.register_projections("p", [own]) == {"a": "stored"} and store.register_projections("p", [own]) == {"a": "unchanged"}
    with pytest.raises(Conflict):
        store.register_projections("p", [own | {"vector": [1.0, 0.0]}])
    assert store.register_projections("p", [own | {"content_hash": "old"}]) == {"a": "stale"} and store.pending("p").count() == 0
    assert store.coverage() == {"eligible": 1, "indexed": 1, "pending": 0, "stale": 0}
    hit = store.recall(Request("letter", vector=(1.0, 0.4), **ASK))["hits"][0]
    assert {"semantic_expansion", "dense"} <= set(hit["signals"])
    store.activate_profile("p", False)
    assert "dense" not in store.recall(Request("letter", vector=(1.0, 0.4), **ASK))["hits"][0]["signals"]


def test_sessions_and_snapshots(spark, store, tmp_path):
    at = SCOPE | {"session_id": "s"}
    say = lambda kind, content, **a: store.observe(at | {"kind": kind, "content": content, "attributes": a})
    say("command_result", "old", command="make", exit_code=2)
    say("conversation_turn", "please build", role="user")
    say("command_result", "error: no rule", command="make  all", exit_code=2)
    say("command_result", "password: hunter2hunter2", command="make all", exit_code=0, verification=True)
    say("command_result", "", command="rg x", exit_code=1)
    made = store.checkpoint_session(at | {"goal": "build", "open_tasks": ["ship"]})
    heads = {h["title"]: h for h in store.heads.collect()}
    assert set(heads) == {"build", "Successful attempt: make all", "Open task: ship"} and len(made["memory_ids"]) == 3
    body = heads["Successful attempt: make all"]["body"]
    assert "First failure: error: no rule" in body and "Observed runs: 2" in body and "hunter2" not in body
    store.give_feedback(made["memory_ids"][0], "helpful")
    store.export(str(tmp_path / "x"))
    other = Store(spark, str(tmp_path / "other"))
    other.load(str(tmp_path / "x"))
    assert other.status() == store.status()
    with pytest.raises(Conflict):
        other.load(str(tmp_path / "x"))


def test_prior_failures_and_retries(store):
    """A success of a later session revises the failure that an earlier checkpoint left open; a retry of the first checkpoint still gives its receipt."""
    run = lambda session, text, code: store.observe(SCOPE | {"session_id": session, "kind": "command_result", "content": text, "attributes": {"command": "make all", "exit_code": code}})
    run("s1", "error: no rule", 2)
    ask = SCOPE | {"session_id": "s1", "goal": "build", "idempotency_key": "c1"}
    first = store.checkpoint_session(ask)
    failed = {h["title"]: h for h in store.heads.collect()}["Failed attempt: make all"]
    run("s2", "done", 0)
    store.checkpoint_session(SCOPE | {"session_id": "s2", "goal": "build again"})
    now = store.get(failed["memory_id"])
    assert now["title"] == "Successful attempt: make all" and now["head_revision"] == 2
    assert "First failure: error: no rule\nFinal result: done\nObserved runs: 2" in now["body"]
    assert store.checkpoint_session(ask) == first | {"replayed": True}
    run("s3", "fine", 0)
    assert len(store.checkpoint_session(SCOPE | {"session_id": "s3", "goal": "third"})["memory_ids"]) == 1  # the failure is closed: an ordinary success is not kept
    with pytest.raises(Conflict):
        store.checkpoint_session(ask | {"goal": "other"})


def test_access_evidence_and_links(store):
    event = store.observe(SCOPE | {"content": "größe"})["event_id"]
    other = store.observe(SCOPE | {"branch": "dev", "content": "x"})["event_id"]
    store.remember(SCOPE | {"memory_id": "a", "title": "t", "evidence": [{"event_id": event, "span_start": 2, "span_end": 4}]})
    store.remember(SCOPE | {"memory_id": "o", "branch": "dev", "title": "t"})
    for bad in ({"event_id": "none"}, {"event_id": other}, {"event_id": event, "span_start": 1}, {"event_id": event, "span_start": 2, "span_end": 3}, {"event_id": event, "span_start": 0, "span_end": 9}, {"event_id": event, "relation": ""}):
        with pytest.raises(ValueError):
            store.remember(SCOPE | {"memory_id": "b", "title": "t", "evidence": [bad]})
    for bad in ({"target": "o", "relation": "about"}, {"target": "a", "relation": " "}):
        with pytest.raises(ValueError):
            store.remember(SCOPE | {"memory_id": "b", "title": "t", "links": [bad]})
    assert store.get("b") is None and store.get("a", SCOPE)["title"] == "t" and store.get("a", SCOPE | {"repo_id": None}) is None
    with pytest.raises(ValueError):
        store.retract("a", scope=SCOPE | {"workspace_id": "x"})
    with pytest.raises(ValueError):
        store.give_feedback("a", "helpful", SCOPE | {"namespace": "m"})


def test_inspect_and_purge(spark, store):
    store.remember(SCOPE | {"memory_id": "a", "title": "t"})
    told = store.inspect()
    assert told["schemas"] == {} and set(told["violations"].values()) == {0}
    odd = store.versions.write("feedback", spark.createDataFrame([("a", 1)], "memory_id string, extra int"))
    store.versions.commit(store.versions.manifest(), {"feedback": [odd]})
    assert store.inspect()["schemas"]["feedback"] == ["seq is missing", "signal is missing", "extra is unknown"]
    store.purge()
    assert store.status() == {"states": {}, "events": 0, "watermark": 0}


def test_bounds(store):
    for bad in ({"namespace": ""}, {"importance": 1.5}, {"title": "x" * 5000}, {"tags": ["t"] * 65}, {"valid_from_ms": 2, "valid_until_ms": 1}, {"kind": "no"}, {"links": [{"target": "none", "relation": "x"}]}):
        with pytest.raises(ValueError):
            store.remember(SCOPE | {"title": "t"} | bad)
    assert store.status() == {"states": {}, "events": 0, "watermark": 0}
