"""A store of events and records over append-only Parquet tables: the write path, and every read as a view.

A write adds rows to the tables in one commit (``sources/versions``) and changes
nothing that is there: all of it is seen or nothing, and of two writers with one
base the second is refused.  A store is read as of its last version; ``at`` pins
one, so that a reader's steps see the same rows whatever is written between.
The current revision and state of a record are views over the log.  Writes come in batches that fit the driver (an agent's requests, or a
checkpoint's records); what they look up is filtered to their own ids and keys.
Large loads are ``bulk``.

The views have the names and columns that the retrieval operators read, so
``recall`` runs the same plans over a store as over any other corpus.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom import schemas as S
from strataloom.functions import text as X
from strataloom.index import Index
from strataloom.operators import applicability as A
from strataloom.operators import ledger as L
from strataloom.operators import retrieval as R
from strataloom.operators import selection
from strataloom.operators.postings import LAYOUT
from strataloom.sources import files, snapshot
from strataloom.sources.scratch import remove, staged
from strataloom.sources.versions import Conflict, Manifest, Versions

__all__ = ["Conflict", "Store"]

SCOPE = "namespace string, workspace_id string, repo_id string, branch string"
TABLES = {
    "events": f"seq long, event_id string, {SCOPE}, session_id string, kind string, content string, attributes string, trust string, occurred_at_ms long, ingested_at_ms long",
    "revisions": f"memory_id string, revision long, recorded_seq long, recorded_at_ms long, {SCOPE}, head_commit string, dirty_hash string, kind string, canonical_key string, title string, body string, content_hash string, importance float, confidence float, trust string, valid_from_ms long, valid_until_ms long, expires_at_ms long, event_id string, metadata_complete boolean",
    "tag_rows": "memory_id string, revision long, tag string",
    "entity_rows": "memory_id string, revision long, entity_kind string, canonical string, display string",
    "artifact_rows": "memory_id string, revision long, artifact_id string, repo_id string, path string, symbol string, stored_hash string",
    "current_files": "repo_id string, path string, current_hash string, seq long",
    "evidence": "memory_id string, revision long, event_id string, relation string, span_start long, span_end long",
    "fingerprint_rows": "artifact_id string, identity string, content string, seq long",
    "links": "source_id string, target_id string, relation string, weight int, created_seq long, source_revision long",
    "facts": "memory_id string, seq long, state string",
    "feedback": "memory_id string, signal string, seq long",
    "requests": "namespace string, operation string, key string, request_hash string, receipt string, seq long",
    "profiles": "profile_id string, model_digest string, dimensions int, active boolean, seq long",
    "projection_rows": "memory_id string, profile string, revision long, content_hash string, expansions string, vector array<float>, seq long",
    "commits": "commit_id string, parent_id string",
}
#: The columns of a scope that a record's evidence, links and revisions share with it.
OWN = ("namespace", "workspace_id", "repo_id", "branch")
#: Byte limits of request fields.
LIMITS = {"title": 4096, "body": 1 << 20, "content": 1 << 20, "canonical_key": 512, "idempotency_key": 512, "namespace": 128}
COUNTS = {"tags": 64, "entities": 128, "artifacts": 128, "evidence": 256, "links": 128}


def digest(*parts: str) -> str:
    """SHA-256 of parts, each behind its length."""
    h = hashlib.sha256()
    for p in parts:
        raw = p.encode()
        h.update(len(raw).to_bytes(8, "little") + raw)
    return h.hexdigest()


def checked(request: dict) -> dict:
    """A request with its bounds tested and its secrets replaced."""
    out = dict(request)
    if not out.get("namespace"):
        raise ValueError("a namespace is needed")
    for name, most in LIMITS.items():
        if out.get(name) is not None and len(out[name].encode()) > most:
            raise ValueError(f"{name} has more than {most} bytes")
    for name, most in COUNTS.items():
        if len(out.get(name) or ()) > most:
            raise ValueError(f"more than {most} {name}")
    for name in ("importance", "confidence"):
        if name in out and not (math.isfinite(out[name]) and 0 <= out[name] <= 1):
            raise ValueError(f"{name} must be from 0 to 1")
    if out.get("valid_from_ms") is not None and out.get("valid_until_ms") is not None and out["valid_until_ms"] <= out["valid_from_ms"]:
        raise ValueError("valid_until must be after valid_from")
    for name in ("title", "body", "content"):
        if out.get(name) is not None:
            out[name] = X.redact_plain(out[name])[0]
    out["attributes"] = X.redact_value(out.get("attributes") or {})[0]
    return out


def proved(e: dict, scope: tuple, events: dict[str, dict]) -> tuple:
    """An evidence reference as a row's end: its event exists in the same scope, and its span, if any, is a range of whole characters in the event's UTF-8 bytes."""
    relation, start, end = e.get("relation", "supports"), e.get("span_start"), e.get("span_end")
    if not 0 < len(relation.encode()) <= 64:
        raise ValueError("a relation has 1 to 64 bytes")
    source = events.get(e["event_id"])
    if source is None:
        raise ValueError("an evidence event does not exist")
    if tuple(source[c] for c in OWN) != scope:
        raise Conflict("evidence does not leave its scope")
    if (start is None) != (end is None):
        raise ValueError("a span has a start and an end")
    if start is not None:
        raw = (source["content"] or "").encode()
        if not 0 <= start < end <= len(raw) or any(at < len(raw) and raw[at] & 0xC0 == 0x80 for at in (start, end)):
            raise ValueError("a span is a range of whole characters")
    return e["event_id"], relation, start, end


class Store:
    """Tables under a path (a local or remote folder) of one session.

    ``pinned``: the version that is read, else the last one.  ``indexed``: keep inverted indexes beside the tables, which a
    recall brings up to date with what was written since and then asks instead of the texts.
    """

    def __init__(self, spark: SparkSession, path: str, pinned: Manifest | None = None, indexed: bool = False) -> None:
        self.spark, self.path, self.versions, self.pinned, self.indexed = spark, path.rstrip("/"), Versions(spark, path), pinned, indexed

    # tables and views

    def manifest(self) -> Manifest:
        return self.pinned or self.versions.manifest()

    def at(self, version: int | None = None) -> Store:
        """The store as of a version, the present one by default; what is written later does not show in it."""
        return Store(self.spark, self.path, self.versions.manifest(version) if version is not None else self.manifest(), self.indexed)

    def table(self, name: str) -> DataFrame:
        return self.versions.read(self.manifest(), name, T.StructType.fromDDL(TABLES[name]))

    def append(self, rows: dict[str, list[tuple]], base: Manifest | None = None) -> None:
        """Rows of several tables in one commit, after the version that they were made from."""
        self.bulk({name: self.spark.createDataFrame(some, TABLES[name]).coalesce(1) for name, some in rows.items() if some}, base)

    def bulk(self, tables: dict[str, DataFrame], base: Manifest | None = None) -> None:
        """Whole tables in one commit, written by Spark's tasks."""
        if self.pinned is not None:
            raise Conflict("a pinned store is not written to")
        base = base or self.versions.manifest()
        added = {name: [self.versions.write(name, df)] for name, df in tables.items()}
        if added:
            self.versions.commit(base, added)

    def compact(self) -> None:
        """Make one folder of the many small ones that single writes leave, table by table, each in a commit of its own."""
        for name in TABLES:
            self.versions.compact(self.versions.manifest(), name, T.StructType.fromDDL(TABLES[name]))

    def watermark(self) -> int:
        return self.table("events").agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]

    @property
    def heads(self) -> DataFrame:
        revisions = self.table("revisions")
        last = revisions.groupBy("memory_id").agg(F.max_by(F.struct(*(c for c in revisions.columns if c != "memory_id")), "revision").alias("r"))
        facts = self.table("facts").groupBy("memory_id").agg(F.max_by("state", "seq").alias("fact"))
        rows = last.select("memory_id", "r.*").join(facts, "memory_id", "left").withColumn("state", F.coalesce("fact", F.lit("active")))
        return rows.drop("fact").withColumnsRenamed({"revision": "head_revision", "recorded_seq": "updated_seq", "recorded_at_ms": "updated_at_ms"})

    @property
    def tags(self) -> DataFrame:
        return self.table("tag_rows")

    @property
    def entities(self) -> DataFrame:
        return self.table("entity_rows")

    @property
    def memory_artifacts(self) -> DataFrame:
        return self.table("artifact_rows").select("memory_id", "revision", "artifact_id")

    @property
    def artifacts(self) -> DataFrame:
        now = self.table("current_files").groupBy("repo_id", "path").agg(F.max_by("current_hash", "seq").alias("current_hash"))
        known = self.table("artifact_rows").select("artifact_id", "repo_id", "path", "symbol", "stored_hash").distinct()
        return known.join(now, ["repo_id", "path"], "left")  # null where nobody has looked: neither changed nor verified

    @property
    def fingerprints(self) -> DataFrame:
        events = self.table("events").select("event_id", F.get_json_object("attributes", "$.error_fingerprint").alias("fingerprint"))
        return self.table("revisions").select("memory_id", "event_id").join(events, "event_id").filter("fingerprint is not null").select("memory_id", "fingerprint")

    @property
    def profiles(self) -> DataFrame:
        known = self.table("profiles")
        return known.groupBy("profile_id").agg(F.max_by("active", "seq").alias("active"), F.min_by("model_digest", "seq").alias("model_digest"), F.min_by("dimensions", "seq").alias("dimensions"))

    def _projected(self) -> DataFrame:
        rows = self.table("projection_rows")
        last = rows.groupBy("memory_id", "profile").agg(F.max_by(F.struct("revision", "content_hash", "expansions", "vector"), "seq").alias("p")).select("memory_id", "profile", "p.*")
        return last.join(self.profiles.select(F.col("profile_id").alias("profile"), "active"), "profile")

    @property
    def projections(self) -> DataFrame:
        return self._projected().filter("active").select("memory_id", "revision", "content_hash", "vector")

    @property
    def expansions(self) -> DataFrame:
        return self._projected().select("memory_id", "profile", "active", "revision", "content_hash", "expansions")

    @property
    def commits(self) -> DataFrame:
        return self.table("commits")

    @property
    def feedback(self) -> DataFrame:
        return self.table("feedback")

    # kept indexes

    def index(self, name: str) -> Index:
        """One of the indexes ``text``, ``aliases`` and ``expansions``."""
        key, kind, names = _INDEXES[name]
        return Index(self.spark, f"{self.path}/index/{name}-{LAYOUT}", key, kind, names)

    def _asked(self, name: str) -> Index | None:
        """The index, if it is of the version that is read."""
        if not self.indexed:
            return None
        found = self.index(name).at()
        return found if found.pinned.notes.get("streams", {}).get("store", -1) == self.manifest().version else None

    @property
    def text_index(self) -> Index | None:
        return self._asked("text")

    @property
    def alias_index(self) -> Index | None:
        return self._asked("aliases")

    @property
    def expansion_index(self) -> Index | None:
        return self._asked("expansions")

    def refresh(self) -> None:
        """Bring the indexes up to the present version, by the records that the commits since theirs have touched; the folders that a manifest has more than an older one name them."""
        now = self.manifest()
        for name in _INDEXES:
            index = self.index(name)
            then = index.versions.manifest().notes.get("streams", {}).get("store", 0)
            if then >= now.version:
                continue
            before = self.versions.manifest(then)
            more = lambda table: self.versions.read(Manifest(0, {table: [e for e in now.entries(table) if e not in before.entries(table)]}), table, T.StructType.fromDDL(TABLES[table]))  # noqa: B023, E731
            if name == "expansions":
                changed = more("projection_rows").select("memory_id", "profile").distinct()
                rows = self.expansions.join(changed, ["memory_id", "profile"], "left_semi").select(F.struct("memory_id", "profile").alias("row"), "expansions")
                gone = None
            else:
                changed = staged(more("revisions").select("memory_id").union(more("facts").select("memory_id")).distinct(), "changed")
                part = _Part(self, changed)
                rows, gone = R.fields(part) if name == "text" else R.alias_texts(part), changed
            index.add(rows, gone, "store", now.version)
            index.merge()

    # writes

    def _replayed(self, operation: str, request: dict) -> dict | None:
        key = request.get("idempotency_key")
        if key is None:
            return None
        own = json.dumps({k: v for k, v in request.items() if k != "idempotency_key"}, sort_keys=True, default=str)
        found = self.table("requests").filter((F.col("namespace") == request["namespace"]) & (F.col("operation") == operation) & (F.col("key") == key)).first()
        if found is None:
            return None
        if found["request_hash"] != digest(own):
            raise Conflict("the idempotency key was used for another request")
        return json.loads(found["receipt"]) | {"replayed": True}

    def _ledger(self, operation: str, request: dict, receipt: dict, seq: int) -> list[tuple]:
        if request.get("idempotency_key") is None:
            return []
        own = json.dumps({k: v for k, v in request.items() if k != "idempotency_key"}, sort_keys=True, default=str)
        return [(request["namespace"], operation, request["idempotency_key"], digest(own), json.dumps(receipt), seq)]

    def _event(self, r: dict, kind: str, content: str, seq: int, now: int) -> tuple:
        scope = tuple(r.get(c) for c in ("namespace", "workspace_id", "repo_id", "branch"))
        return (seq, r.get("event_id") or str(uuid.uuid4()), *scope, r.get("session_id"), kind, content, json.dumps(r.get("attributes") or {}, sort_keys=True), r.get("trust", "agent"), r.get("occurred_at_ms", now), now)

    def observe(self, request: dict) -> dict:
        """Append an event; the same idempotency key again gives the first receipt."""
        r = checked(request)
        if (old := self._replayed("observe", r)) is not None:
            return old
        view = self.at()
        seq = view.watermark() + 1
        event = self._event(r, r.get("kind", "manual_note"), r.get("content") or "", seq, _now())
        receipt = {"event_id": event[1], "seq": seq}
        self.append({"events": [event], "requests": self._ledger("observe", r, receipt, seq)}, view.pinned)
        return receipt | {"replayed": False}

    def remember(self, request: dict) -> dict:
        return self.remember_many([request])[0]

    def remember_many(self, requests: list[dict]) -> list[dict]:
        """Records as new ones or as revisions of those with the same id or open canonical key, in order; nothing is written if one is refused."""
        view, rows = self.at(), {name: [] for name in TABLES}
        out, _ = view._planned([checked(r) for r in requests], rows, view.watermark())
        self.append(rows, view.pinned)
        return out

    def _planned(self, ready: list[dict], rows: dict[str, list[tuple]], seq: int) -> tuple[list[dict], int]:
        """The rows that records make after a sequence number, added to ``rows``; their receipts and the last number."""
        ids, keys = [r["memory_id"] for r in ready if r.get("memory_id")], [r["canonical_key"] for r in ready if r.get("canonical_key")]
        targets = [link["target"] for r in ready for link in r.get("links") or ()]
        heads = self.heads.filter(F.col("memory_id").isin(*ids, *targets) | F.col("canonical_key").isin(*keys)).collect() if ids or keys or targets else []
        known = {h["memory_id"]: h.asDict() for h in heads}
        sources = [e["event_id"] for r in ready for e in r.get("evidence") or ()]
        events = {e["event_id"]: e.asDict() for e in self.table("events").filter(F.col("event_id").isin(*sources)).collect()} if sources else {}
        out, now = [], _now()
        for r in ready:
            if (old := self._replayed("remember", r)) is not None:
                out.append(old)
                continue
            seq += 1
            out.append(self._upsert(r, rows, known, events, seq, now) | {"replayed": False})
            rows["requests"] += self._ledger("remember", r, {k: v for k, v in out[-1].items() if k != "replayed"}, seq)
        return out, seq

    def _upsert(self, r: dict, rows: dict[str, list[tuple]], known: dict[str, dict], events: dict[str, dict], seq: int, now: int) -> dict:
        kind = r.get("kind", "fact")
        if kind not in S.KINDS:
            raise ValueError(f"unknown kind {kind}")
        scope = tuple(r.get(c) for c in OWN)
        own = lambda h: tuple(h[c] for c in OWN)
        head = known.get(r.get("memory_id"))
        if head is not None and head["state"] in ("superseded", "retracted"):
            raise Conflict(f"a {head['state']} record has no further revisions")
        if head is not None and own(head) != scope:
            raise Conflict("a record does not change its scope")
        if head is None and r.get("memory_id") is None and r.get("canonical_key"):
            same = [h for h in known.values() if own(h) == scope and h["kind"] == kind and h["canonical_key"] == r["canonical_key"] and h["state"] in ("active", "contested")]
            head = max(same, key=lambda h: h["updated_seq"], default=None)
        memory_id = head["memory_id"] if head else r.get("memory_id") or str(uuid.uuid4())
        revision = head["head_revision"] + 1 if head else 1
        event = self._event(r, "memory_recorded", r.get("title") or "", seq, now)
        title, body = r.get("title") or "", r.get("body") or ""
        content_hash = digest(title, body)
        values = (r.get("head_commit"), r.get("dirty_hash"), kind, r.get("canonical_key"), title, body, content_hash, float(r.get("importance", 0.5)), float(r.get("confidence", 0.7)), r.get("trust", "agent"))
        rows["events"].append(event)
        rows["revisions"].append((memory_id, revision, seq, now, *scope, *values, r.get("valid_from_ms"), r.get("valid_until_ms"), r.get("expires_at_ms"), event[1], True))
        rows["tag_rows"] += [(memory_id, revision, t) for t in sorted(set(r.get("tags") or ()))]
        rows["entity_rows"] += [(memory_id, revision, e["kind"], e["canonical"], e.get("display") or e["canonical"]) for e in r.get("entities") or ()]
        for a in r.get("artifacts") or ():
            name = digest(a.get("repo_id") or scope[2] or "", a["path"], a.get("symbol") or "", a.get("content_hash") or "")
            rows["artifact_rows"].append((memory_id, revision, name, a.get("repo_id") or scope[2], a["path"], a.get("symbol") or None, a.get("content_hash") or None))
        rows["evidence"] += [(memory_id, revision, *proved(e, scope, events)) for e in r.get("evidence") or ()]
        state = "active"
        if head is not None and head["state"] == "contested":
            rows["facts"].append((memory_id, seq, "active"))
        for link in r.get("links") or ():
            target = known.get(link["target"])
            if target is None:
                raise ValueError("a link's target does not exist")
            if tuple(target[c] for c in OWN) != scope:
                raise Conflict("a link does not leave its scope")
            if not link["relation"].strip() or len(link["relation"].encode()) > 64:
                raise ValueError("a relation has 1 to 64 bytes")
            rows["links"].append((memory_id, link["target"], link["relation"], link.get("weight", 500), seq, revision))
            if link["relation"] == "supersedes" and target["state"] in ("active", "contested"):
                rows["facts"].append((link["target"], seq, "superseded"))
                target["state"] = "superseded"
            elif link["relation"] == "contests":
                state = "contested"
                rows["facts"].append((memory_id, seq, "contested"))
                if target["state"] == "active":
                    rows["facts"].append((link["target"], seq, "contested"))
                    target["state"] = "contested"
        columns = [x.split()[0] for x in TABLES["revisions"].split(", ")]
        known[memory_id] = dict(zip(columns, rows["revisions"][-1])) | {"state": state, "head_revision": revision, "updated_seq": seq}
        return {"memory_id": memory_id, "revision": revision, "content_hash": content_hash, "seq": seq, "event_id": event[1]}

    def checkpoint(self, request: dict) -> dict:
        """An episode with its decisions, attempts and open tasks as records that belong to it; the same idempotency key again gives the first receipt."""
        r = checked(request)
        if (old := self._replayed("checkpoint", r)) is not None:
            return old
        scope = {c: r.get(c) for c in ("namespace", "workspace_id", "repo_id", "branch", "session_id", "trust") if r.get(c) is not None}
        episode = str(uuid.uuid4())
        verified = bool(r.get("verification"))
        made = [scope | {"memory_id": episode, "kind": "episode", "title": r["goal"], "body": r.get("summary") or r["goal"], "importance": 0.72, "confidence": 0.85 if verified else 0.65}]
        part = lambda weight: {"links": [{"target": episode, "relation": "belongs_to", "weight": weight}]}
        for d in r.get("decisions") or ():
            body = f"{d['summary']}\nRationale: {d['rationale']}" if d.get("rationale") else d["summary"]
            made.append(scope | part(900) | {"kind": "decision", "title": f"Decision: {d['summary']}", "body": body, "importance": 0.82, "confidence": 0.80, "canonical_key": d.get("canonical_key")})
        for a in r.get("attempts") or ():
            body = f"Attempt: {a['action']}\nResult: {a['result']}\nSucceeded: {str(a['succeeded']).lower()}"
            word = "Successful" if a["succeeded"] else "Failed"
            about = {"succeeded": a["succeeded"], "goal": r["goal"], "attempt_result": a["result"]} | ({"error_fingerprint": a["fingerprint"]} if a.get("fingerprint") else {})
            made.append(scope | part(900) | {"kind": "outcome", "title": f"{word} attempt: {a['action']}", "body": body, "importance": 0.72 if a["succeeded"] else 0.78, "confidence": 0.88, "canonical_key": a.get("canonical_key"), "attributes": about})
        for t in r.get("open_tasks") or ():
            made.append(scope | part(850) | {"kind": "task", "title": f"Open task: {t}", "body": t, "importance": 0.68, "confidence": 0.90})
        view, rows = self.at(), {name: [] for name in TABLES}
        receipts, seq = view._planned([checked(m) for m in made], rows, view.watermark())
        rows["events"].append(self._event(checked(scope | {"content": r["goal"]}), "checkpoint", checked(scope | {"content": r["goal"]})["content"], seq + 1, _now()))
        receipt = {"episode_id": episode, "memory_ids": [x["memory_id"] for x in receipts], "first_seq": receipts[0]["seq"], "seq": seq + 1}
        rows["requests"] += self._ledger("checkpoint", r, receipt, seq + 1)
        self.append(rows, view.pinned)  # records, marker and receipt in one commit
        return receipt | {"replayed": False}

    def _before(self, request: dict) -> int | None:
        """Where the first run of a retried checkpoint began; null if this is the first."""
        own = (F.col("namespace") == request["namespace"]) & (F.col("operation") == "checkpoint") & (F.col("key") == request.get("idempotency_key"))
        found = self.table("requests").filter(own).first() if request.get("idempotency_key") else None
        return None if found is None else json.loads(found["receipt"])["first_seq"]

    def checkpoint_session(self, request: dict) -> dict:
        """A checkpoint whose attempts are the session's events since the last one, folded by what they ran.

        A failure that an earlier checkpoint left open counts as a run of its key, so a later success revises it.  A retry
        with the same idempotency key reads the log as it was before the first run, so it makes the same request.
        """
        if not request.get("session_id"):
            return self.checkpoint(request)
        before = self._before(request)
        scope = reduce(and_, (F.col(c).eqNullSafe(F.lit(request.get(c)).cast("string")) for c in OWN))
        log = self.table("events")
        events = log.filter(scope & (F.col("session_id") == request["session_id"]) & (F.lit(True) if before is None else F.col("seq") < before))
        prompt = F.coalesce((F.col("kind") == "conversation_turn") & (F.get_json_object("attributes", "$.role") == "user"), F.lit(False))
        a = F.col("attributes")
        told = L.session_slice(events, F.col("kind") == "checkpoint", prompt).withColumn("reason", L.promotion(F.col("kind"), a, F.col("content")))
        rows = told.filter(F.col("reason").isNotNull() | L.closes_failure(F.col("kind"), a))
        key = F.concat(F.lit("auto:attempt:"), L.canonical_key(L.group_identity(a, F.col("event_id")))).alias("key")
        tried = rows.select(F.lit(1).alias("scope"), "seq", key, F.col("content").alias("result"), L.succeeded(a).alias("succeeded"), "reason")
        named = rows.groupBy(key).agg(F.max_by(F.coalesce(F.get_json_object(a, "$.command"), "content"), "seq").alias("action"), F.max_by(F.get_json_object(a, "$.error_fingerprint"), "seq").alias("fingerprint"))
        revisions = self.table("revisions").filter(scope).join(log.select("event_id", "attributes"), "event_id")
        closed = self.table("facts").filter(F.col("state").isin("superseded", "retracted")).select("memory_id", "seq")
        failed = L.prior_failures(revisions, closed, before, tried.select(F.col("key").alias("canonical_key")).distinct())
        previous = failed.select(F.lit(1).alias("scope"), F.col("canonical_key").alias("key"), "result")
        attempts = [x.asDict() for x in L.coalesced(tried, previous=previous).join(named, "key").orderBy("key").collect()]  # of at most 128 events
        made = [{"action": x["action"], "result": x["result"], "succeeded": x["succeeded"], "fingerprint": x["fingerprint"], "canonical_key": x["key"]} for x in attempts]
        return self.checkpoint(request | {"attempts": [*(request.get("attempts") or ()), *made]})

    def give_feedback(self, memory_id: str, signal: str, scope: dict | None = None) -> None:
        if self.get(memory_id, scope) is None:
            raise ValueError("no such record")
        if signal not in S.POSITIVE_FEEDBACK + S.NEGATIVE_FEEDBACK:
            raise ValueError(f"unknown signal {signal}")
        self.append({"feedback": [(memory_id, signal, self.watermark())]})

    def retract(self, memory_id: str, reason: str = "", scope: dict | None = None) -> dict:
        head = self.get(memory_id, scope)
        if head is None:
            raise ValueError("no such record")
        view = self.at()
        seq, r = view.watermark() + 1, checked({c: head[c] for c in OWN} | {"content": reason})
        event = self._event(r, "memory_retracted", r["content"], seq, _now())
        self.append({"events": [event], "facts": [(memory_id, seq, "retracted")]}, view.pinned)
        return {"event_id": event[1], "seq": seq, "replayed": False}

    def register_profile(self, profile_id: str, model_digest: str, dimensions: int | None = None) -> None:
        old = self.profiles.filter(F.col("profile_id") == profile_id).first()
        if old is not None and (old["model_digest"], old["dimensions"]) != (model_digest, dimensions):
            raise Conflict("a profile does not change")
        if old is None:
            self.append({"profiles": [(profile_id, model_digest, dimensions, True, 0)]})

    def activate_profile(self, profile_id: str, active: bool) -> None:
        old = self.profiles.filter(F.col("profile_id") == profile_id).first()
        if old is None:
            raise ValueError("no such profile")
        last = self.table("profiles").filter(F.col("profile_id") == profile_id).agg(F.max("seq")).first()[0]
        self.append({"profiles": [(profile_id, old["model_digest"], old["dimensions"], active, last + 1)]})

    def pending(self, profile_id: str, limit: int = 100) -> DataFrame:
        """Records without a current projection of a profile, oldest first."""
        mine = self._projected().filter(F.col("profile") == profile_id).select("memory_id", "revision", "content_hash", F.coalesce("vector", F.array().cast("array<float>")).alias("vector"))
        return L.pending(self.heads, mine).orderBy("updated_seq", "memory_id").limit(min(1000, max(1, limit)))

    def register_projections(self, profile_id: str, inputs: list[dict]) -> dict[str, str]:
        """Status by record: stored, unchanged or stale; another value for the same revision is a conflict, and then nothing is written."""
        profile = self.profiles.filter(F.col("profile_id") == profile_id).first()
        if profile is None:
            raise ValueError("no such profile")
        if len(inputs) > 256:
            raise ValueError("more than 256 projections")
        ids = [x["memory_id"] for x in inputs]
        heads = {h["memory_id"]: h for h in self.heads.filter(F.col("memory_id").isin(*ids) & (F.col("state") != "retracted")).select("memory_id", "head_revision", "content_hash").collect()}
        old = {(p["memory_id"], p["revision"]): p for p in self._projected().filter((F.col("profile") == profile_id) & F.col("memory_id").isin(*ids)).collect()}
        out, rows, seq = {}, [], self.watermark()
        for x in inputs:
            vector, text = x.get("vector"), " ".join(X.redact_plain(t)[0] for t in x.get("expansions") or ())
            if vector is not None and (len(vector) != profile["dimensions"] or not all(map(math.isfinite, vector)) or not any(vector)):
                raise ValueError("a vector of another dimension, not finite or zero")
            head = heads.get(x["memory_id"])
            if head is None or (head["head_revision"], head["content_hash"]) != (x["revision"], x["content_hash"]):
                out[x["memory_id"]] = "stale"
                continue
            stored = old.get((x["memory_id"], x["revision"]))
            if stored is not None:
                import numpy as np

                if stored["expansions"] != text or (stored["vector"] is None) != (vector is None) or (vector is not None and not np.array_equal(np.float32(stored["vector"]), np.float32(vector))):
                    raise Conflict("another projection of the same revision is stored")
                out[x["memory_id"]] = "unchanged"
                continue
            rows.append((x["memory_id"], profile_id, x["revision"], x["content_hash"], text, None if vector is None else [float(v) + 0.0 for v in vector], seq))
            out[x["memory_id"]] = "stored"
        self.append({"projection_rows": rows})
        return out

    # reads

    def get(self, memory_id: str, scope: dict | None = None) -> dict | None:
        """A record's head; with a caller's scope (namespace, workspace_id, repo_id), one outside it is as good as none."""
        mine = F.col("memory_id") == memory_id
        if scope is not None:
            mine &= A.within(scope["namespace"], scope.get("workspace_id"), scope.get("repo_id"))
        head = self.heads.filter(mine).first()
        return None if head is None else head.asDict()

    def history(self, memory_id: str) -> dict:
        mine = F.col("memory_id") == memory_id
        revisions = L.history(self.table("revisions").filter(mine)).orderBy("revision").collect()
        links = self.table("links").filter((F.col("source_id") == memory_id) | (F.col("target_id") == memory_id)).orderBy("created_seq", "source_id", "target_id").collect()
        ids = self.table("evidence").filter(mine).select("event_id").union(self.table("revisions").filter(mine).select("event_id")).distinct()
        events = self.table("events").join(ids, "event_id", "left_semi").orderBy("seq").collect()
        return {"revisions": [r.asDict() for r in revisions], "links": [r.asDict() for r in links], "events": [r.asDict() for r in events]}

    def status(self) -> dict:
        states = {r[0]: r[1] for r in self.heads.groupBy("state").count().collect()}
        return {"states": states, "events": self.table("events").count(), "watermark": self.watermark()}

    def artifact_status(self, namespace: str, workspace_id: str | None = None, repo_id: str | None = None, branch: str | None = None) -> dict:
        """How well the kept fingerprints of the artifacts of one scope's current revisions are in order."""
        scope = reduce(and_, (F.col(c).eqNullSafe(F.lit(v).cast("string")) for c, v in zip(OWN, (namespace, workspace_id, repo_id, branch))))
        own = self.heads.filter(scope & (F.col("state") != "retracted")).select("memory_id", F.col("head_revision").alias("revision"))
        return L.artifact_coverage(self.memory_artifacts.join(own, ["memory_id", "revision"], "left_semi"), self.artifacts, self.kept_fingerprints).first().asDict()

    @property
    def kept_fingerprints(self) -> DataFrame:
        rows = self.table("fingerprint_rows").groupBy("artifact_id").agg(F.max_by(F.struct("identity", "content"), "seq").alias("f"))
        return rows.select("artifact_id", "f.*")

    def repair_fingerprints(self) -> int:
        """Write the fingerprints of artifacts that have none or another one; how many."""
        view = self.at()
        due = view.artifacts.select("artifact_id", *L.fingerprint(F.col("repo_id"), F.col("path"), F.col("symbol"), F.col("stored_hash"))).distinct()
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("artifact_id", "identity", "content")]
        late = staged(due.alias("a").join(view.kept_fingerprints.alias("b"), same, "left_anti").withColumn("seq", F.lit(view.pinned.version + 1).cast("long")), "fingerprints")
        if n := late.count():
            self.bulk({"fingerprint_rows": late}, view.pinned)
        return n

    def coverage(self) -> dict:
        return L.coverage(self.heads, self.projections).first().asDict()

    def current_hashes(self, references: DataFrame, artifacts: DataFrame, repo_id: str, root: str) -> DataFrame:
        """repo_id, path, symbol, content_hash of files under ``root`` now: of the references (memory_id, candidate_rank, artifact_id) 128 paths, round robin over the records."""
        mine = artifacts.filter((F.col("repo_id") == repo_id) & F.col("stored_hash").isNotNull())
        asked = L.round_robin(references.join(mine.select("artifact_id", "path"), "artifact_id"))
        paths = [r[0] for r in asked.select("path").distinct().collect()]  # 128 at most
        inside = [p for p in paths if files.inside(root, p)]
        return files.hashed(self.spark, root, inside).join(mine.select("repo_id", "path", "symbol").distinct(), "path").select("repo_id", "path", "symbol", F.col("current_hash").alias("content_hash"), F.lit(0).alias("place"))

    def recall(self, request: R.Request, dirty_hash: str | None = None, root: str | None = None) -> dict:
        """Hits in order of diversity with their packed bodies, and the rendered text.

        ``request.artifacts`` gives current hashes by (repo_id, path, symbol); with the ``root`` of the caller's working
        tree, those of the candidates' files are looked up too.
        """
        return self.hydrate(self.stage_recall(request, dirty_hash, root))

    def stage_recall(self, request: R.Request, dirty_hash: str | None = None, root: str | None = None) -> Recalled:
        """The first step of a recall: the chosen revisions with their states, scores and the first characters of their bodies, as of one version."""
        if self.indexed and self.pinned is None:
            self.refresh()
        view = self.at()
        found = R.candidates(R.channels(view, request, generated=True))
        heads = staged(view.heads.join(found, "memory_id").withColumn("body", F.substring("body", 1, S.PREVIEW_CHARS)), "heads")  # 1,024 candidates
        pairs = heads.filter("head_commit is not null").select(F.col("head_commit").alias("stored"), F.lit(request.head_commit).cast("string").alias("current"))
        told = A.relation(pairs, view.commits).select(F.col("stored").alias("head_commit"), "relation") if request.head_commit is not None else self.spark.createDataFrame([], "head_commit string, relation string")
        used, artifacts = view.memory_artifacts.join(heads.select("memory_id", F.col("head_revision").alias("revision")), ["memory_id", "revision"], "left_semi"), view.artifacts
        if root is not None and request.repo_id is not None:
            order = Window.orderBy(F.col("base").desc(), "memory_id")  # of 1,024 candidates
            ranked = used.join(heads.select("memory_id", F.row_number().over(order).alias("candidate_rank")), "memory_id").drop("revision")
            artifacts = A.hinted(artifacts, view.current_hashes(ranked, artifacts, request.repo_id, root))
        if request.artifacts:
            given = [(*key, value, place) for place, (key, value) in enumerate(request.artifacts.items())]
            artifacts = A.hinted(artifacts, self.spark.createDataFrame(given, "repo_id string, path string, symbol string, content_hash string, place int"))
        state = A.artifact_state(used, artifacts)
        rows = heads.join(state, "memory_id", "left").join(told, "head_commit", "left").withColumn("applicability", A.classified(request.namespace, request.workspace_id, request.repo_id, request.branch, dirty_hash))
        hidden = ["inapplicable", *(() if request.include_stale else ("stale",)), *(() if request.include_divergent else ("divergent",))]
        rows = R.scored(R.with_verified(rows).join(R.utility(view.feedback), "memory_id", "left").filter(~F.col("applicability").isin(*hidden)), request.as_of_ms)
        limit, budget = request.bounded()
        pool = {r["memory_id"]: r.asDict() for r in rows.orderBy(F.col("score").desc(), "memory_id").limit(R.pool_size(limit)).withColumnRenamed("head_revision", "revision").collect()}  # 512 at most, with previews
        order = selection.diverse([(k, r["score"], f"{r['title']} {r['body']}") for k, r in pool.items()], limit)
        return Recalled(view.pinned, [pool[k] for k in order], budget)

    def hydrate(self, found: Recalled) -> dict:
        """The second step: the bodies of the chosen revisions, those of the first step's version whatever was written since, packed into the budget."""
        view = Store(self.spark, self.path, found.manifest)
        pinned = self.spark.createDataFrame([(h["memory_id"], h["revision"]) for h in found.hits], "memory_id string, revision long")  # 100 at most
        rows = view.table("revisions").join(F.broadcast(pinned), ["memory_id", "revision"]).select("memory_id", F.substring("body", 1, 3 * found.budget + 1).alias("body"))
        bodies = {r["memory_id"]: r["body"] for r in rows.collect()}
        hits, text, tokens = selection.packed([h | {"body": bodies[h["memory_id"]]} for h in found.hits], found.budget)
        return {"hits": hits, "rendered": text, "tokens": tokens, "watermark": view.watermark(), "version": found.manifest.version}

    # snapshots

    def inspect(self) -> dict:
        """Without a write: what sets each written table's schema apart from the model's, and the counts of broken invariants."""
        m, schemas = self.manifest(), {}
        for name in TABLES:
            if entries := m.entries(name):
                found = self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/{e['path']}" for e in entries)).schema
                if differ := snapshot.differences(found, T.StructType.fromDDL(TABLES[name])):
                    schemas[name] = differ
        broken = L.violations(self.heads, self.table("revisions"), self.table("links")).collect()  # a row a check
        return {"schemas": schemas, "violations": {r["check"]: r["findings"] for r in broken}}

    def purge(self) -> None:
        """Delete the store's data and versions, and nothing else under its path."""
        for name in ("manifests", "data", "index"):
            remove(self.spark, f"{self.path}/{name}")

    def export(self, path: str) -> None:
        snapshot.export({name: self.table(name) for name in TABLES}, path)

    def load(self, path: str) -> None:
        """Fill an empty store from a snapshot in one commit, all of it or nothing."""
        base = self.versions.manifest()
        if any(base.entries(name) for name in TABLES):
            raise Conflict("the store is not empty")
        self.bulk(snapshot.load(self.spark, path, {name: T.StructType.fromDDL(TABLES[name]) for name in TABLES}), base)


_INDEXES = {
    "text": ("memory_id", "string", R.TEXT_FIELDS),
    "aliases": ("memory_id", "string", ("aliases",)),
    "expansions": ("row", "struct<memory_id: string, profile: string>", ("expansions",)),
}


class _Part:
    """The tables of some of a store's records, as the index reads them."""

    def __init__(self, store: Store, ids: DataFrame) -> None:
        own = lambda df: df.join(ids, "memory_id", "left_semi")
        self.heads, self.tags, self.entities, self.memory_artifacts, self.artifacts = own(store.heads), own(store.tags), own(store.entities), own(store.memory_artifacts), store.artifacts


@dataclass(frozen=True)
class Recalled:
    """What the first step of a recall chose, and the version that it saw."""

    manifest: Manifest
    hits: list[dict]
    budget: int


def _now() -> int:
    return int(time.time() * 1000)
