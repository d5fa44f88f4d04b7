"""Append-only logs and the views derived from them: revisions, life cycle, sessions, attempts, projections, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom import schemas as S
from strataloom.functions import text as X


def history(revisions: DataFrame) -> DataFrame:
    """Each revision with the time at which the next one retires it."""
    line = Window.partitionBy("memory_id").orderBy("revision")
    return revisions.withColumn("retired_at_ms", F.lead("recorded_at_ms").over(line)).withColumn("is_head", F.lead("revision").over(line).isNull())


def as_of(revisions: DataFrame, boundary: Column) -> DataFrame:
    """The latest revision of each record that was recorded before a boundary; a grouped maximum, so no sort."""
    before = revisions.filter(F.col("recorded_seq") < boundary)
    latest = before.groupBy("memory_id").agg(F.max_by(F.struct("revision", "recorded_seq", "body"), F.struct("recorded_seq", "revision")).alias("r"))
    return latest.select("memory_id", "r.revision", "r.recorded_seq", "r.body")


def canonical(heads: DataFrame) -> DataFrame:
    """The newest open record of each scope, kind and canonical key."""
    keys = ["namespace", "repo_id", "workspace_id", "kind", "canonical_key"]
    live = heads.filter(F.col("state").isin("active", "contested") & F.col("canonical_key").isNotNull())
    return live.groupBy(*keys).agg(F.max_by("memory_id", F.struct("updated_seq", "memory_id")).alias("memory_id"))


def pending(heads: DataFrame, projections: DataFrame, least_seq: int = 0) -> DataFrame:
    """Records without a current projection that has a vector."""
    current = projections.filter("vector is not null").select("memory_id", F.col("revision").alias("head_revision"), "content_hash")
    return heads.filter(F.col("state") != "retracted").join(current, ["memory_id", "head_revision", "content_hash"], "left_anti")


def coverage(heads: DataFrame, projections: DataFrame) -> DataFrame:
    """One row: eligible, indexed, pending and stale records."""
    own = projections.select("memory_id", "revision", F.col("content_hash").alias("hash"), F.col("vector").isNotNull().alias("has"))
    rows = heads.filter(F.col("state") != "retracted").join(own, "memory_id", "left")
    current = F.coalesce((F.col("revision") == F.col("head_revision")) & (F.col("hash") == F.col("content_hash")), F.lit(False))
    done = current & F.coalesce("has", F.lit(False))
    return rows.agg(
        F.count("*").alias("eligible"), F.count_if(done).alias("indexed"), F.count_if(~done).alias("pending"), F.count_if(F.col("revision").isNotNull() & ~current).alias("stale")
    )


def state_after(heads: DataFrame, links: DataFrame) -> DataFrame:
    """memory_id, before, after: links applied in order of their sequence, so the last fact of a record counts; superseded and retracted records don't change.

    A superseding link closes its target; a contesting one contests both its ends, if they are active.
    """
    closes = links.filter("relation = 'supersedes'").select(F.col("target_id").alias("memory_id"), F.lit(2).alias("rank"), F.lit("superseded").alias("to"))
    contest = links.filter("relation = 'contests'")
    contests = contest.select(F.col("target_id").alias("memory_id"), F.lit(1).alias("rank"), F.lit("contested").alias("to")).unionByName(contest.select(F.col("source_id").alias("memory_id"), F.lit(1).alias("rank"), F.lit("contested").alias("to")))
    facts = closes.unionByName(contests).groupBy("memory_id").agg(F.max_by("to", "rank").alias("to"))
    out = heads.join(facts, "memory_id", "left")
    after = F.when(F.col("state").isin("active", "contested"), F.coalesce("to", "state")).otherwise(F.col("state"))
    return out.select("memory_id", F.col("state").alias("before"), after.alias("after"))


def not_superseded_before(heads: DataFrame, links: DataFrame, boundary: int) -> DataFrame:
    """Records without a superseding link made before a boundary."""
    gone = links.filter((F.col("relation") == "supersedes") & (F.col("created_seq") < boundary)).select(F.col("target_id").alias("memory_id"))
    return heads.join(gone, "memory_id", "left_anti")


def json_bool(attributes: Column, name: str) -> Column:
    return F.get_json_object(attributes, f"$.{name}") == "true"


def succeeded(attributes: Column) -> Column:
    """What the event says, else that it is no error, else that its exit code is 0, else true."""
    code = F.get_json_object(attributes, "$.exit_code").cast("long")
    return F.coalesce(json_bool(attributes, "succeeded"), ~json_bool(attributes, "is_error"), code == 0, F.lit(True))


def promotion(kind: Column, attributes: Column, content: Column) -> Column:
    """Why an event becomes a record: verification, failed_execution or explicit_salience; null: it does not."""
    command = F.get_json_object(attributes, "$.command")
    words = F.split(F.trim(command), r"\s+")
    tool = F.element_at(F.split(F.get(words, F.lit(0)), r"[/\\]"), -1)
    probe = tool.isin("rg", "grep") | ((tool == "git") & (F.get(words, F.lit(1)) == "diff") & F.array_contains(words, "--quiet"))
    told = X.ascii_lower(content).rlike("error:|fatal:|panic|exception|traceback|segmentation fault")
    neutral = F.coalesce((kind == "command_result") & (F.get_json_object(attributes, "$.exit_code").cast("long") == 1) & probe & ~told, F.lit(False))
    verification = (kind == "verification") | F.coalesce(json_bool(attributes, "verification"), F.lit(False))
    failed = ~succeeded(attributes) & kind.isin("command_result", "tool_result", "verification") & ~neutral
    salient = F.coalesce(json_bool(attributes, "memory_salient"), F.lit(False))
    return F.when(verification, "verification").when(failed, "failed_execution").when(salient, "explicit_salience")


def session_slice(events: DataFrame, boundary: Column, inclusive: Column, limit: int = S.SESSION_EVENTS) -> DataFrame:
    """Each session's newest events, at most ``limit``, back to the last event where ``boundary`` is true: without it, or with it where ``inclusive`` is true.

    Two windows over one partitioning, so one shuffle.
    """
    back = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    rows = events.withColumn("boundary", boundary).withColumn("inclusive", inclusive).withColumn("back", F.row_number().over(back)).filter(F.col("back") <= limit)
    passed = F.sum(F.when(F.col("boundary") | F.col("inclusive"), 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("passed", passed)
    return rows.filter((F.col("passed") == 0) | ((F.col("passed") == 1) & F.col("inclusive") & ~F.col("boundary"))).drop("boundary", "inclusive", "passed")


def group_identity(attributes: Column, event_id: Column) -> Column:
    """What equal attempts have in common: their command, or a failure's fingerprint, or nothing but themselves."""
    command, print_ = F.get_json_object(attributes, "$.command"), F.get_json_object(attributes, "$.error_fingerprint")
    return F.when(F.trim(command) != "", F.concat(F.lit("command:"), command)).when(~succeeded(attributes) & print_.isNotNull(), F.concat(F.lit("diagnostic:"), print_)).otherwise(F.concat(F.lit("event:"), event_id.cast("string")))


def canonical_key(identity: Column) -> Column:
    return F.sha2(F.regexp_replace(F.trim(identity), r"\s+", " "), 256)


def prior_failures(revisions: DataFrame, closed: DataFrame, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """canonical_key, result: each key's newest failure among outcomes that are open and whose latest revision has the key and failed.

    ``revisions``: (memory_id, revision, recorded_seq, kind, canonical_key, attributes, body) of one scope; ``closed``:
    (memory_id, seq) of what retired or superseded a record.  With ``before``, as it was just before that sequence
    number.  ``keys`` (canonical_key) are the ones asked for: only records that ever had one of them are folded.
    """
    if before is not None:
        revisions, closed = revisions.filter(F.col("recorded_seq") < before), closed.filter(F.col("seq") < before)
    if keys is not None:
        revisions = revisions.join(revisions.join(keys, "canonical_key", "left_semi").select("memory_id").distinct(), "memory_id", "left_semi")
    latest = revisions.groupBy("memory_id").agg(F.max_by(F.struct("revision", "recorded_seq", "kind", "canonical_key", "attributes", "body"), F.struct("recorded_seq", "revision")).alias("r"))
    rows = latest.select("memory_id", "r.*").filter((F.col("kind") == "outcome") & F.col("canonical_key").isNotNull() & (F.get_json_object("attributes", "$.succeeded") == "false"))
    if keys is not None:
        rows = rows.join(keys, "canonical_key", "left_semi")
    form = r"(?s)^Attempt: .*?\nResult: (.*)\nSucceeded: "
    told = F.coalesce(F.get_json_object("attributes", "$.attempt_result"), F.when(F.col("body").rlike(form), F.regexp_extract("body", form, 1)), F.col("body"))
    live = rows.join(closed.select("memory_id"), "memory_id", "left_anti")
    return live.groupBy("canonical_key").agg(F.min_by(told, F.struct(-F.col("recorded_seq"), -F.col("revision"), "memory_id")).alias("result"))


def closes_failure(kind: Column, attributes: Column) -> Column:
    """Whether an event that is not promoted by itself is a success that ends an earlier failure of the same command."""
    command = F.coalesce(F.trim(F.get_json_object(attributes, "$.command")), F.lit(""))
    return succeeded(attributes) & kind.isin("command_result", "tool_result", "verification") & (command != "")


def attempts_folded(attempts: DataFrame) -> DataFrame:
    """Attempts (scope, seq, key, result, succeeded, reason) as one row a scope and key: the last outcome, the first failure and the number of runs."""
    rank = F.when(F.col("reason") == "verification", 3).when(F.col("reason") == "explicit_salience", 2).when(F.col("reason") == "failed_execution", 1).otherwise(0)
    return attempts.groupBy("scope", "key").agg(
        F.max_by("result", "seq").alias("final_result"),
        F.max_by("succeeded", "seq").alias("final_succeeded"),
        F.min_by(F.when(~F.col("succeeded"), F.col("result")), F.when(~F.col("succeeded"), F.col("seq"))).alias("first_failure"),
        F.max("seq").alias("last_order"),
        F.count("*").alias("runs"),
        F.max_by("reason", F.struct(rank, "seq")).alias("reason"),
    )


def attempts_told(folded: DataFrame, verifications: int = 4, salient: int = 4) -> DataFrame:
    """Folded attempts with the text that a record of them has: all keys that ever failed, and of the others the newest few of either reason."""
    text = (
        F.when(F.col("runs") == 1, F.col("final_result"))
        .when(F.col("first_failure").isNotNull() & F.col("final_succeeded"), F.concat(F.lit("First failure: "), "first_failure", F.lit("\nFinal result: "), "final_result", F.lit("\nObserved runs: "), F.col("runs").cast("string")))
        .when(F.col("first_failure") != F.col("final_result"), F.concat(F.lit("First failure: "), "first_failure", F.lit("\nLatest failure: "), "final_result", F.lit("\nObserved runs: "), F.col("runs").cast("string")))
        .otherwise(F.concat("final_result", F.lit("\nObserved equivalent runs: "), F.col("runs").cast("string")))
    )
    failed = F.col("first_failure").isNotNull() | ~F.col("final_succeeded")
    place = F.row_number().over(Window.partitionBy("scope", failed, "reason").orderBy(F.col("last_order").desc(), "key"))
    keep = failed | ((F.col("reason") == "verification") & (F.col("place") <= verifications)) | ((F.col("reason") == "explicit_salience") & (F.col("place") <= salient))
    return folded.withColumn("place", place).filter(keep).select("scope", "key", text.alias("result"), F.col("final_succeeded").alias("succeeded"), "runs", F.coalesce("reason", F.lit("failed_execution")).alias("reason"))


def coalesced(attempts: DataFrame, verifications: int = 4, salient: int = 4, previous: DataFrame | None = None) -> DataFrame:
    """Attempts folded by key and told.  A failure that is known from before (``previous``: scope, key, result) is the first one of its key and counts as a run."""
    folded = attempts_folded(attempts)
    if previous is not None:
        folded = folded.join(previous.select("scope", "key", F.col("result").alias("earlier")), ["scope", "key"], "left")
        folded = folded.withColumn("first_failure", F.coalesce("earlier", "first_failure")).withColumn("runs", F.col("runs") + F.col("earlier").isNotNull().cast("int"))
    return attempts_told(folded, verifications, salient)


def session_attempts(events: DataFrame, limit: int = S.SESSION_EVENTS) -> DataFrame:
    """session_id, checkpoint_seq and the attempts (scope, seq, key, result, succeeded, reason) that each checkpoint folds: of the session's events since the checkpoint before, or since the last user prompt, the newest ``limit`` that count.

    ``events``: (session_id, seq, event_id, kind, content, attributes).
    """
    a = F.col("attributes")
    rows = events.select("session_id", "seq", *session_facts(F.col("kind"), a, F.col("content"), F.col("event_id")))
    line = Window.partitionBy("session_id").orderBy("seq")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", F.coalesce(F.sum(F.col("marker").cast("int")).over(before), F.lit(0)))
    ends = F.max(F.when(F.col("marker"), F.col("seq"))).over(Window.partitionBy("session_id", "part"))
    rows = rows.withColumn("checkpoint_seq", ends).filter("checkpoint_seq is not null and not marker")
    back = Window.partitionBy("session_id", "part").orderBy(F.col("seq").desc())
    rows = rows.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= limit)
    prompts = F.sum(F.col("prompt").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("prompts", prompts).filter("counts and (prompts = 0 or prompts = 1 and prompt)")
    return rows.select(F.struct("session_id", "checkpoint_seq").alias("scope"), "seq", "key", "result", "succeeded", "reason")


def session_facts(kind: Column, attributes: Column, content: Column, event_id: Column) -> list[Column]:
    """What the fold of a session reads of an event: marker, prompt, counts, key, result, succeeded, reason."""
    reason = promotion(kind, attributes, content)
    prompt = F.coalesce((kind == "conversation_turn") & (F.get_json_object(attributes, "$.role") == "user"), F.lit(False))
    facts = {"marker": kind == "checkpoint", "prompt": prompt, "counts": reason.isNotNull() | closes_failure(kind, attributes), "key": canonical_key(group_identity(attributes, event_id))}
    facts |= {"result": content, "succeeded": succeeded(attributes), "reason": reason}
    return [column.alias(name) for name, column in facts.items()]


def checkpoint_records(checkpoints: DataFrame) -> DataFrame:
    """The records that a checkpoint (id, goal, decisions, attempts, tasks) makes, each with its fixed scores and its link's weight."""
    part = lambda name, kind, importance, confidence, weight: checkpoints.select(
        "id", F.posexplode(name).alias("place", "body"), F.lit(kind).alias("kind"), F.lit(importance).alias("importance"), F.lit(confidence).alias("confidence"), F.lit(weight).alias("weight")
    )
    episode = checkpoints.select("id", F.lit(0).alias("place"), F.col("goal").alias("body"), F.lit("episode").alias("kind"), F.lit(0.72).alias("importance"), F.lit(0.65).alias("confidence"), F.lit(0).alias("weight"))
    return episode.unionByName(part("decisions", "decision", 0.82, 0.80, 900)).unionByName(part("attempts", "outcome", 0.78, 0.88, 900)).unionByName(part("tasks", "task", 0.68, 0.90, 850))


def ledger_status(requests: DataFrame) -> DataFrame:
    """Idempotent requests (namespace, operation, key, request_hash, seq): the first of a key is applied, equal ones replay it, others conflict."""
    line = Window.partitionBy("namespace", "operation", "key").orderBy("seq")
    first = F.first("request_hash").over(line)
    status = F.when(F.row_number().over(line) == 1, "applied").when(F.col("request_hash") == first, "replayed").otherwise("conflict")
    return requests.withColumn("status", status)


def round_robin(references: DataFrame, most: int = 128) -> DataFrame:
    """Paths to read again, taking turns between candidates: each candidate's first path, then each one's second, and so on.

    ``references``: (memory_id, candidate_rank, path, artifact_id).  A path wanted by several counts for the first.
    """
    own = Window.partitionBy("memory_id").orderBy("path", "artifact_id")
    least = references.groupBy("memory_id", "candidate_rank", "path").agg(F.min("artifact_id").alias("artifact_id")).withColumn("priority", F.row_number().over(own))
    once = Window.partitionBy("path").orderBy("priority", "candidate_rank", "memory_id", "artifact_id")
    return least.withColumn("n", F.row_number().over(once)).filter("n = 1").drop("n").orderBy("priority", "candidate_rank", "path").limit(most)


def fingerprint(repo: Column, path: Column, symbol: Column, content_hash: Column) -> list[Column]:
    """identity and content of an artifact's fingerprint: framed hashes of what names it and of its content's hash; both null where it has no hash."""
    hashed = F.coalesce(content_hash, F.lit("")) != ""
    name = F.substring(X.framed_key(F.lit("artifact"), repo, path, symbol, prefix="-"), 2, 64)
    content = F.substring(X.framed_key(F.lit("content"), content_hash, prefix="-"), 2, 64)
    return [F.when(hashed, name).alias("identity"), F.when(hashed, content).alias("content")]


def artifact_coverage(references: DataFrame, artifacts: DataFrame, projected: DataFrame) -> DataFrame:
    """One row of nine counters over the distinct artifacts of ``references`` (artifact_id): referenced, canonical, projected, valid, missing, corrupt, orphaned, unverifiable, and degraded.

    ``artifacts``: (artifact_id, repo_id, path, symbol, stored_hash); ``projected``: (artifact_id, identity, content), the
    kept fingerprints.  A fingerprint is valid if it is the one that the artifact gives; an artifact without a hash has an
    empty one.  A reference without an artifact is orphaned and nothing else but perhaps projected.
    """
    wanted = artifacts.select("artifact_id", F.lit(True).alias("known"), F.coalesce("stored_hash", F.lit("")).alias("hash"), F.struct(*fingerprint(F.col("repo_id"), F.col("path"), F.col("symbol"), F.col("stored_hash"))).alias("due"))
    kept = projected.select("artifact_id", F.struct("identity", "content").alias("kept"))
    rows = references.select("artifact_id").distinct().join(wanted, "artifact_id", "left").join(kept, "artifact_id", "left")
    known, has = F.col("known").isNotNull(), F.col("kept").isNotNull()
    same = F.col("kept.identity").eqNullSafe(F.col("due.identity")) & F.col("kept.content").eqNullSafe(F.col("due.content"))
    counts = {"referenced": F.lit(True), "canonical": known, "projected": has, "valid": known & has & same, "missing": known & ~has, "corrupt": known & has & ~same, "orphaned": ~known, "unverifiable": known & (F.col("hash") == "")}
    out = rows.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))
    return out.withColumn("degraded", (F.col("missing") > 0) | (F.col("corrupt") > 0) | (F.col("orphaned") > 0))


def violations(heads: DataFrame, revisions: DataFrame, links: DataFrame) -> DataFrame:
    """check, findings: broken invariants of the model, each an anti join."""
    latest = revisions.groupBy("memory_id").agg(F.max("revision").alias("latest"))
    checks = {
        "head_without_revision": heads.join(revisions.select("memory_id", F.col("revision").alias("head_revision")), ["memory_id", "head_revision"], "left_anti"),
        "head_not_latest": heads.join(latest, "memory_id").filter("head_revision < latest"),
        "revision_without_head": revisions.join(heads.select("memory_id"), "memory_id", "left_anti"),
        "link_without_target": links.join(heads.select(F.col("memory_id").alias("target_id")), "target_id", "left_anti"),
    }
    parts = [df.agg(F.count("*").alias("findings")).select(F.lit(name).alias("check"), "findings") for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
