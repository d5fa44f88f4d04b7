"""Snapshots of format 1, in which a record's metadata is its head's alone and links don't name a revision, as the present tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a revision takes from its head, as nothing older was kept.
FROM_HEAD = ("namespace", "workspace_id", "repo_id", "branch", "head_commit", "dirty_hash", "kind", "canonical_key", "importance", "confidence", "trust", "valid_from_ms", "valid_until_ms", "expires_at_ms")
#: The tables of format 1 that differ from the present ones.
TABLES = {
    "heads": "memory_id string, head_revision long, updated_seq long, state string, namespace string, workspace_id string, repo_id string, branch string, head_commit string, dirty_hash string, kind string, canonical_key string, importance float, confidence float, trust string, valid_from_ms long, valid_until_ms long, expires_at_ms long",
    "revisions": "memory_id string, revision long, recorded_seq long, recorded_at_ms long, title string, body string, content_hash string, event_id string",
    "links": "source_id string, target_id string, relation string, weight int, created_event_id string",
}


def revisions(old: DataFrame, heads: DataFrame) -> DataFrame:
    """Revisions with the metadata of their record's head; it is complete only for the one that the head was written with."""
    own = [c for c in FROM_HEAD if c in heads.columns]
    rows = old.join(heads.select("memory_id", "head_revision", "updated_seq", *own), "memory_id")
    complete = F.col("revision").eqNullSafe(F.col("head_revision")) & F.col("recorded_seq").eqNullSafe(F.col("updated_seq"))
    return rows.withColumn("metadata_complete", complete).drop("head_revision", "updated_seq")


def links(old: DataFrame, events: DataFrame, old_revisions: DataFrame) -> DataFrame:
    """Links with the sequence number of the event that made them, if it is known, and the revision of their source that the same event recorded, if any."""
    made = old.join(events.select(F.col("event_id").alias("created_event_id"), F.col("seq").alias("created_seq")), "created_event_id", "left")
    own = old_revisions.select(F.col("memory_id").alias("source_id"), F.col("recorded_seq").alias("created_seq"), F.col("revision").alias("source_revision"))
    return made.join(own, ["source_id", "created_seq"], "left").drop("created_event_id")


def upgraded(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a format-1 snapshot in the present form: states become facts of the record's last change."""
    heads, out = tables["heads"], {n: df for n, df in tables.items() if n != "heads"}
    out["revisions"] = revisions(tables["revisions"], heads)
    if "links" in tables:
        out["links"] = links(tables["links"], tables["events"], tables["revisions"])
    states = heads.filter("state != 'active'").select("memory_id", F.col("updated_seq").alias("seq"), "state")
    out["facts"] = states if "facts" not in tables else states.unionByName(tables["facts"])
    return out
