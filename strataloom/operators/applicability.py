"""How records of one state of a repository apply to another.

``relation`` (of ``history``) compares commits by what they descend from;
``artifact_state`` compares stored and current hashes; ``classified`` is the decision table over joined
columns, one expression without shuffles of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.history import relation as relation


def within(namespace: str, workspace_id: str | None, repo_id: str | None) -> Column:
    """Whether a record is open to a caller who names it by its id: the same namespace, and the same workspace and repository where it has any."""
    own = lambda name, v: F.col(name).isNull() | F.col(name).eqNullSafe(F.lit(v).cast("string"))
    return F.col("namespace").eqNullSafe(F.lit(namespace)) & own("workspace_id", workspace_id) & own("repo_id", repo_id)


#: Stored hashes of a record that are compared; a record with more can be proved changed, but not unchanged.
MOST_HASHES = 128


def hinted(artifacts: DataFrame, hints: DataFrame, repo: str = "repo_id") -> DataFrame:
    """``artifacts`` with the current hash that a caller gives for the same repository, path and symbol, which goes before one that was looked up.

    ``hints``: those, content_hash and place; of hints for the same one the first by place counts, also where it has no hash.
    """
    first = F.min_by(F.struct("content_hash"), "place").alias("_given")
    given = hints.groupBy(F.col(repo).alias("_repo"), F.col("path").alias("_path"), F.col("symbol").alias("_symbol")).agg(first)
    same = (F.col(repo) == F.col("_repo")) & (F.col("path") == F.col("_path")) & F.col("symbol").eqNullSafe(F.col("_symbol"))
    current = F.when(F.col("_given").isNotNull(), F.col("_given.content_hash")).otherwise(F.col("current_hash"))
    return artifacts.join(given, same, "left").withColumn("current_hash", current).select(*artifacts.columns)


def artifact_state(references: DataFrame, artifacts: DataFrame, most: int = MOST_HASHES) -> DataFrame:
    """memory_id, changed, verified and complete: whether a stored hash differs from the current one; whether there are stored ones and all equal theirs; whether none was left out.

    Artifacts without a stored hash say nothing.  One that is referred to but not known, or more than ``most`` stored hashes, leave the set incomplete.
    """
    rows = references.join(artifacts.select("artifact_id", "stored_hash", "current_hash", F.lit(True).alias("known")), "artifact_id", "left")
    has, same = F.col("stored_hash").isNotNull(), F.col("stored_hash") == F.col("current_hash")
    counted = rows.groupBy("memory_id").agg(
        F.count_if(has & ~same).alias("differ"), F.count_if(same).alias("equal"), F.count_if(has).alias("stored"), F.count_if(F.col("known").isNull()).alias("unknown"),
    )
    complete = (F.col("unknown") == 0) & (F.col("stored") <= most)
    verified = complete & (F.col("stored") > 0) & (F.col("equal") == F.col("stored"))
    return counted.select("memory_id", (F.col("differ") > 0).alias("changed"), verified.alias("verified"), complete.alias("complete"))


def classified(namespace: str, workspace_id: str | None, repo_id: str | None, branch: str | None, dirty_hash: str | None = None) -> Column:
    """The applicability of rows with the records' scope columns, changed, verified, complete and relation to a caller's state."""
    caller = lambda v: F.lit(v).cast("string")
    workspace, repo, dirty = caller(workspace_id), caller(repo_id), caller(dirty_hash)
    changed, verified, complete = (F.coalesce(c, F.lit(d)) for c, d in (("changed", False), ("verified", False), ("complete", True)))
    return (
        F.when(F.col("namespace") != namespace, "inapplicable")
        .when(F.col("workspace_id").isNotNull() & ~F.col("workspace_id").eqNullSafe(workspace), "inapplicable")
        .when(F.col("repo_id").isNotNull() & repo.isNull(), "inapplicable")
        .when(F.col("repo_id").isNull() | repo.isNull(), "unversioned")
        .when(F.col("repo_id") != repo, "inapplicable")
        .when(changed, "stale")
        .when(~F.col("dirty_hash").eqNullSafe(dirty), F.when(verified, "exact").otherwise("stale"))
        .when(verified, "exact")
        .when(F.col("relation") == "same", F.when(complete, "exact").otherwise("unversioned"))  # the same commit proves nothing about hashes that were left out
        .when(F.col("relation") == "ancestor", "compatible")
        .when(F.col("relation").isin("descendant", "diverged"), "divergent")
        .when(F.col("relation") == "unknown", "unversioned")
        .when(F.coalesce(F.col("branch") != caller(branch), F.lit(False)), "divergent")
        .otherwise("unversioned")
    )
