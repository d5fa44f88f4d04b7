"""Files and commits of a working tree as tables.

Hashing reads files with Spark's binary source, so any store that Spark reads
will do; git itself is asked on the driver.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions.text import language_of

#: More changed files or bytes than these give no capture at all.
MOST_FILES, MOST_BYTES = 128, 64 << 20


def git(root: str, *args: str, timeout: float = 2.0) -> str | None:
    """What git prints, or null where it fails or takes too long."""
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def discover(path: str) -> dict | None:
    """Root, branch, head, remote and whether there are changes; null outside a repository."""
    root = git(path, "rev-parse", "--show-toplevel")
    if root is None:
        return None
    root = root.strip()
    first = lambda *a: (git(root, *a) or "").strip() or None
    return {"root": root, "branch": first("symbolic-ref", "--short", "-q", "HEAD"), "head": first("rev-parse", "-q", "--verify", "HEAD"), "remote": first("config", "--get", "remote.origin.url"), "dirty": bool(first("status", "--porcelain"))}


def commits(spark: SparkSession, root: str, timeout: float = 30.0) -> DataFrame:
    """commit_id, parent_id of all commits that branches and tags reach."""
    lines = (git(root, "rev-list", "--all", "--parents", timeout=timeout) or "").split("\n")
    pairs = [(child, parent) for child, *parents in map(str.split, filter(None, lines)) for parent in parents]
    return spark.createDataFrame(pairs, "commit_id string, parent_id string")


def changed_paths(root: str) -> list[str]:
    """Paths that differ from HEAD, in the index, the tree or untracked; sorted, each once."""
    listings = (("diff", "--name-only", "-z", "HEAD"), ("diff", "--name-only", "-z", "--cached"), ("ls-files", "-z", "--others", "--exclude-standard"))
    return sorted({p for a in listings for p in (git(root, *a) or "").split("\0") if p})


def inside(root: str, path: str) -> bool:
    """Whether a relative path stays under the root, links followed."""
    own = Path(root).resolve()
    return not Path(path).is_absolute() and Path(root, path).resolve().is_relative_to(own)


def hashed(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, current_hash, language and bytes of the files that exist, by explicit relative paths."""
    full = [str(Path(root, p)) for p in paths if Path(root, p).is_file()]
    schema = "path string, current_hash string, language string, bytes long"
    if not full:
        return spark.createDataFrame([], schema)
    rows = spark.read.format("binaryFile").load([re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in full])
    own = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/*", "/"), "^" + re.escape(str(Path(root))) + "/", "")
    return rows.select(own.alias("path"), F.sha2("content", 256).alias("current_hash"), F.col("length").alias("bytes")).select("path", "current_hash", language_of(F.col("path")).alias("language"), "bytes")


def capture_changed(spark: SparkSession, root: str) -> DataFrame:
    """Hashes of all changed files, or none where there are too many or too large ones."""
    paths = changed_paths(root)
    size = sum(Path(root, p).stat().st_size for p in paths if Path(root, p).is_file())
    return hashed(spark, root, paths if len(paths) <= MOST_FILES and size <= MOST_BYTES else [])
