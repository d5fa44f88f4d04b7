"""A kept inverted index over rows of text fields, in versions of a folder.

A segment is what one commit adds: postings, and for each row its key, length
and sequence number; rows that it replaces or removes get a tombstone, so
nothing that was written changes.  ``totals`` in the manifest's notes are the
number of live rows and the sum of their lengths, kept up to date by each
commit.  Segments of one size are merged into a larger one, and tombstones that
have nothing left to end go then.

Defined cases: a row without words is a row with length 0; of rows with one key
in a segment each counts, so keys must be distinct; a segment without rows
changes nothing; a query without terms finds nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators import postings as P
from strataloom.operators import retrieval as R
from strataloom.sources.scratch import remove, shared_dir, staged
from strataloom.sources.versions import Manifest, Versions

#: Buckets by term, and segments of one size from which a merge makes one.
BUCKETS, TIER = 32, 4


class Index:
    """The index of rows (key, fields) in a folder; ``pinned``: the version it reads, else the last one."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str, fields: tuple[str, ...], buckets: int = BUCKETS, pinned: Manifest | None = None) -> None:
        self.spark, self.versions, self.key, self.kind, self.fields, self.buckets, self.pinned = spark, Versions(spark, path), key, kind, fields, buckets, pinned
        schema = lambda ddl: T.StructType.fromDDL(ddl)
        self.schemas = {
            "postings": schema(f"term string, keys array<{kind}>, lengths array<int>, fields array<tinyint>, starts array<int>, positions array<int>, seq long, bucket int"),
            "rows": schema(f"{key} {kind}, length long, seq long"),
            "tombstones": schema(f"{key} {kind}, seq long"),
        }

    def manifest(self) -> Manifest:
        return self.pinned or self.versions.manifest()

    def at(self, manifest: Manifest | None = None) -> Index:
        """The index as of a version, the present one by default."""
        return Index(self.spark, self.versions.path, self.key, self.kind, self.fields, self.buckets, manifest or self.manifest())

    def table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        return self.versions.read(manifest or self.manifest(), name, self.schemas[name])

    def _alive(self, rows: DataFrame, m: Manifest) -> DataFrame:
        return P.alive(rows, self.table("tombstones", m) if m.entries("tombstones") else None, self.key)

    def live(self) -> DataFrame:
        """key, length, seq of the rows that count."""
        m = self.manifest()
        return self._alive(self.table("rows", m), m)

    def live_postings(self) -> DataFrame:
        m = self.manifest()
        return self._alive(P.entries(self.table("postings", m), self.key), m)

    # writes

    def _written(self, rows: DataFrame, seq: int) -> tuple[dict[str, list[dict]], DataFrame | None, int, int]:
        """The folders of a segment in one pass over the texts, its rows, their number and the sum of their lengths; nothing where there are no rows."""
        found = self.versions.write("postings", P.postings(P.blocked(rows, self.key, self.fields), seq, self.buckets), ("bucket",), first=seq)
        own = P.rows_of(self.table("postings", Manifest(0, {"postings": [found]})), self.key)
        entry = self.versions.write("rows", own.withColumn("seq", F.lit(seq).cast("long")), first=seq)
        kept = self.table("rows", Manifest(0, {"rows": [entry]}))
        n, length = kept.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if n:
            return {"postings": [found | {"rows": n}], "rows": [entry | {"rows": n}]}, kept, n, length
        for e in (found, entry):
            remove(self.spark, f"{self.versions.path}/{e['path']}")
        return {}, None, 0, 0

    def add(self, rows: DataFrame | None, gone: DataFrame | None = None, stream: str | None = None, batch: int | None = None, beside: dict[str, list[dict]] | None = None) -> Manifest:
        """A segment of rows, which replace those with the same keys, and without those of ``gone`` (key).

        With a stream's name and the number of its batch, a batch that was committed before changes nothing.
        ``beside``: data folders of other tables that become part of the same commit.
        """
        m = self.versions.manifest()
        if stream is not None and m.notes.get("streams", {}).get(stream, -1) >= batch:
            return m
        seq, add = m.version + 1, dict(beside or {})
        made, kept, n, length = ({}, None, 0, 0) if rows is None else self._written(rows, seq)
        ended = gone.select(self.key) if gone is not None else None
        if n:
            own = kept.select(self.key)
            ended = own if ended is None else ended.union(own)
        less = (0, 0)
        if ended is not None and m.entries("rows"):
            asked = staged(ended.distinct(), "ended")
            old = staged(self._alive(self.table("rows", m), m).join(asked, self.key, "left_semi"), "old")
            less = old.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            if less[0]:
                add["tombstones"] = [self.versions.write("tombstones", old.select(self.key, F.lit(seq).cast("long").alias("seq")), first=seq, rows=less[0])]
        add |= made
        was = m.notes.get("totals", [0, 0])
        notes = {"totals": [was[0] + n - less[0], was[1] + length - less[1]]}
        if stream is not None:
            notes["streams"] = m.notes.get("streams", {}) | {stream: batch}
        return self.versions.commit(m, add, notes=notes) if add or stream is not None else m

    def merge(self, tier: int = TIER) -> bool:
        """Make one segment of the newest ones, where ``tier`` or more of them are within a factor of that many rows; whether there was something to merge."""
        m = self.versions.manifest()
        segments = sorted(m.entries("rows"), key=lambda e: e["first"])
        run: list[dict] = []
        for s in reversed(segments):
            if run and s["rows"] > tier * max(e["rows"] for e in run):
                break
            run.append(s)
        if len(run) < tier:
            return False
        firsts = {e["first"] for e in run}
        whole = len(run) == len(segments)
        add, drop = {}, {}
        for name in ("postings", "rows"):
            some = [e for e in m.entries(name) if e["first"] in firsts]
            part = Manifest(m.version, {name: some, "tombstones": m.entries("tombstones")}, m.notes)
            found = self.table(name, part)
            left = self._alive(P.entries(found, self.key) if name == "postings" else found, part)
            if name == "postings":
                many = found.agg(F.coalesce(F.sum(F.size("starts").cast("long")), F.lit(0))).first()[0]
                left = P.packed(left, self.key, P.spread_for(many, self.buckets))
            drop[name] = {e["path"] for e in some}
            made = self.versions.write(name, left, ("bucket",) if name == "postings" else (), first=max(firsts), rows=sum(e["rows"] for e in run))
            add[name] = [made]
        rows = self.table("rows", Manifest(0, {"rows": add["rows"]})).count()
        for name in add:
            add[name][0]["rows"] = rows
        if whole:  # every row that a tombstone could end was read
            drop["tombstones"] = {e["path"] for e in m.entries("tombstones")}
        self.versions.commit(m, add, drop)
        return True

    def rebuild(self, rows: DataFrame) -> Manifest:
        """Everything anew, as one segment; streams are remembered."""
        m = self.versions.manifest()
        add, _, n, length = self._written(rows, m.version + 1)
        return self.versions.commit(m, add, {name: {e["path"] for e in m.entries(name)} for name in self.schemas}, {"totals": [n, length]})

    # reads

    def counts(self, terms: list[str], columns: dict[str, float]) -> DataFrame:
        """key, length and counts of the rows that have a term in one of the columns."""
        m = self.manifest()
        phrases = [R.phrase_words(t) for t in terms]
        wanted = sorted({w for p in phrases for w in p})
        found = self.table("postings", m).filter(F.col("bucket").isin(*sorted({P.bucket_of(w, self.buckets) for w in wanted})) & F.col("term").isin(*wanted))
        found = P.entries(found, self.key)
        used = [k for k, f in enumerate(self.fields) if f in columns]
        if len(used) < len(self.fields):
            found = found.filter(F.col("field").isin(*used))
        return P.counted(self._alive(found, m), self.key, phrases, [columns.get(f, 0.0) for f in self.fields])

    def scores(self, terms: list[str], columns: dict[str, float]) -> DataFrame:
        """key, hits and bm25 as ``retrieval.bm25`` gives them for all fields, from postings alone."""
        if not terms or not all(map(R.phrase_words, terms)):
            terms = [t for t in terms if R.phrase_words(t)]
        if not terms:
            return self.spark.createDataFrame([], f"{self.key} {self.kind}, hits int, bm25 double")
        n, length = self.manifest().notes.get("totals", [0, 0])
        return R.score_counts(self.counts(terms, columns), len(terms), F.lit(n), F.lit(length / n if n else 0.0), self.key)


def named(spark: SparkSession, name: str, sources: list[DataFrame], *more: object) -> str:
    """A folder in the shared one, named by the files that the sources read, with their sizes and times, so other files give another one."""
    h = hashlib.sha256(" ".join([name, *map(str, more)]).encode())
    for df in sources:
        for path in sorted(df.inputFiles()):
            own = spark._jvm.org.apache.hadoop.fs.Path(path)
            status = own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own)
            h.update(f"{path} {status.getLen()} {status.getModificationTime()}\n".encode())
    return f"{shared_dir(spark)}/index-{name}-{h.hexdigest()[:24]}"


def kept(spark: SparkSession, name: str, sources: list[DataFrame], key: str, kind: str, fields: tuple[str, ...], make: Callable[[], DataFrame]) -> Index:
    """The index of what ``make`` gives, built in the shared folder the first time it is asked for and found there after."""
    index = Index(spark, named(spark, name, sources, key, fields, P.LAYOUT), key, kind, fields)
    if not index.versions.numbers():
        index.add(make())
    return index.at()
