"""Vector code compression: a codebook for each part of the vectors, fitted by Elkan's form of Lloyd's rounds.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook.  With each vector are kept, for each of its parts, the
entry it has, an upper bound of the distance to it and a lower bound of the
distance to every entry.  When entries move, bounds are shifted by as much.  An
entry is passed over only where the triangle inequality proves it strictly
farther: the upper bound is below its lower bound, or below half its distance
from the present entry.  Whatever is left, ties among it, is decided by exact
squared distances of integers, the lower entry first.

Bounds are whole numbers too, upper ones rounded up and lower ones down, so no
rounding can pass over a nearer entry.  They are kept in 16 bits in a unit that
the largest component gives; one that does not fit counts as unknown.

A round is one pass over the table of vectors and bounds in the shared folder.
It writes the next table and, in a row a task, the sums and counts of the parts
by entry, which are added up in Spark; only the codebooks pass the driver.

Defined cases: rows whose vector is null or has a null or non-finite component
are dropped; fewer rows than entries give as many entries as rows; of rows with
equal ids the one with the smaller vector comes first, null ids come last; equal
vectors get equal codes; rows whose length differs from the first vector's get
null codes and errors; a length that the parts do not divide, and components
beyond 2 ** 27 when scaled, whose errors a long can't hold, are errors; an empty
table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.sources.scratch import remove

from .shared import BROADCAST_ROWS, scratch, staged, take

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: The largest component after scaling, so that the squared distance of a vector is a long.
LARGEST = 1 << 27
#: The largest bound that is kept; an upper bound of this size is unknown.
MOST = (1 << 16) - 1
FAR = np.int64(1) << 62


def root(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def down(squares: np.ndarray, unit: int) -> np.ndarray:
    """A lower bound of distances in units."""
    return np.minimum(root(squares) // unit, MOST)


def up(squares: np.ndarray, unit: int) -> np.ndarray:
    """An upper bound of distances in units."""
    r = root(squares)
    r += r * r < squares
    return -(-r // unit)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` from each of ``b``."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


class Bounds:
    """Vectors (rows by parts by components) with what is known of their distances from the entries."""

    def __init__(self, vectors: np.ndarray, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.vectors, self.entry, self.upper, self.lower = vectors, entry, upper, lower
        self.measured = 0  # distances taken

    @classmethod
    def of(cls, vectors: np.ndarray, books: np.ndarray, unit: int) -> Bounds:
        """All distances, taken once."""
        rows, parts, _ = vectors.shape
        own = cls(vectors, np.empty((rows, parts), np.int64), np.empty((rows, parts), np.int64), np.empty((rows, parts, books.shape[1]), np.int64))
        for p in range(parts):
            squares = apart(vectors[:, p], books[p])
            own.entry[:, p] = squares.argmin(axis=1)  # the first of equals
            own.upper[:, p] = up(squares.min(axis=1), unit)
            own.lower[:, p] = down(squares, unit)
        own.measured = own.lower.size
        return own

    def shift(self, moved: np.ndarray) -> None:
        """Entries have moved by at most so many units."""
        for p in range(len(moved)):
            self.upper[:, p] = np.where(self.upper[:, p] >= MOST, FAR >> 2, self.upper[:, p] + moved[p][self.entry[:, p]])
        self.lower = np.maximum(self.lower - moved[None], 0)

    def assign(self, books: np.ndarray, unit: int) -> None:
        """Each part's nearest entry, the lower one on ties."""
        for p in range(books.shape[0]):
            self._assign_part(p, books[p], unit)

    def _assign_part(self, p: int, book: np.ndarray, unit: int) -> None:
        entry, upper, lower, part = self.entry[:, p], self.upper[:, p], self.lower[:, p], self.vectors[:, p]
        between = root(apart(book, book)) // unit

        def left(rows: np.ndarray) -> np.ndarray:
            """Entries of these rows that are not proved strictly farther than the present one."""
            u, own = upper[rows, None], entry[rows]
            open_ = (u >= lower[rows]) & (2 * u >= between[own])
            open_[np.arange(len(rows)), own] = False
            return open_

        rows = np.arange(len(part))
        rows = rows[left(rows).any(axis=1)]
        if not len(rows):
            return
        own = entry[rows]
        present = ((part[rows] - book[own]) ** 2).sum(axis=1)
        self.measured += len(rows)
        upper[rows], lower[rows, own] = up(present, unit), down(present, unit)
        open_ = left(rows)
        squares = np.full(open_.shape, FAR)
        squares[np.arange(len(rows)), own] = present
        at, other = np.nonzero(open_)
        exact = ((part[rows[at]] - book[other]) ** 2).sum(axis=1)
        self.measured += len(at)
        squares[at, other] = exact
        lower[rows[at], other] = down(exact, unit)
        best = squares.argmin(axis=1)
        entry[rows], upper[rows] = best, up(squares[np.arange(len(rows)), best], unit)

    def errors(self, books: np.ndarray) -> np.ndarray:
        """Squared distances from the entries, summed over the parts."""
        return sum(((self.vectors[:, p] - books[p][self.entry[:, p]]) ** 2).sum(axis=1) for p in range(books.shape[0]))

    def sums(self, entries: int) -> np.ndarray:
        """By part and entry: the components' sums and the count."""
        rows, parts, width = self.vectors.shape
        out = np.zeros((parts, entries, width + 1), np.int64)
        for p in range(parts):
            order = np.argsort(self.entry[:, p], kind="stable")
            used, first = np.unique(self.entry[order, p], return_index=True)
            out[p, used, :width] = np.add.reduceat(self.vectors[order, p], first, axis=0)
            out[p, used, width] = np.diff(first, append=rows)
        return out


def packed(values: np.ndarray) -> pa.Array:
    """Rows of numbers as a binary column."""
    body = np.ascontiguousarray(values).reshape(len(values), -1)
    width = body.shape[1] * body.itemsize
    return pa.Array.from_buffers(pa.binary(), len(body), [None, pa.py_buffer((np.arange(len(body) + 1) * width).astype(np.int32)), pa.py_buffer(body)])


def unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    """The rows of a binary column without nulls."""
    where, data = column.buffers()[1:]
    ends = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, kind, (ends[-1] - ends[0]) // np.dtype(kind).itemsize, int(ends[0])).reshape(len(column), *shape)


class Plan:
    """The sizes of one compression, which tasks get with the codebooks."""

    def __init__(self, parts: int, width: int, scale: int, largest: int) -> None:
        self.parts, self.width, self.scale, self.unit = parts, width, scale, 1
        while 2 * (largest + 1) * max(1, width) ** 0.5 / self.unit > MOST - 4096:
            self.unit *= 2
        self.kind = "<i2" if largest < 1 << 15 else "<i4"

    def row(self, batch: pa.RecordBatch, b: Bounds) -> list[pa.Array]:
        """The kept columns: id, label, vector, entries, upper and lower bounds, no sums."""
        kept = [packed(b.vectors.astype(self.kind)), packed(b.entry.astype(np.uint8)), packed(np.minimum(b.upper, MOST).astype("<u2")), packed(b.lower.astype("<u2"))]
        return [batch.column(0), batch.column(1), *kept, pa.nulls(batch.num_rows, pa.list_(pa.int64()))]

    def bounds(self, batch: pa.RecordBatch) -> Bounds:
        vectors = unpacked(batch.column(2), self.kind, self.parts, self.width).astype(np.int64)
        entry, upper = unpacked(batch.column(3), "u1", self.parts).astype(np.int64), unpacked(batch.column(4), "<u2", self.parts).astype(np.int64)
        return Bounds(vectors, entry, upper, unpacked(batch.column(5), "<u2", self.parts, -1).astype(np.int64))


_KEPT = ("id", "label", "vector", "entry", "upper", "lower", "sums")


def _writer(plan: Plan, books: np.ndarray, opened):
    """A pass: ``opened`` makes the bounds of a batch; gives the kept rows and, last, a task's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = None, None
        for batch in batches:
            if batch.num_rows:
                b = opened(batch)
                total = b.sums(books.shape[1]) + (0 if total is None else total)
                kinds = [batch.column(0).type, batch.column(1).type]
                yield pa.RecordBatch.from_arrays(plan.row(batch, b), _KEPT)
        if total is not None:
            empty = [pa.nulls(1, t) for t in (*kinds, *(pa.binary(),) * 4)]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], _KEPT)

    return run


def moved(old: np.ndarray, new: np.ndarray, unit: int) -> np.ndarray:
    """Units by which entries have moved at most."""
    return up(((new - old) ** 2).sum(axis=2), unit)


def updated(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """Entries replaced by the means of their parts, rounded down; unused ones stay."""
    rows = state.filter("sums is not null").select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()  # as many as the codebooks have numbers
    flat = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
    for at, value in rows:
        flat[at] = value
    sums = flat.reshape(*books.shape[:2], -1)
    count = sums[:, :, -1:]
    return np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)  # rounds down, also below 0


class Compressed:
    """``codes``: id, label, code and error; ``books``: the final entries, parts by entries by components."""

    def __init__(self, codes: DataFrame, books: np.ndarray) -> None:
        self.codes, self.books = codes, books

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def usable(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, vector of the rows whose vector has numbers alone."""
    own = take(rows, key, label, vector).toDF("id", "label", "vector")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return own.filter(F.col("vector").isNotNull() & F.forall("vector", number))


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of all usable rows and the codebooks they refer to."""
    spark = rows.sparkSession
    given = usable(rows, key, vector, label)
    kinds = f"id {given.schema['id'].dataType.simpleString()}, label {given.schema['label'].dataType.simpleString()}"
    first = given.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()  # as many rows as entries
    if not first:
        return Compressed(spark.createDataFrame([], f"{kinds}, code string, error long"), np.zeros((parts, 0, 0), np.int64))
    length = len(first[0][0])
    if length % parts:
        raise ValueError(f"vectors of {length} components are not cut into {parts} equal parts")
    same = given.filter(F.size("vector") == length)
    highest = same.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()[0]
    if (highest or 0) * scale >= LARGEST:
        raise ValueError(f"components of {highest} are too large")
    plan = Plan(parts, length // parts, scale, int((highest or 0) * scale) + 1)
    whole = lambda flat: np.floor(np.asarray(flat, np.float64) * plan.scale).astype(np.int64).reshape(-1, plan.parts, plan.width)
    books = whole([r[0] for r in first if len(r[0]) == length]).transpose(1, 0, 2).copy()
    schema = f"{kinds}, vector binary, entry binary, upper binary, lower binary, sums array<bigint>"

    def opened(batch: pa.RecordBatch, books=books) -> Bounds:
        return Bounds.of(whole(batch.column(2).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, plan.parts, plan.width), books, plan.unit)

    def again(old: np.ndarray, new: np.ndarray):
        def opened(batch: pa.RecordBatch) -> Bounds:
            b = plan.bounds(batch)
            b.shift(moved(old, new, plan.unit))
            b.assign(new, plan.unit)
            return b

        return opened

    def written(made: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "bounds")
        made.write.parquet(path)
        return spark.read.schema(made.schema).parquet(path), path

    state, path = written(same.mapInArrow(_writer(plan, books, opened), schema))
    for k in range(rounds):
        old, books = books, updated(books, state)
        vectors = state.filter("vector is not null")
        if k + 1 < rounds:
            state, next_path = written(vectors.mapInArrow(_writer(plan, books, again(old, books)), schema))
            remove(spark, path)  # what it was made of is written, so it can't be asked for again
            path = next_path

    last = again(old, books) if rounds else plan.bounds

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = last(batch)
                digits, n = b.entry.astype(np.uint8).tobytes().hex(), 2 * plan.parts
                codes = [digits[k : k + n] for k in range(0, len(digits), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(b.errors(books), pa.int64())], ["id", "label", "code", "error"])

    codes = state.filter("vector is not null").mapInArrow(coded, f"{kinds}, code string, error long")
    others = given.filter(F.size("vector") != length).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    codes = staged(codes.unionByName(others), "codes")
    remove(spark, path)
    return Compressed(codes, books)


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with label_error, the sum of the errors over equal labels; nulls are one label."""
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB's SQL, for small tables: every round compares every part with every entry."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"w AS (SELECT len(e) // {parts} AS w FROM v LIMIT 1)",
        f"p AS MATERIALIZED (SELECT vec_id, j, e[j * w + 1 : (j + 1) * w] AS x FROM v, w, (SELECT unnest(range({parts})) AS j) AS r)",
        f"b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x AS c FROM p QUALIFY k < {entries})",
    ]
    distance = "list_sum(list_transform(x, lambda y, i: (y - c[i]) * (y - c[i])))::BIGINT"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p.j, any_value(x) AS x, min(struct_pack(d := {distance}, k := k)) AS best FROM p JOIN b{r} AS b ON p.j = b.j GROUP BY vec_id, p.j)")
        if r < rounds:
            sums = f"g{r} AS (SELECT j, k, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS m FROM (SELECT j, k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT j, best.k AS k, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY j, k, i) GROUP BY j, k)"
            steps += [sums, f"b{r + 1} AS MATERIALIZED (SELECT b.j, b.k, coalesce(g.m, b.c) AS c FROM b{r} AS b LEFT JOIN g{r} AS g ON b.j = g.j AND b.k = g.k)"]
    steps += [
        f"f AS (SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY j) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, k)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT f.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v ON f.vec_id = v.vec_id, h"
