"""Exact n-gram Jaccard join by a token-group matrix.

A token is a shingle's hash, a document its set of tokens.  Two documents link
when their sets have at least ``threshold`` per cent of their union in common.

1. *Screen.*  A document with a link has at least that share of its tokens in
   other documents.  Each task sorts the tokens of a chunk of documents; what is
   in several of the chunk counts at once, and of the rest 32 bits a token go to
   the task that owns their hash range, which answers per chunk how many tokens
   of each document others have too.  A chunk sends each token once, so a token
   of every document costs one entry a chunk.  Most documents end here.
2. *Classes.*  Documents with equal sets become one class.
3. *Similar groups.*  In each of a few rounds, classes with an equal smallest
   token under that round's order meet (in pieces of bounded size by further
   hashes), unless they hang together already, and exact links are found inside
   the pieces, from one member of each part first, so that a crowd of near copies
   takes one pass.  The components so far, cut into pieces of bounded size, are
   the groups.
4. *Between groups.*  A group's row of the matrix is the union of its members'
   tokens; a member's overlap with it bounds its overlap with every member.  Of a
   class only the rarest ``n - ceil(t n) + 1`` tokens (by number of groups) are
   looked up, and of a group's row only those of its members: without one of them
   in common the overlap can't be reached.  The place of a token among a set's
   shared tokens bounds the overlap of pairs of which it is the first in common, so
   the size of partners too.  Qualifying groups of fitting sizes are opened and
   compared member by member, in as many pieces as those that ask take.  Of two
   units (components, or groups without links) only the lower one asks, so a crowd
   of near copies asks nothing and is asked once by each outsider that may belong
   to it.
5. *Components* of the links by alternating star contraction on tables.

Inside a group, too, a set looks up its rarest shared tokens alone, in lists by
descending size of partner, and only what fits is counted out: documents that
share a template, but not enough to link, find nothing in the template's lists.

Screening, grouping and these bounds only prune: every link is found by an exact
count of hashes (64 bits each), and none is left out.

Defined cases: null and empty texts have no tokens, no links and are their own
component; texts of fewer words than a shingle are one token; repeated rows and
equal texts are one class; a null id is larger than all others; texts of any
length are one set; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, let_go, partitions, settled, slices, staged, take
from .shingles import WIDTH, mix, shingle_sets

THRESHOLD = 80
#: Bytes of text in a chunk of the screen, and documents at most (their numbers are 16 bits).
CHUNK, CHUNK_ROWS = 4 << 20, 60_000
#: Documents for each hash range of the screen, of which a task holds one at a time, and answers that it holds.
RANGE, ANSWERS = 20_000, 1 << 22
#: Tokens of all classes of a group together, and of those that ask it at once; a task holds one group's lists, about 40 bytes a token.
GROUP = 50_000
#: Rounds, each with an order of its own, in which classes with an equal smallest token meet.
ROUNDS = 3
#: Stands for a null id.
NO_ID = np.iinfo(np.int64).max


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def lowest(tokens: np.ndarray, rounds: int = ROUNDS) -> list[int]:
    """The smallest token in each round's order: a fixed mix of the token and the round."""
    return [int(mix(tokens ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min().view(np.int64)) for k in range(rounds)]


def packed(values: np.ndarray, kind: str) -> bytes:
    """Integers as planes of bytes, lowest first, which compress better than whole words."""
    plain = values.astype(kind)
    return plain.view(np.uint8).reshape(-1, plain.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values in a sorted array, and their lengths."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(values)])


_CHUNKS = "part int, kind int, chunk string, a binary, b binary, c binary, d binary"
_TYPES = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _rows(rows: list[tuple], schema: str = _CHUNKS, types: tuple = _TYPES) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000]), types)], [x.split()[0] for x in schema.split(", ")])


def shared_in(rows: list[dict]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each chunk that has entries in a hash range: its documents with tokens of others there, and how many."""
    keys, places, lone = [], [], []
    for at, row in enumerate(rows):
        for column in ("a", "c"):
            low = np.cumsum(unpacked(row[column], "<u4"), dtype=np.uint32)  # the differences wrap as the sums do
            keys.append(low)
            places.append(unpacked(row["b"], "<u2").astype(np.uint64) | np.uint64(at << 16) if column == "a" else np.zeros(len(low), np.uint64))
            lone.append(np.full(len(low), column == "a"))
    key, place, single = np.concatenate(keys), np.concatenate(places), np.concatenate(lone)
    del keys, places, lone
    if not len(key):
        return
    order = np.argsort(key)
    starts, lengths = runs_of(key[order])
    single = single[order]
    shared = (lengths > 1) | ~np.logical_and.reduceat(single, starts)
    found, counts = np.unique(place[order][np.repeat(shared, lengths) & single], return_counts=True)
    edges = np.searchsorted(found, np.arange(len(rows) + 1, dtype=np.uint64) << np.uint64(16))
    for at in np.flatnonzero(np.diff(edges)).tolist():
        span = slice(edges[at], edges[at + 1])
        yield rows[at]["chunk"], found[span] & np.uint64(0xFFFF), counts[span]


def screen(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """doc_id, n, digest, near for every row of ``docs`` (doc_id, text): whether so many of its tokens occur in other documents that it may have a link."""
    parts = max(partitions(docs.sparkSession) * 4, docs.count() // RANGE)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        ids: list[int] = []
        sets: list[np.ndarray] = []
        size, task, numbers = 0, TaskContext.get().partitionId(), itertools.count()

        def flush() -> Iterator[pa.RecordBatch]:
            number = next(numbers)  # a repeated task gives its chunks the same names
            chunk, counts = f"{task}-{number}", np.array([*map(len, sets)], np.int64)
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            of = np.repeat(np.arange(len(sets), dtype=np.uint16), counts)
            order = np.argsort(tokens)
            tokens, of = tokens[order], of[order]
            starts, lengths = runs_of(tokens)
            again = np.repeat(lengths > 1, lengths)
            local = np.bincount(of[again], minlength=len(sets))
            facts = (packed(np.array(ids, np.int64), "<i8"), packed(counts, "<i4"), packed(local, "<i4"), b"".join(map(set_digest, sets)))
            rows = [((task + 7919 * number) % parts, 0, chunk, *facts)]
            keys, single, owner = tokens[starts], lengths == 1, of[starts]
            part = ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
            low = ((keys >> np.uint64(8)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            edges = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                span = slice(edges[p], edges[p + 1])
                one = single[span]
                rows.append((p, 1, chunk, packed(np.diff(low[span][one], prepend=0), "<u4"), packed(owner[span][one], "<u2"), packed(np.diff(low[span][~one], prepend=0), "<u4"), None))
                if len(rows) == 2000:
                    yield from _rows(rows)
                    rows = []
            yield from _rows(rows)

        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                sets += shingle_sets(texts, width)
                ids += part.column(0).to_pylist()
                size += sum(len(t or "") for t in texts)
                if size >= CHUNK or len(ids) >= CHUNK_ROWS:
                    yield from flush()
                    ids, sets, size = [], [], 0
        if ids:
            yield from flush()
        sets.clear()
        let_go()

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = []
            for name, own in found.items():
                docs_, n = (np.concatenate(x) for x in zip(*own))
                rows.append((0, 1, name, packed(docs_, "<u2"), packed(n, "<i4"), None, None))
            yield from _rows(rows)
            found.clear()

        size = 0
        for _, own in itertools.groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["part"]):  # one hash range at a time
            rows = []
            for row in own:
                if row["kind"] == 0:
                    yield from _rows([tuple(row.values())])
                else:
                    rows.append(row)
            for name, docs_, n in shared_in(rows) if rows else ():
                found.setdefault(name, []).append((docs_, n))
                size += len(docs_)
            if size >= ANSWERS:
                yield from out()
                size = 0
        yield from out()
        let_go()

    rows = take(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    told = staged(rows.mapInArrow(chunks, _CHUNKS).repartition(partitions(docs.sparkSession), "part").sortWithinPartitions("part", "kind", "chunk").mapInArrow(answers, _CHUNKS), "screen")

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:  # a chunk's answers
        own = pdf[pdf["kind"] == 0].iloc[0]
        ids, n, shared = unpacked(own["a"], "<i8"), unpacked(own["b"], "<i4").astype(np.int64), unpacked(own["c"], "<i4").astype(np.int64)
        for row in pdf[pdf["kind"] == 1].itertuples():
            shared += np.bincount(unpacked(row.a, "<u2").astype(np.int64), weights=unpacked(row.b, "<i4"), minlength=len(ids)).astype(np.int64)
        digests = [own["d"][k : k + 16] for k in range(0, len(own["d"]), 16)]
        return pd.DataFrame({"doc_id": ids, "n": n, "digest": digests, "near": (n > 0) & (100 * shared >= threshold * n)})

    return told.groupBy("chunk").applyInPandas(totals, "doc_id long, n long, digest binary, near boolean")


def largest(rest: np.ndarray, size: np.ndarray, threshold: int) -> np.ndarray:
    """The largest partner with which a set can still link if ``rest`` tokens at most are in common."""
    return rest * (100 + threshold) // threshold - size


class Inverted:
    """The token sets of a group, the first ``members`` of which are found and all of which may ask.

    A set's shared tokens are in order of rarity in the group.  If a link's first common token has ``rest`` tokens from it on
    in either set, the overlap is at most that, so only a set's first tokens are listed and asked, and a list has its
    entries by descending size of the largest partner.
    """

    def __init__(self, sets: list[np.ndarray], threshold: int, members: int | None = None) -> None:
        self.threshold, self.members = threshold, len(sets) if members is None else members
        self.sizes = np.array([*map(len, sets)], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        tokens, ranks, have = np.unique(every, return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(sets)), self.sizes)
        self.starts, self.ranks, self.mark = np.cumsum(self.sizes) - self.sizes, ranks, np.zeros(len(tokens), bool)
        shared = have[ranks] > 1
        of, ranks = of[shared], ranks[shared]
        order = np.lexsort((ranks, have[ranks], of))
        of, ranks = of[order], ranks[order]
        use = np.bincount(of, minlength=len(sets))
        place = np.arange(len(of)) - (np.cumsum(use) - use)[of]
        rest = use[of] - place
        first = rest * 100 >= threshold * self.sizes[of]
        of, ranks, rest = of[first], ranks[first], rest[first]
        self.asks = (ranks, largest(rest, self.sizes[of], threshold), np.searchsorted(of, np.arange(len(sets) + 1)))
        listed = of < self.members
        self.step = int(max(self.asks[1].max(initial=0), self.sizes.max(initial=0))) + 2
        key = ranks[listed] * self.step + (self.step - 1 - self.asks[1][listed])
        order = np.argsort(key, kind="stable")
        self.key, self.listed = key[order], of[listed][order]

    def linked(self, k: int) -> np.ndarray:
        """The members that a set links with, itself left out."""
        ranks, top, edges = self.asks
        span, n, threshold = slice(edges[k], edges[k + 1]), int(self.sizes[k]), self.threshold
        first = np.searchsorted(self.key, ranks[span] * self.step)
        until = np.searchsorted(self.key, ranks[span] * self.step + (self.step - 1 - n), side="right")
        lengths = np.maximum(until - first, 0)
        if not lengths.any():
            return np.zeros(0, np.int64)
        found = self.listed[np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        size = self.sizes[found]
        fits = (size <= np.repeat(top[span], lengths)) & (size * 100 >= threshold * n) & (size * threshold <= 100 * n)
        found = np.unique(found[fits])
        found = found[found != k]
        if not len(found):
            return found
        size = self.sizes[found]
        own = self.ranks[self.starts[k] : self.starts[k] + n]
        self.mark[own] = True
        starts = np.cumsum(size) - size
        both = np.add.reduceat(self.mark[self.ranks[np.repeat(self.starts[found] - starts, size) + np.arange(size.sum())]].astype(np.int64), starts)
        self.mark[own] = False
        return found[100 * both >= threshold * (n + size - both)]


def inner_parts(inverted: Inverted, known: np.ndarray) -> np.ndarray:
    """For each member the number of its part: what hangs together by ``known`` components or by links inside the group."""
    n = inverted.members
    first: dict[int, int] = {}
    parent = np.array([first.setdefault(c, k) for k, c in enumerate(known.tolist())], np.int64)
    alone = np.bincount(parent, minlength=n)[parent] == 1

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    asked, joined = np.zeros(n, bool), np.zeros(n, bool)

    def ask(k: int) -> None:
        asked[k] = True
        for other in inverted.linked(k).tolist():
            a, b = root(k), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                joined[k] = joined[other] = True

    for k in range(n):  # stars first
        if alone[k] and not joined[k]:
            ask(k)
    labels = np.array([root(k) for k in range(n)])
    most = np.bincount(labels).argmax() if n else 0
    for k in range(n):  # every link between two parts has an end outside the largest
        if labels[k] != most and not asked[k]:
            ask(k)
    return np.array([root(k) for k in range(n)])


def tidied(pdf: pd.DataFrame, *read: pd.DataFrame) -> pd.DataFrame:
    """A group's result; after a large group, freed memory goes back."""
    if sum(len(x) for x in read) > 300:
        let_go()
    return pdf


def as_sets(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column]


def dealt(sizes: DataFrame, key: str, limit: int, salt: int) -> Column:
    """A group number for rows with a key and its number of tokens, ``weight``: a large key's rows are cut into pieces by the node's salted hash, small keys share groups.

    ``sizes`` has a row a key; groups have about ``limit`` tokens.
    """
    small = F.sum(F.when(F.col("weight") <= limit, F.col("weight")))
    groups = -(-(sizes.agg(small).first()[0] or 0) // limit)
    piece = F.xxhash64(key, F.pmod(F.xxhash64("node", F.lit(salt)), F.ceil(F.col("weight") / limit)))
    return F.when(F.col("weight") > limit, piece).otherwise(F.xxhash64(F.lit(salt), F.pmod(F.xxhash64(key), F.lit(max(1, groups)))))


def similar_links(classes: DataFrame, threshold: int, rounds: int = ROUNDS, limit: int = GROUP) -> DataFrame:
    """Exact links (a, b) between classes (node, n, tokens, low: the smallest token by round) that meet in one of the rounds."""
    links, names = None, classes.select("node", "n", "low")
    state = names.select("node", F.col("node").alias("component"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        parts = inner_parts(Inverted(as_sets(pdf["tokens"]), threshold), pdf["component"].to_numpy())
        leader = pdf["node"].to_numpy()[parts]
        linked = leader != pdf["node"].to_numpy()
        return tidied(pd.DataFrame({"a": leader[linked], "b": pdf["node"].to_numpy()[linked]}), pdf)

    for k in range(rounds):
        meets = names.select("node", "n", F.col("low")[k].alias("key")).join(state, "node")
        crowds = meets.groupBy("key").agg(F.sum("n").alias("weight"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").drop("x", "y")
        crowds = staged(crowds, "crowds")
        meets = meets.join(crowds, "key").select("node", "component", dealt(crowds, "key", limit, k).alias("grp"))
        met = meets.join(classes.select("node", "tokens"), "node")
        found = staged(met.groupBy("grp").applyInPandas(inside, "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        state = with_components(names, links)
    return links


def with_components(names: DataFrame, links: DataFrame) -> DataFrame:
    return staged(names.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "state")


def grouped(classes: DataFrame, state: DataFrame, limit: int) -> DataFrame:
    """node, component, unit, members, grp: a large component is a unit of its own, in pieces; small ones share groups that are units each, and so do classes without links, by the most common of their smallest tokens."""
    state = state.join(classes.select("node", "n"), "node")
    sizes = staged(state.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("weight")), "sizes")
    state = state.join(sizes, "component")
    crowd = state.filter("members > 1").withColumn("grp", dealt(sizes.filter("members > 1"), "component", limit, -1))
    crowd = crowd.withColumn("unit", F.when(F.col("weight") > limit, F.col("component")).otherwise(F.col("grp"))).withColumn("members", F.when(F.col("weight") > limit, F.col("members")).otherwise(2))
    keys = state.filter("members = 1").drop("weight").join(classes.select("node", F.explode("low").alias("key")), "node")
    often = keys.groupBy("key").agg(F.count("*").alias("crowd"))
    best = keys.join(often, "key").groupBy("node", "component", "members").agg(F.max_by("key", F.struct("crowd", "key")).alias("key"), F.max("n").alias("n"))
    best = staged(best, "best")
    sizes = best.groupBy("key").agg(F.sum("n").alias("weight"))
    alone = best.join(sizes, "key").withColumn("grp", dealt(sizes, "key", limit, -2)).withColumn("unit", F.col("grp"))
    names = ("node", "component", "unit", "members", "grp")
    return crowd.select(*names).unionByName(alone.select(*names))


def class_links(classes: DataFrame, threshold: int, limit: int = GROUP) -> DataFrame:
    """Links between classes (node, n, tokens, low) that connect all classes that exact links connect: a, b."""
    links = similar_links(classes, threshold, limit=limit)
    groups = staged(classes.select("node", "tokens").join(grouped(classes, with_components(classes, links), limit), "node"), "groups")

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.unique(np.concatenate(as_sets(pdf["tokens"])))
        return pd.DataFrame({"token": tokens.view(np.int64), **{c: pdf[c].iloc[0] for c in ("grp", "unit", "members")}})

    matrix = staged(groups.groupBy("grp").applyInPandas(union, "token long, grp long, unit long, members long"), "matrix")
    rank = F.struct("members", "unit")
    often = matrix.groupBy("token").agg(F.count("*").alias("groups"), F.min(rank)["unit"].alias("bottom"), F.max(rank)["unit"].alias("top")).filter("bottom != top")
    marks = F.struct("token", "groups", (F.col("top") != F.col("unit")).alias("up"), (F.col("bottom") != F.col("unit")).alias("down"))
    told = matrix.join(often, "token").groupBy("grp").agg(F.sort_array(F.collect_list(marks)).alias("known"))
    column = lambda c: F.transform("known", lambda x: x[c]).alias(c)
    told = told.select("grp", *map(column, ("token", "groups", "up", "down")))

    def prefixes(members: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        asks: list[list[np.ndarray]] = []
        answers: list[list[np.ndarray]] = []
        if len(members) and len(known):
            token, number, up, down = (np.asarray(known[c].iloc[0], t) for c, t in (("token", np.int64), ("groups", np.int64), ("up", bool), ("down", bool)))
            token = token.view(np.uint64)
            order = np.argsort(token)
            token, number, up, down = token[order], number[order], up[order], down[order]
            for node, own in zip(members["node"], as_sets(members["tokens"])):
                n = len(own)
                at = np.minimum(np.searchsorted(token, own), len(token) - 1)
                hit = token[at] == own
                for usable, out in ((up, asks), (down, answers)):
                    use = hit & usable[at]
                    first = int(use.sum()) - -(-threshold * n // 100) + 1  # tokens that no asked (or asking) unit has come first
                    if first > 0:
                        found = own[use]
                        found = found[np.lexsort((found, number[at[use]]))[:first]]
                        top = largest(int(use.sum()) - np.arange(first), np.full(first, n), threshold)
                        out.append([found, np.full(first, node), np.full(first, n), np.full(first, n), top])
        out = []
        if asks:
            found = [np.concatenate(c) for c in zip(*asks)]
            out.append([found[0], np.ones(len(found[0]), bool), *found[1:]])
        if answers:  # by token: the smallest and largest set, and the largest partner
            found = [np.concatenate(c) for c in zip(*answers)]
            order = np.argsort(found[0], kind="stable")
            found = [c[order] for c in found]
            starts, _ = runs_of(found[0])
            least, most, top = np.minimum.reduceat(found[2], starts), np.maximum.reduceat(found[3], starts), np.maximum.reduceat(found[4], starts)
            out.append([found[0][starts], np.zeros(len(starts), bool), np.full(len(starts), members["grp"].iloc[0]), least, most, top])
        joined = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.uint64), np.zeros(0, bool), *(np.zeros(0, np.int64) for _ in range(4))]
        made = pd.DataFrame(dict(zip(("token", "asks", "id", "lo", "hi", "most"), (joined[0].view(np.int64), *joined[1:]))))
        return tidied(made, members).assign(unit=members["unit"].iloc[0] if len(members) else 0, members=members["members"].iloc[0] if len(members) else 0)

    kind = "token long, asks boolean, id long, lo long, hi long, most long, unit long, members long"
    both = staged(groups.groupBy("grp").cogroup(told.groupBy("grp")).applyInPandas(prefixes, kind), "prefixes")
    probes = both.filter("asks").select("token", F.col("id").alias("node"), F.col("lo").alias("n"), F.col("most").alias("top"), F.col("unit").alias("own"), F.col("members").alias("size"))
    answers = both.filter("not asks").select(F.col("token").alias("t"), F.col("id").alias("grp"), "lo", "hi", "most", "unit", "members")
    larger = (F.col("members") > F.col("size")) | ((F.col("members") == F.col("size")) & (F.col("unit") > F.col("own")))
    fits = (F.col("hi") * 100 >= F.col("n") * threshold) & (F.col("lo") * threshold <= F.col("n") * 100) & (F.col("lo") <= F.col("top")) & (F.col("n") <= F.col("most"))
    asks = probes.join(answers, (F.col("token") == F.col("t")) & larger & fits).select("node", "grp", "n").distinct()
    asks = staged(asks, "asks")
    # a group that many ask is opened in as many pieces as they take
    crowds = asks.groupBy("grp").agg(F.ceil(F.sum("n") / limit).alias("pieces"))
    dealt = asks.join(crowds, "grp").select("grp", "node", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece"))
    sent = dealt.join(groups.select("node", "tokens"), "node").select("grp", "piece", F.col("node").alias("asker"), F.col("tokens").alias("asked"))
    opened = groups.select("grp", "node", "component", "tokens").join(crowds, "grp", "left")
    opened = opened.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("pieces"), F.lit(1)) - 1))).drop("pieces")

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("node", ignore_index=True)
        names, known = members["node"].to_numpy(), members["component"].to_numpy()
        inside = len(members) > 0 and members["piece"].iloc[0] == 0 and (known != known[0]).any()
        a, b = [], []
        if len(members) and (inside or len(queries)):
            inverted = Inverted([*as_sets(members["tokens"]), *as_sets(queries["asked"])], threshold, len(members))
            if inside:
                leader = names[inner_parts(inverted, known)]
                a += leader[leader != names].tolist()
                b += names[leader != names].tolist()
            for k, node in enumerate(queries["asker"], len(members)):
                hit = inverted.linked(k)
                for part in np.unique(known[hit]).tolist():  # one link to each component is enough
                    a.append(node)
                    b.append(names[hit][known[hit] == part].min())
        return tidied(pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)}), queries, members)

    found = sent.groupBy("grp", "piece").cogroup(opened.groupBy("grp", "piece")).applyInPandas(compare, "a long, b long")
    return links.unionByName(staged(found, "opened"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links, by alternating large and small stars."""
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi != lo").distinct()
    edges = staged(edges, "edges")
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = staged(large, "stars")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).filter("hi != lo").distinct()
        small = staged(small, "stars")
        sums = [d.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("lo", "hi"))).first() for d in (small, edges)]
        edges = small
        if sums[0] == sums[1]:  # distinct edges, equal in number and in two sums
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def jaccard_components(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id for every row of ``docs`` (doc_id, text); class_id is the smallest id with the same set."""
    return settled(docs.sparkSession, "components", lambda: _jaccard_components(docs, width, threshold))


def _jaccard_components(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    facts = staged(screen(docs, width, threshold), "facts")
    classes = facts.filter("near").groupBy("digest").agg(F.min("doc_id").alias("class_id")).withColumn("node", F.xxhash64("digest"))
    classes = staged(classes, "classes")
    ids = classes.select(F.col("class_id").alias("doc_id")).distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = take(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").join(ids, "doc_id", "left_semi")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1).to_pylist(), width)
                keep = [k for k, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array([set_digest(sets[k]) for k in keep], pa.binary()), pa.array([sets[k].tobytes() for k in keep], pa.binary()), pa.array([lowest(sets[k]) for k in keep], pa.list_(pa.int64()))],
                    ["doc_id", "digest", "tokens", "low"],
                )

    read = texts.mapInArrow(tokens, "doc_id long, digest binary, tokens binary, low array<long>").dropDuplicates(["doc_id", "digest"])
    known = classes.join(read.withColumnRenamed("doc_id", "class_id"), ["class_id", "digest"])
    known = staged(known.select("node", (F.octet_length("tokens") / 8).cast("long").alias("n"), "tokens", "low"), "tokens")
    links = class_links(known, threshold)
    member = classes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = staged(member.select("digest", "class_id", "component"), "members")
    least = member.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labels = member.join(least, "component").select("digest", "class_id", "component_id")
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = facts.join(labels, "digest", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select(plain("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), plain("component_id").alias("component_id"), plain("class_id").alias("class_id"))
