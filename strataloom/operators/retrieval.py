"""Candidate channels, fusion and scores over the record model.

Every channel filters by scope, life cycle and validity before its limit, and
gives (memory_id, signal, rank).  Limits are top-k sorts, small sides are
broadcast by Spark's own size rules, and texts are scanned once: a channel
keeps only the query's terms of each text before anything is exploded.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom import schemas as S
from strataloom.functions import text as X
from strataloom.functions import vectors as V
from strataloom.operators import signatures
from strataloom.sources.corpus import NOW, Corpus
from strataloom.sources.scratch import staged


@dataclass(frozen=True)
class Request:
    """A query against the records."""

    query: str
    namespace: str
    workspace_id: str | None = None
    repo_id: str | None = None
    as_of_ms: int = NOW
    kinds: tuple[str, ...] = ()
    include_superseded: bool = False
    include_stale: bool = False
    include_divergent: bool = False
    entities: tuple[str, ...] = ()
    error_fingerprint: str | None = None
    vector: tuple[float, ...] | None = None
    min_similarity: float = 0.0
    limit: int = S.RECALL_LIMIT
    budget: int = S.RECALL_BUDGET
    branch: str | None = None
    head_commit: int | None = None
    artifacts: dict = field(default_factory=dict)

    def bounded(self) -> tuple[int, int]:
        """Limit and budget within their ranges."""
        return min(100, max(1, self.limit)), min(100_000, max(64, self.budget))


def visible(request: Request) -> Column:
    """What a caller of this scope may see; branches are not part of it."""
    workspace = F.col("workspace_id").isNull() | (F.col("workspace_id") == F.lit(request.workspace_id) if request.workspace_id is not None else F.lit(False))
    repo = F.col("repo_id").isNull() | (F.col("repo_id") == F.lit(request.repo_id) if request.repo_id is not None else F.lit(False))
    return (F.col("namespace") == request.namespace) & workspace & repo


def valid_at(at_ms: int) -> Column:
    """Half-open intervals with open ends where null."""
    return F.coalesce(F.col("valid_from_ms") <= at_ms, F.lit(True)) & F.coalesce(F.lit(at_ms) < F.col("valid_until_ms"), F.lit(True)) & F.coalesce(F.lit(at_ms) < F.col("expires_at_ms"), F.lit(True))


def eligible(heads: DataFrame, request: Request) -> DataFrame:
    out = heads.filter(visible(request)).filter((F.col("state") != "retracted") & valid_at(request.as_of_ms))
    if not request.include_superseded:
        out = out.filter(F.col("state") != "superseded")
    return out.filter(F.col("kind").isin(*request.kinds)) if request.kinds else out


def open_rows(corpus: Corpus, request: Request) -> DataFrame:
    """What channels read of the eligible records: id, revision, hash and sequence number."""
    return eligible(corpus.heads, request).select("memory_id", F.col("head_revision").alias("revision"), "content_hash", "updated_seq")


def terms_of(query: str, most: int) -> list[str]:
    """Distinct terms of two bytes or more in order of appearance, without and, or, not and near; runs of 64 bytes are cut."""
    out: list[str] = []
    for run in re.findall(r"\w+", query):
        current = ""
        for c in run.lower() + "\0":
            full = len(current.encode()) >= 64
            if c == "\0" or full:
                if len(current.encode()) >= 2 and current not in ("and", "or", "not", "near") and current not in out:
                    out.append(current)
                current = ""
            if c != "\0":
                current += c
    return out[:most]


def phrase_words(term: str) -> list[str]:
    """A query's term as words that follow each other."""
    return X.phrase(term).split()


def identifier_terms(query: str) -> list[str]:
    """Words that look like names: with a slash, underscore, double colon or capital; sorted, in lower case."""
    words = (w.strip("\"'`") for w in re.split(r"[\s,;()\[\]]+", query))
    return sorted({w.lower() for w in words if w and (re.search(r"[/\\_]|::", w) or any(c.isupper() for c in w))})


def current(corpus: Corpus) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The heads that are not retracted, and the tags, entities and artifact references of their revisions."""
    head = corpus.heads.filter("state != 'retracted'")
    own = head.select("memory_id", F.col("head_revision").alias("revision"))
    return head, *(part.join(own, ["memory_id", "revision"], "left_semi") for part in (corpus.tags, corpus.entities, corpus.memory_artifacts))


def fields(corpus: Corpus) -> DataFrame:
    """The searchable fields of every record that is not retracted."""
    def listed(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy("memory_id").agg(F.array_join(F.sort_array(F.collect_list(value)), " ").alias(name))

    head, tags, entities, used = current(corpus)
    tags = listed(tags, F.col("tag"), "tags")
    entities = listed(entities, F.concat_ws(" ", "canonical", "display"), "entities")
    paths = listed(used.join(corpus.artifacts.select("artifact_id", "path"), "artifact_id"), F.col("path"), "paths")
    out = head.select("memory_id", "title", "body")
    for part in (tags, entities, paths):
        out = out.join(part, "memory_id", "left")
    return out.fillna("", ["tags", "entities", "paths"])


def bm25(indexed: DataFrame, terms: list[str], columns: dict[str, float], every: tuple[str, ...], key: str = "memory_id") -> DataFrame:
    """key, hits (number of the query's terms found in the columns) and bm25, lower is better, over rows of text fields.

    Number of rows and mean length are those of the whole table; a row's length counts all of ``every``.
    """
    split = indexed.select(key, *(X.searchable(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in every))
    length = sum((X.word_count(F.col(c)) for c in every[1:]), X.word_count(F.col(every[0])))
    counts = F.array(*(sum((F.lit(w) * X.occurrences(F.col(c), X.phrase(t)) for c, w in columns.items()), F.lit(0.0)) for t in terms))
    rows = staged(split.select(key, length.alias("length"), counts.alias("counts")), "terms")  # narrow: the texts are read once
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    return score_counts(rows.filter(F.exists("counts", lambda x: x > 0)), len(terms), F.lit(n), F.lit(mean), key)


def score_counts(rows: DataFrame, terms: int, n: Column, mean: Column, key: str = "memory_id") -> DataFrame:
    """key, hits and bm25 of rows (key, length, counts) that have a term, among n rows of a mean length."""
    df = rows.agg(*(F.sum((F.col("counts")[k] > 0).cast("long")).alias(f"df{k}") for k in range(terms)))
    rows = rows.crossJoin(F.broadcast(df))  # one row of statistics
    score = F.lit(0.0)
    for k in range(terms):
        rarity = F.log((n - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        rarity = F.when(rarity > 0, rarity).otherwise(1e-6)
        f = F.col("counts")[k]
        score = score - F.when(f > 0, rarity * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("length") / mean))).otherwise(0.0)
    return rows.select(key, F.size(F.filter("counts", lambda x: x > 0)).alias("hits"), score.alias("bm25"))


def ranked(rows: DataFrame, order: list[Column], signal: str, limit: int) -> DataFrame:
    """The first rows by an order as (memory_id, signal, rank)."""
    first = rows.orderBy(*order).limit(limit)
    return first.select("memory_id", F.lit(signal).alias("signal"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


#: Stands for a query without terms: a word that no text has.
NO_TERM = ["\u2400"]
TEXT_FIELDS = ("title", "body", "tags", "entities", "paths")


def lexical(corpus: Corpus, request: Request, strict: bool, indexed: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """BM25 over all fields: any of 24 terms, or all of the first 8 where there are two or more."""
    terms = terms_of(request.query, 8 if strict else 24)
    found = term_scores(corpus, terms) if indexed is None else indexed
    if strict:
        found = found.filter((F.col("hits") == len(terms)) & F.lit(len(terms) >= 2))
    found = found.join((open_rows(corpus, request) if live is None else live).select("memory_id"), "memory_id", "left_semi")
    return ranked(found, [F.col("bm25"), F.col("memory_id")], "lexical_strict" if strict else "lexical", S.CHANNEL_LIMIT)


def term_scores(corpus: Corpus, terms: list[str]) -> DataFrame:
    if (index := getattr(corpus, "text_index", None)) is not None:
        return index.scores(terms, {c: S.FIELD_WEIGHTS[c] for c in TEXT_FIELDS})
    return bm25(fields(corpus), terms or NO_TERM, {c: S.FIELD_WEIGHTS[c] for c in TEXT_FIELDS}, TEXT_FIELDS)


EXACT_FIELDS = ("title", "body")


def exact(corpus: Corpus, request: Request) -> DataFrame:
    """Title or body has the query, by ASCII case: by BM25 over both where the query has terms, of which one must be there as a word, else newest first."""
    needle, terms = request.query.strip(), terms_of(request.query, 24)
    rows = eligible(corpus.heads, request).filter(X.contains_folded(F.col("title"), needle) | X.contains_folded(F.col("body"), needle))
    if len(needle.encode()) < 2:
        rows = rows.limit(0)
    if not terms:
        return ranked(rows, [F.col("updated_seq").desc(), F.col("memory_id")], "exact", S.CHANNEL_LIMIT)
    weights = {c: S.FIELD_WEIGHTS[c] for c in EXACT_FIELDS}
    index = getattr(corpus, "text_index", None)
    found = bm25(fields(corpus), terms, weights, TEXT_FIELDS) if index is None else index.scores(terms, weights)
    return ranked(rows.select("memory_id").join(found, "memory_id"), [F.col("bm25"), F.col("memory_id")], "exact", S.CHANNEL_LIMIT)


def alias_inputs(corpus: Corpus) -> DataFrame:
    """memory_id, revision, title, body and the structured names that aliases are made of: tags, entities' kinds and names, artifacts' paths and symbols."""
    head, tags, entities, used = current(corpus)
    used = used.join(corpus.artifacts.select("artifact_id", "path", "symbol"), "artifact_id")
    names = tags.select("memory_id", F.col("tag").alias("name"))
    for part in (entities.select("memory_id", F.explode(F.array("entity_kind", "canonical", "display")).alias("name")), used.select("memory_id", F.explode(F.array("path", "symbol")).alias("name"))):
        names = names.unionByName(part)
    structured = names.filter("name is not null").groupBy("memory_id").agg(F.sort_array(F.collect_set("name")).alias("structured"))
    return head.join(structured, "memory_id", "left").select("memory_id", F.col("head_revision").alias("revision"), "title", "body", "structured")


def alias_texts(corpus: Corpus) -> DataFrame:
    """memory_id and the aliases that its texts and names give."""
    from strataloom.functions.aliases import alias_text

    return alias_inputs(corpus).select("memory_id", alias_text("title", "body", "structured").alias("aliases"))


def alias_scores(corpus: Corpus, terms: list[str]) -> DataFrame:
    """BM25 over generated aliases alone."""
    weights = {"aliases": S.FIELD_WEIGHTS["aliases"]}
    if (index := getattr(corpus, "alias_index", None)) is not None:
        return index.scores(terms, weights)
    return bm25(alias_texts(corpus), terms or NO_TERM, weights, ("aliases",))


def code_alias(corpus: Corpus, request: Request, strict: bool, indexed: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """BM25 over generated aliases alone."""
    terms = terms_of(request.query, 8 if strict else 24)
    found = alias_scores(corpus, terms) if indexed is None else indexed
    if strict:
        found = found.filter((F.col("hits") == len(terms)) & F.lit(len(terms) >= 2))
    found = found.join((open_rows(corpus, request) if live is None else live).select("memory_id"), "memory_id", "left_semi")
    return ranked(found, [F.col("bm25"), F.col("memory_id")], "code_alias_strict" if strict else "code_alias", S.CHANNEL_LIMIT)


def expansion(corpus: Corpus, request: Request, live: DataFrame | None = None) -> DataFrame:
    """BM25 over expansion texts of current projections of active profiles; the best of a record's profiles counts."""
    texts = corpus.expansions.withColumn("row", F.struct("memory_id", "profile"))
    terms, weights = terms_of(request.query, 24), {"expansions": S.FIELD_WEIGHTS["expansions"]}
    if (index := getattr(corpus, "expansion_index", None)) is not None:
        found = index.scores(terms, weights)
    else:
        found = bm25(texts, terms or NO_TERM, weights, ("expansions",), key="row")
    heads = (open_rows(corpus, request) if live is None else live).drop("updated_seq")
    alive = texts.filter("active").join(heads, ["memory_id", "revision", "content_hash"]).select("row", "memory_id")
    best = found.join(alive, "row").groupBy("memory_id").agg(F.min("bm25").alias("bm25"))
    return ranked(best, [F.col("bm25"), F.col("memory_id")], "semantic_expansion", S.CHANNEL_LIMIT)


def listed(rows: DataFrame, group: list[str], signal: str) -> DataFrame:
    """Rows ranked in each list by newest first, 256 at most; a record keeps its best rank."""
    order = Window.partitionBy(*group).orderBy(F.col("updated_seq").desc(), "memory_id")
    first = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= S.TERM_LIMIT)
    return first.groupBy("memory_id").agg(F.min("rank").alias("rank")).select("memory_id", F.lit(signal).alias("signal"), "rank")


def terms_frame(corpus: Corpus, terms: list[str]) -> DataFrame:
    return F.broadcast(corpus.spark.createDataFrame([(t,) for t in terms], "term string"))  # a query's terms, 16 at most


def sparse(corpus: Corpus, request: Request, live: DataFrame | None = None) -> DataFrame:
    """Identifier terms in artifact paths and symbols, and as tags."""
    terms = terms_frame(corpus, identifier_terms(request.query)[:8])
    heads = (open_rows(corpus, request) if live is None else live).drop("content_hash")
    used = corpus.memory_artifacts.join(corpus.artifacts, "artifact_id")
    by_path = used.join(terms, X.contains(F.col("path"), F.col("term")) | (X.ascii_lower(F.col("symbol")) == F.col("term")))
    by_tag = corpus.tags.join(terms, X.ascii_lower(F.col("tag")) == F.col("term"))
    both = by_path.select("memory_id", "revision", "term", F.lit("path").alias("list")).unionByName(by_tag.select("memory_id", "revision", "term", F.lit("tag").alias("list"))).distinct()
    return listed(both.join(heads, ["memory_id", "revision"]), ["term", "list"], "sparse")


def entity(corpus: Corpus, request: Request, live: DataFrame | None = None) -> DataFrame:
    """Entities whose canonical name or display name, by ASCII case, is a term or a hint."""
    wanted = sorted({*(e.lower() for e in request.entities), *identifier_terms(request.query)})[:16]
    terms = terms_frame(corpus, wanted)
    heads = (open_rows(corpus, request) if live is None else live).drop("content_hash")
    keys = F.array_distinct(F.array(F.col("canonical"), X.ascii_lower(F.col("display"))))
    named = corpus.entities.select("memory_id", "revision", F.explode(keys).alias("term")).join(terms, "term").distinct()
    return listed(named.join(heads, ["memory_id", "revision"]), ["term"], "entity")


def error_fingerprint(corpus: Corpus, request: Request, live: DataFrame | None = None) -> DataFrame:
    """Records whose event's attribute is the request's fingerprint, newest first."""
    found = corpus.fingerprints.filter(F.col("fingerprint") == request.error_fingerprint).select("memory_id").distinct()
    rows = (open_rows(corpus, request) if live is None else live).join(found, "memory_id")
    return ranked(rows, [F.col("updated_seq").desc(), F.col("memory_id")], "error_fingerprint", S.CHANNEL_LIMIT)


def dense(corpus: Corpus, request: Request, exact_limit: int | None = None, live: DataFrame | None = None) -> DataFrame:
    """Cosine of all current vectors; with an ``exact_limit``, beyond so many eligible ones only of the nearest by signature."""
    query = F.array(*(F.lit(float(x)).cast("float") for x in request.vector))
    heads = (open_rows(corpus, request) if live is None else live).drop("updated_seq")
    rows = corpus.projections.filter("vector is not null").join(heads, ["memory_id", "revision", "content_hash"]).filter(V.is_valid(F.col("vector")))
    if exact_limit is not None and rows.limit(exact_limit + 1).count() > exact_limit:
        if (index := getattr(corpus, "signature_index", None)) is not None:
            near = index.nearest(signatures.of_vector(request.vector), S.CHANNEL_LIMIT, heads.select(*index.key))
            rows = rows.join(F.broadcast(near), index.key, "left_semi")  # of the channel's size
        else:
            rows = rows.withColumn("distance", V.hamming(V.signature("vector"), V.signature(query))).orderBy("distance", "memory_id").limit(S.CHANNEL_LIMIT)
    rows = rows.withColumn("cosine", V.cosine(F.col("vector"), query)).filter(F.col("cosine") >= request.min_similarity)
    return ranked(rows, [F.col("cosine").desc(), F.col("memory_id")], "dense", S.CHANNEL_LIMIT)


def recent(corpus: Corpus, request: Request, live: DataFrame | None = None) -> DataFrame:
    return ranked(open_rows(corpus, request) if live is None else live, [F.col("updated_seq").desc(), F.col("memory_id")], "recency", S.RECENT_LIMIT)


def channels(corpus: Corpus, request: Request, generated: bool = False) -> DataFrame:
    """The union of all channels that the request gives something to; ``generated``: also those over aliases and expansions.

    Where both lexical ones have the same terms, the texts are scanned for them once.
    """
    terms = terms_of(request.query, 24)
    scanned = getattr(corpus, "text_index", None) is None  # scores from postings are not worth writing down
    once = staged if scanned else lambda df, name: df
    indexed = once(term_scores(corpus, terms), "bm25") if len(terms) <= 8 else None
    live = staged(open_rows(corpus, request), "eligible")
    made = [exact(corpus, request), lexical(corpus, request, True, indexed, live), lexical(corpus, request, False, indexed, live), sparse(corpus, request, live), entity(corpus, request, live), recent(corpus, request, live)]
    if generated:
        aliased = once(alias_scores(corpus, terms), "aliases") if len(terms) <= 8 else None
        made += [code_alias(corpus, request, True, aliased, live), code_alias(corpus, request, False, aliased, live), expansion(corpus, request, live)]
    if request.error_fingerprint:
        made.append(error_fingerprint(corpus, request, live))
    if request.vector:
        made.append(dense(corpus, request, live=live))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return staged(out, "ranks")


def fused(ranks: DataFrame) -> DataFrame:
    """memory_id, base and signals: reciprocal ranks by weight, the best rank of each signal, summed in a fixed order."""
    best = ranks.groupBy("memory_id").agg(*(F.min(F.when(F.col("signal") == name, F.col("rank"))).alias(name) for name, _, _ in S.SIGNALS))
    base = F.lit(0.0)
    for name, weight, _ in S.SIGNALS:
        base = base + F.coalesce(F.lit(weight) / (S.RRF_K + F.col(name)), F.lit(0.0))
    signals = F.filter(F.array(*(F.when(F.col(name).isNotNull(), F.lit(name)) for name, _, _ in S.SIGNALS)), lambda x: x.isNotNull())
    return best.select("memory_id", base.alias("base"), signals.alias("signals"))


def candidates(ranks: DataFrame) -> DataFrame:
    """The best 1,024 by fused ranks."""
    return fused(ranks).orderBy(F.col("base").desc(), "memory_id").limit(S.CANDIDATES)


def with_verified(rows: DataFrame) -> DataFrame:
    """Rows with base, signals and ``verified``: where all of a record's stored hashes are current, that is one more signal, at rank 1."""
    verified, name = F.coalesce("verified", F.lit(False)), "artifact_verified"
    weight = next(w for n, w, _ in S.SIGNALS if n == name)
    order = F.array(*(F.lit(n) for n, _, _ in S.SIGNALS))
    signals = F.filter(order, lambda n: F.array_contains("signals", n) | (n == name))
    return rows.withColumns({"base": F.when(verified, F.col("base") + weight / (S.RRF_K + 1)).otherwise(F.col("base")), "signals": F.when(verified, signals).otherwise(F.col("signals"))})


def looked_up(column: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(column == name, float(value)).otherwise(out)
    return out


def temporal(kind: Column, updated_at_ms: Column, now_ms: int) -> Column:
    """1 for kinds that don't age, else from 1 down to a quarter by half-lives of whole seconds' age."""
    age = F.greatest(F.lit(0), F.floor((F.lit(now_ms) - updated_at_ms) / 1000)).cast("double") / 86_400.0
    half = looked_up(kind, S.HALF_LIFE_DAYS)
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * F.pow(F.lit(2.0), -age / half), F.lit(1.0))


def utility(feedback: DataFrame) -> DataFrame:
    """memory_id and utility: the Laplace posterior of positive signals, from -0.1 to 0.1."""
    counts = feedback.groupBy("memory_id").agg(F.count_if(F.col("signal").isin(*S.POSITIVE_FEEDBACK)).alias("p"), F.count_if(F.col("signal").isin(*S.NEGATIVE_FEEDBACK)).alias("n"))
    return counts.select("memory_id", (((F.col("p") + 1.0) / (F.col("p") + F.col("n") + 2.0) - 0.5) * 0.20).alias("utility"))


def scored(rows: DataFrame, now_ms: int) -> DataFrame:
    """Adds score and reasons to rows with base, signals, importance, confidence, state, kind, updated_at_ms, trust, applicability and utility."""
    quality = F.lit(0.75) + F.col("importance").cast("double") * 0.15 + F.col("confidence").cast("double") * 0.10
    use = F.greatest(F.lit(0.5), F.lit(1.0) + F.greatest(F.lit(-0.10), F.least(F.lit(0.10), F.coalesce("utility", F.lit(0.0)))))
    score = F.col("base") * quality * looked_up(F.col("state"), S.STATES) * temporal(F.col("kind"), F.col("updated_at_ms"), now_ms) * looked_up(F.col("trust"), S.TRUST)
    score = score * looked_up(F.col("applicability"), S.APPLICABILITY) * use
    names = F.create_map(*(F.lit(x) for name, _, reason in S.SIGNALS for x in (name, reason)))
    why = F.create_map(*(F.lit(x) for pair in S.APPLICABILITY_REASONS.items() for x in pair))
    reasons = F.concat(F.transform("signals", lambda s: F.element_at(names, s)), F.array(F.element_at(why, F.col("applicability"))))
    return rows.withColumn("score", F.round(score, 9)).withColumn("reasons", reasons)


def pool_size(limit: int) -> int:
    return min(S.POOL_MOST, max(S.POOL_LEAST, 4 * limit))


def metrics(ranks: DataFrame, judged: DataFrame, at: int = 10) -> DataFrame:
    """query_id, mrr, recall and ndcg at a depth, from ranks (query_id, doc_id, rank) and grades (query_id, doc_id, grade)."""
    found = judged.join(ranks.filter(F.col("rank") <= at), ["query_id", "doc_id"], "left")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "doc_id"))
    found = found.withColumn("place", best)
    ideal = F.sum(F.when(F.col("place") <= at, gain / F.log2(F.col("place") + 1.0)))
    return found.groupBy("query_id").agg(
        F.round(F.coalesce(F.max(F.when(F.col("grade") == 3, 1.0 / F.col("rank"))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce(F.count_if((F.col("grade") >= 2) & F.col("rank").isNotNull()) / F.nullif(F.count_if(F.col("grade") >= 2), F.lit(0)), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.sum(gain / F.log2(F.col("rank") + 1.0)) / F.nullif(ideal, F.lit(0.0)), F.lit(0.0)), 6).alias("ndcg"),
    )


