"""Alternate spellings of code-shaped names, error identifiers and coding concepts."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TERMS, MAX_BYTES, MAX_TERM_BYTES = 512, 8192, 64

# Phrases, of which up to one other word may stand between two, and their identifiers.
PHRASES = {
    "out of memory": "oom outofmemory",
    "file not found": "enoent filenotfound",
    "permission denied": "eacces permissiondenied",
    "connection refused": "econnrefused",
    "connection reset": "econnreset",
    "database locked": "sqlitebusy sqlitelocked",
    "stack overflow": "stackoverflow",
    "null pointer exception": "nullpointerexception",
    "unique constraint": "uniqueconstraint",
    "foreign key constraint": "foreignkeyconstraint",
}
# Terms, any of which brings the expansions.
CONCEPTS = (
    ("cfg", "config configuration"),
    ("repo", "repository"),
    ("deps", "dependency dependencies"),
    ("cli", "command line interface"),
    ("db database", "db database"),
    ("fs", "filesystem"),
    ("authn", "authentication"),
    ("authz", "authorization"),
    ("oom outofmemory outofmemoryerror", "memoryexhaustion allocationfailure"),
    ("sigsegv segfault segmentationfault", "segmentationfault invalidmemoryaccess"),
    ("enoent", "filenotfound missingpath"),
    ("eacces eperm", "permissiondenied accessdenied"),
    ("etimedout timedout deadlineexceeded", "timeout deadlineexceeded"),
    ("econnrefused", "connectionrefused"),
    ("econnreset", "connectionreset"),
    ("eaddrinuse", "addressinuse occupied portinuse"),
    ("sqlitebusy sqlitelocked", "contention database databaselocked lockcontention"),
    ("deadlock", "lockcontention"),
    ("await awaited awaiting awaits", "suspend suspension"),
    ("spawn spawned spawning", "launch task"),
    ("sqlxoffline", "compilewithoutdatabase database offlinebuild"),
    ("bounded", "backpressure memorygrowth ram"),
    ("duplicatekey uniqueconstraint", "uniquenessviolation"),
    ("foreignkeyconstraint", "referentialintegrity"),
    ("nullpointerexception nilpointer nullreferenceexception", "nullreference nilpointer"),
    ("useafterfree", "danglingpointer memorysafety"),
    ("bufferoverflow indexoutofbounds outofbounds", "boundscheck outofbounds"),
    ("stackoverflow", "callstack recursionlimit"),
    ("http401", "unauthorized authentication"),
    ("http403", "forbidden authorization"),
    ("http404", "notfound"),
    ("http429", "ratelimit throttled"),
)
#: Of each phrase: its words, how it stands among a sentence's terms, and its identifiers.
_SHAPES = [(tuple(p.split()), re.compile(" " + "(?: [a-z0-9]+)? ".join(p.split()) + " "), frozenset(found.split())) for p, found in PHRASES.items()]
_TRIGGERS = [(frozenset(triggers.split()), frozenset(found.split())) for triggers, found in CONCEPTS]
#: Terms that a concept looks for or leaves out; nothing depends on other observed ones.
_TOLD = frozenset().union(*(a | b for a, b in _TRIGGERS))
#: Words whose terms a worker keeps; most are seen again and again.
_KNOWN = 1 << 16
_UNIT = re.compile(r"[^\W_]+(?:[_:-]+[^\W_]+)*")
_WORD, _SENTENCE = re.compile(r"[^\W_]+"), re.compile(r"[.!?;\n]")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_]+")


@lru_cache(_KNOWN)
def term(word: str) -> str | None:
    """A word as a term: ASCII letters and digits in lower case, 2 to 64; no numbers but of 2 to 5 digits, no long hexadecimal digests."""
    if not word.isascii():
        return None
    plain = word.lower() if word.isalnum() else re.sub("[^a-z0-9]", "", word.lower())
    if not 2 <= len(plain) <= MAX_TERM_BYTES or (plain.isdigit() and len(plain) > 5) or (len(plain) >= 24 and re.fullmatch("[0-9a-f]{24,}", plain)):
        return None
    return plain


@lru_cache(_KNOWN)
def _unit(unit: str) -> tuple[str | None, frozenset[str] | None]:
    """A name as one term, and the terms of its parts; none where it has one part."""
    if unit.isascii() and unit.isalpha() and unit.islower():
        return term(unit), None
    parts = [h for piece in re.split("[_:-]+", unit) for h in _HUMP.findall(piece)]
    return term(unit), frozenset(filter(None, map(term, parts))) if len(parts) > 1 else None


def _names(text: str, observed: set[str], aliases: set[str]) -> None:
    for unit in set(_UNIT.findall(text)):
        if unit[1:].islower() and unit.isascii() and unit.isalpha() and unit.lower() not in _TOLD:
            continue  # most words: of one part, so no alias
        whole, parts = _unit(unit)
        if whole:
            observed.add(whole)
            if parts is not None:
                observed.update(parts)
                aliases.add(whole)
                aliases.update(parts)


def _phrases(text: str, aliases: set[str]) -> None:
    whole = text.lower()
    wanted = [shape for shape in _SHAPES if all(w in whole for w in shape[0])]
    if not wanted:
        return
    there = {term(w) for w in set(_WORD.findall(text))}
    wanted = [shape for shape in wanted if there.issuperset(shape[0])]
    if not wanted:
        return
    for sentence in _SENTENCE.split(text):
        low = sentence.lower()
        near = [shape for shape in wanted if all(w in low for w in shape[0])]
        if near:
            line = " " + " ".join(filter(None, map(term, _WORD.findall(sentence)))) + " "
            for _, shape, found in near:
                if shape.search(line):
                    aliases.update(found)


def code_aliases(title: str, body: str, structured: Iterable[str] = ()) -> str:
    """The aliases of a record: concepts first, then of structured values, title and body, each sorted, as many as fit."""
    tiers: list[set[str]] = [set(), set(), set(), set()]
    observed: set[str] = set()
    for tier, sources in ((1, sorted(set(structured))), (2, [title or ""]), (3, [body or ""])):
        for source in sources:
            _names(source, observed, tiers[tier])
    for source in (title or "", body or ""):
        _phrases(source, tiers[0])
    for known in (observed, tiers[0]):
        for triggers, found in _TRIGGERS:
            if not known.isdisjoint(triggers):
                tiers[0].update(found - observed)
    out, size = [], 0
    seen: set[str] = set()
    for tier in tiers:
        for word in sorted(tier):
            if word in seen or len(out) == MAX_TERMS or size + bool(out) + len(word) > MAX_BYTES:
                continue
            size += bool(out) + len(word)
            out.append(word)
            seen.add(word)
    return " ".join(out)


@F.pandas_udf(T.StringType())
def alias_text(title: pd.Series, body: pd.Series, structured: pd.Series) -> pd.Series:
    return pd.Series([code_aliases(t, b, () if s is None else [x for x in s if x]) for t, b, s in zip(title, body, structured)])
