"""Sequential selection on bounded pools: diversity, then packing into a token budget.

A pool has at most 512 records of a query, so both run as one grouped Arrow
function by query; different queries run side by side.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from strataloom import schemas as S
from strataloom.functions.text import cut_to_tokens

_WORD = re.compile(r"\w+")


def token_set(text: str) -> frozenset[str]:
    return frozenset(w for w in (x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in _WORD.findall(text)) if len(w.encode()) > 1)


def similarity(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def diverse(rows: list[tuple[int, float, str]], limit: int, mix: float = S.MMR_LAMBDA) -> list[int]:
    """Ids by maximal marginal relevance from (id, score, text); each pick costs one comparison a row left."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    if len(rows) <= 1 or not limit:
        return [r[0] for r in rows[:limit]]
    top = max(rows[0][1], 2.220446049250313e-16)
    left = [[r[0], r[1] / top, token_set(r[2]), 0.0] for r in rows]
    picked: list[int] = []
    while left and len(picked) < limit:
        best = min(left, key=lambda r: (-(mix * r[1] - (1 - mix) * r[3]), r[0]))
        left.remove(best)
        picked.append(best[0])
        for r in left:
            r[3] = max(r[3], similarity(r[2], best[2]))
    return picked


def tokens(text: str) -> int:
    return max(1, -(-len(text) // 3))


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def line(title: str, body: str, memory_id: int, revision: int, applicability: str) -> str:
    shown = re.sub(r"\r\n?", "\n", escape(body)).replace("\n", "\n  ")
    return f"- {re.sub('[\r\n]', ' ', escape(title))}: {shown} [memory:{memory_id} rev:{revision}; {applicability}]\n"


def packed(hits: list[dict], budget: int) -> tuple[list[dict], str, int]:
    """Accepted hits with their cut bodies, the rendered text and its tokens with the envelope; hits are charged in order, and one that doesn't fit is left out."""
    room = max(0, budget - S.ENVELOPE_TOKENS)
    used, sections, warnings, out = 0, {}, [], []
    for hit in hits:
        place, name = S.SECTIONS[hit["kind"]]
        cost = 0 if place in sections else tokens(f"\n[{name}]\n")
        told = []
        if hit["applicability"] in ("stale", "divergent"):
            told.append(f"Memory {hit['memory_id']} is {hit['applicability']}; verify it against the current repository before acting.")
        if hit["state"] == "contested":
            told.append(f"Memory {hit['memory_id']} is contested by other evidence.")
        cost += tokens("\n[warnings]\n") if told and not warnings else 0
        cost += sum(tokens(f"- {escape(w)}\n") for w in told)
        space = room - used - cost
        if space < 0:
            continue
        low, high, best = 1, max(1, space), None
        while low <= high:
            middle = (low + high) // 2
            body = cut_to_tokens(hit["body"], middle)
            size = tokens(line(hit["title"], body, hit["memory_id"], hit["revision"], hit["applicability"]))
            if body and size <= space:
                best, low = (body, size), middle + 1
            else:
                high = middle - 1
        if best is None:
            continue
        used += cost + best[1]
        warnings += told
        item = hit | {"body": best[0], "tokens": best[1], "section": name, "place": place}
        sections.setdefault(place, []).append(item)
        out.append(item)
    if not out and not warnings:
        return [], "", 0
    text = "".join(f"\n[{items[0]['section']}]\n" + "".join(line(i["title"], i["body"], i["memory_id"], i["revision"], i["applicability"]) for i in items) for _, items in sorted(sections.items()))
    if warnings:
        text += "\n[warnings]\n" + "".join(f"- {escape(w)}\n" for w in warnings)
    return out, text, tokens(text) + min(S.ENVELOPE_TOKENS, budget)


def select_diverse(pool: DataFrame, limit: int) -> DataFrame:
    """query_id, memory_id, pick for a pool of (query_id, memory_id, score, text)."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = diverse([*zip(pdf["memory_id"], pdf["score"], pdf["text"].fillna(""))], limit)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "memory_id": ids, "pick": range(1, len(ids) + 1)})

    name = pool.schema["memory_id"].dataType.simpleString()
    return pool.groupBy("query_id").applyInPandas(choose, f"query_id long, memory_id {name}, pick int")


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """query_id, memory_id, pick, section, body, tokens, rendered_tokens for hits (query_id, pick, memory_id, revision, title, body, kind, state, applicability)."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pick").fillna({"title": "", "body": ""}).to_dict("records")
        out, _, total = packed(rows, budget)
        return pd.DataFrame([(r["query_id"], r["memory_id"], r["pick"], r["section"], r["body"], r["tokens"], total) for r in out], columns=["query_id", "memory_id", "pick", "section", "body", "tokens", "rendered_tokens"])

    name = hits.schema["memory_id"].dataType.simpleString()
    return hits.groupBy("query_id").applyInPandas(pack, f"query_id long, memory_id {name}, pick int, section string, body string, tokens int, rendered_tokens int")
