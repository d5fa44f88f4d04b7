"""A command line over a store: ``python -m strataloom --store FOLDER COMMAND ...``; requests and results are JSON."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataloom")
    top.add_argument("--store", required=True)
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("observe", "remember", "checkpoint", "checkpoint-session"):
        commands.add_parser(name, help="read a request as JSON from standard input")
    recall = commands.add_parser("recall")
    recall.add_argument("query")
    for name in ("namespace", "workspace-id", "repo-id", "branch", "head-commit", "error-fingerprint", "dense-vector-file"):
        recall.add_argument(f"--{name}", required=name == "namespace")
    recall.add_argument("--kinds", nargs="*", default=[])
    recall.add_argument("--entities", nargs="*", default=[])
    recall.add_argument("--limit", type=int, default=12)
    recall.add_argument("--budget", type=int, default=1500)
    recall.add_argument("--as-of-ms", type=int)
    for name in ("stale", "divergent", "superseded"):
        recall.add_argument(f"--include-{name}", action="store_true")
    for name in ("get", "history", "retract", "feedback"):
        one = commands.add_parser(name)
        one.add_argument("memory_id")
        if name == "feedback":
            one.add_argument("signal")
        for part in ("namespace", "workspace-id", "repo-id"):
            one.add_argument(f"--{part}", required=part == "namespace")
    commands.add_parser("status")
    for name in ("export", "import"):
        commands.add_parser(name).add_argument("path")
    index = commands.add_parser("index").add_subparsers(dest="action", required=True)
    add = index.add_parser("profile")
    add.add_argument("profile_id")
    add.add_argument("model_digest")
    add.add_argument("--dimensions", type=int)
    for name in ("pending", "activate", "deactivate", "register"):
        index.add_parser(name).add_argument("profile_id")
    for name in ("profiles", "status"):
        index.add_parser(name)
    return top


def answer(store, args, text: str):
    import time

    from strataloom.operators.retrieval import Request
    from strataloom.sources.inputs import projection_inputs, query_vector

    if args.command in ("observe", "remember", "checkpoint", "checkpoint-session"):
        return getattr(store, args.command.replace("-", "_"))(json.loads(text))
    if args.command == "recall":
        vector = query_vector(open(args.dense_vector_file).read()) if args.dense_vector_file else None
        names = ("query", "namespace", "workspace_id", "repo_id", "branch", "head_commit", "error_fingerprint", "limit", "budget", "include_stale", "include_divergent", "include_superseded")
        now = args.as_of_ms if args.as_of_ms is not None else int(time.time() * 1000)
        found = store.recall(Request(**{n: getattr(args, n) for n in names}, kinds=tuple(args.kinds), entities=tuple(args.entities), vector=vector, as_of_ms=now))
        keep = ("memory_id", "revision", "title", "body", "kind", "state", "score", "applicability", "signals", "reasons", "tokens")
        return found | {"hits": [{k: h[k] for k in keep} for h in found["hits"]]}
    if args.command in ("get", "history", "retract", "feedback"):
        scope = {n: getattr(args, n) for n in ("namespace", "workspace_id", "repo_id")}
        if args.command == "feedback":
            return store.give_feedback(args.memory_id, args.signal, scope)
        if args.command == "history":
            return store.history(args.memory_id) if store.get(args.memory_id, scope) else None
        return store.get(args.memory_id, scope) if args.command == "get" else store.retract(args.memory_id, scope=scope)
    if args.command == "status":
        return store.status()
    if args.command in ("export", "import"):
        return (store.export if args.command == "export" else store.load)(args.path)
    if args.action == "profile":
        return store.register_profile(args.profile_id, args.model_digest, args.dimensions)
    if args.action == "pending":
        return [r.asDict() for r in store.pending(args.profile_id).select("memory_id", "head_revision", "content_hash", "title", "body").collect()]
    if args.action in ("activate", "deactivate"):
        return store.activate_profile(args.profile_id, args.action == "activate")
    if args.action == "register":
        return store.register_projections(args.profile_id, projection_inputs(text))
    return [r.asDict() for r in store.profiles.orderBy("profile_id").collect()] if args.action == "profiles" else store.coverage()


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from strataloom.store import Store

    args = parser().parse_args(argv)
    needs = args.command in ("observe", "remember", "checkpoint", "checkpoint-session") or getattr(args, "action", "") == "register"
    spark = SparkSession.builder.appName("strataloom").getOrCreate()
    print(json.dumps(answer(Store(spark, args.store), args, sys.stdin.read() if needs else ""), default=str))


if __name__ == "__main__":
    main()
