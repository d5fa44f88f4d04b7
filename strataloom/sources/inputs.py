"""Inputs from outside: life-cycle payloads, projection batches and query vectors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.functions import text as X

PAYLOAD = "hook_event_name string, session_id string, cwd string, prompt string, last_assistant_message string, compact_summary string, tool_name string, tool_use_id string, turn_id string, agent_id string"


def json_long(payload: Column, path: str) -> Column:
    """A whole number at a path; null where there is none."""
    return F.get_json_object(payload, path).try_cast("long")


def exit_code(payload: Column) -> Column:
    places = ("$.exit_code", "$.tool_response.exit_code", "$.tool_response.metadata.exit_code", "$.tool_result.exit_code", "$.tool_result.metadata.exit_code")
    return F.coalesce(*(json_long(payload, p) for p in places))


def is_error(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.is_error") == "true", F.lit(False)) | F.coalesce(F.get_json_object(payload, "$.tool_response.is_error") == "true", F.lit(False))


def payload_events(payloads: DataFrame, *keep: str) -> DataFrame:
    """Payloads (value: a JSON text) as events: the kept columns, kind, session_id, content, exit_code, is_error, verification and attributes; all are null for broken ones, which stop nothing.

    Works on a stream as on a table.
    """
    v = F.col("value")
    parsed = payloads.withColumn("value", F.when(F.try_parse_json(v).isNotNull(), v)).withColumn("p", F.from_json(v, PAYLOAD))
    name, tool = F.col("p.hook_event_name"), F.col("p.tool_name")
    kind = (
        F.when(v.isNull() | name.isNull(), F.lit(None).cast("string"))
        .when(name == "UserPromptSubmit", "conversation_turn")
        .when(name.isin("PostToolUse", "PostToolUseFailure"), X.tool_kind(F.coalesce(tool, F.lit(""))))
        .when(name.isin("Stop", "PostCompact"), "checkpoint")
        .otherwise("manual_note")
    )
    command = F.get_json_object(v, "$.tool_input.command")
    content = F.coalesce("p.prompt", "p.compact_summary", "p.last_assistant_message", F.get_json_object(v, "$.tool_response"), F.get_json_object(v, "$.tool_result"), F.get_json_object(v, "$.error"), F.lit(""))
    attributes = F.to_json(F.struct(tool.alias("tool_name"), command.alias("command"), exit_code(v).alias("exit_code"), is_error(v).alias("is_error"), F.col("p.turn_id").alias("turn_id"), F.col("p.agent_id").alias("agent_id")))
    verifies = F.coalesce(X.is_verification(command), F.lit(False))
    return parsed.select(*keep, kind.alias("kind"), F.col("p.session_id").alias("session_id"), X.capture(content, X.CAPTURE_BYTES, "\n[... truncated ...]\n").alias("content"), exit_code(v).alias("exit_code"), F.when(v.isNotNull(), is_error(v)).alias("is_error"), verifies.alias("verification"), attributes.alias("attributes"))


def projection_inputs(text: str) -> list[dict]:
    """A batch as a JSON array or as JSON lines."""
    if text.lstrip().startswith("["):
        return json.loads(text)
    return [json.loads(line) for line in text.split("\n") if line.strip()]


def query_vector(text: str) -> tuple[float, ...]:
    found = json.loads(text)
    if not isinstance(found, list) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in found):
        raise ValueError("an array of numbers is needed")
    return tuple(map(float, found))


def read_projections(spark: SparkSession, path: str) -> DataFrame:
    """Projection batches of any size as a table, from JSON lines."""
    return spark.read.schema("memory_id string, revision long, content_hash string, expansions array<string>, vector array<float>").json(path)
