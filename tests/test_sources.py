import io
import json
import subprocess
import sys

import pytest

from strataloom import __main__ as cli
from strataloom.operators import applicability as A
from strataloom.sources import files, inputs


def test_working_tree(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@x", *a], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("one")
    run("add", "."), run("commit", "-qm", "1")
    first = run("rev-parse", "HEAD")
    (tmp_path / "b [x].rs").write_text("two")
    run("add", "."), run("commit", "-qm", "2")
    second = run("rev-parse", "HEAD")
    (tmp_path / "a.py").write_text("changed")
    (tmp_path / "new.md").write_text("new")
    found = files.discover(str(tmp_path))
    assert (found["branch"], found["head"], found["dirty"]) == ("main", second, True)
    assert files.changed_paths(str(tmp_path)) == ["a.py", "new.md"]
    rows = {r["path"]: r for r in files.hashed(spark, str(tmp_path), ["a.py", "b [x].rs", "gone"]).collect()}
    assert set(rows) == {"a.py", "b [x].rs"} and rows["b [x].rs"]["language"] == "rust" and rows["a.py"]["bytes"] == 7
    assert files.capture_changed(spark, str(tmp_path)).count() == 2 and files.discover("/") is None
    pairs = spark.createDataFrame([(first, second), (second, first), (first, first), ("zz", first)], "stored string, current string")
    told = {(r["stored"], r["current"]): r["relation"] for r in A.relation(pairs, files.commits(spark, str(tmp_path))).collect()}
    assert told == {(first, second): "ancestor", (second, first): "descendant", (first, first): "same", ("zz", first): "unknown"}


def test_payloads(spark):
    rows = [
        {"hook_event_name": "UserPromptSubmit", "prompt": "hi", "session_id": "s"},
        {"hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": "cd x && pytest"}, "tool_result": {"metadata": {"exit_code": 3}}},
        {"hook_event_name": "Stop", "last_assistant_message": "z" * 100_000},
    ]
    got = inputs.payload_events(spark.createDataFrame([(json.dumps(r),) for r in rows] + [("{broken",), (None,)], "value string").coalesce(1)).collect()
    assert [r["kind"] for r in got] == ["conversation_turn", "command_result", "checkpoint", None, None]
    assert (got[1]["exit_code"], got[1]["verification"]) == (3, True) and len(got[2]["content"]) == 64 * 1024
    assert inputs.projection_inputs('[{"a": 1}]') == inputs.projection_inputs('{"a": 1}\n\n') == [{"a": 1}]
    with pytest.raises(ValueError):
        inputs.query_vector('["x"]')


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    def call(*args, text=""):
        monkeypatch.setattr(sys, "stdin", io.StringIO(text))
        cli.main(["--store", str(tmp_path / "s"), *args])
        return json.loads(capsys.readouterr().out.strip().split("\n")[-1])

    made = call("remember", text=json.dumps({"namespace": "n", "title": "Cache size", "body": "The cache holds 40 entries."}))
    assert call("recall", "cache entries", "--namespace", "n")["hits"][0]["memory_id"] == made["memory_id"]
    call("index", "profile", "p", "m")
    assert [r["memory_id"] for r in call("index", "pending", "p")] == [made["memory_id"]]
    call("feedback", made["memory_id"], "helpful", "--namespace", "n")
    assert call("get", made["memory_id"], "--namespace", "other") is None  # outside the caller's scope
    with pytest.raises(SystemExit):  # an id alone opens nothing
        call("feedback", made["memory_id"], "helpful")
    assert call("status")["states"] == {"active": 1}
