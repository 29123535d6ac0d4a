"""The commands over transcript folders of both formats."""

import json

import pytest

from trailspark.__main__ import main

A = "0a0a0a0a-0000-0000-0000-00000000000{}"


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    root = tmp_path_factory.mktemp("roots")
    for s in (1, 2):
        f = root / "a" / "proj" / f"{A.format(s)}.jsonl"
        f.parent.mkdir(parents=True, exist_ok=True)
        rows = [{"type": "user", "message": {"role": "user", "content": "fix the parser in src/a/b.ts please"}}, {"type": "assistant", "message": {"id": f"m{s}", "content": [{"type": "tool_use", "id": f"c{s}", "name": "Bash", "input": {"command": "git commit -m x"}}, {"type": "tool_use", "id": f"d{s}", "name": "Edit", "input": {}}], "usage": {"input_tokens": 1}}}, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": f"c{s}", "content": "ok", "is_error": True}]}}, {"type": "user", "message": {"content": "no, fix the parser in src/a/b.ts please"}}]
        f.write_text("".join(json.dumps(r | {"uuid": f"u{s}-{i}", "sessionId": A.format(s), "timestamp": f"2026-06-01T00:00:0{i}Z", "cwd": "/w"}) + "\n" for i, r in enumerate(rows)))
    b = root / "b" / "2026" / "rollout-x-0b0b0b0b-0000-0000-0000-000000000001.jsonl"
    b.parent.mkdir(parents=True)
    lines = [("event_msg", {"type": "user_message", "message": "explain the parser"}), ("event_msg", {"type": "task_started", "turn_id": "t"}), ("response_item", {"type": "function_call", "call_id": "q", "name": "shell", "arguments": "{\"cmd\":\"ls\"}"}), ("event_msg", {"type": "task_complete", "duration_ms": 9})]
    b.write_text("".join(json.dumps({"timestamp": f"2026-06-01T00:00:0{i}Z", "type": t, "payload": p}) + "\n" for i, (t, p) in enumerate(lines)))
    return root


def run(capsys, roots, *args):
    assert main([*args, "--a", str(roots / "a"), "--b", str(roots / "b"), "--json"]) == 0
    return json.loads(capsys.readouterr().out)


def test_reports(spark, capsys, roots):
    assert len(run(capsys, roots, "list")["sessions"]) == 3
    got = {r["session_id"]: r for r in run(capsys, roots, "analyze")["sessions"]}
    assert (got[A.format(1)]["steps"], got[A.format(1)]["tool_calls"], got[A.format(1)]["tool_errors"], got[A.format(1)]["api_calls"]) == (2, 2, 1, 1) and len(got) == 3
    assert {r["rule"] for r in run(capsys, roots, "prompter")["rules tripped"]} >= {"correction-heavy"}
    d = run(capsys, roots, "distill")
    assert {(r["kind"], r["members"], r["sessions"]) for r in d["recurring prompts"]} == {("directive", 2, 2), ("correction", 2, 2)}
    assert run(capsys, roots, "intents")["intents"] == [{"intent": "bugfix", "sessions": 2}, {"intent": "learning", "sessions": 1}]
    assert sum(r["git_commits"] for r in run(capsys, roots, "project")["workflow"]) == 2
    assert {r["metric"]: r["delta"] for r in run(capsys, roots, "compare", "--id", A.format(1), "--other", A.format(2))["comparison"]}["steps"] == 0


def test_page_and_fork(spark, capsys, roots, tmp_path):
    page = tmp_path / "p.html"
    main(["analyze", "--a", str(roots / "a"), "--html", str(page)])
    assert "<table>" in page.read_text()
    capsys.readouterr()
    main(["fork", "--a", str(roots / "a"), "--id", A.format(2)])
    out = capsys.readouterr().out
    path = out.strip().split(" in ")[1]
    new = [json.loads(x) for x in open(path)]
    assert len(new) == 3 and {r["sessionId"] for r in new} == {out.split(":")[0]}
    with pytest.raises(SystemExit):
        main(["fork", "--a", str(roots / "a"), "--id", "ffff"])
