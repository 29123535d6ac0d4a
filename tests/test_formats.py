"""Both formats against sequential models, on random and hand-made lines."""

import json
import random

from pyspark.sql import functions as F

from trailspark.operators import format_a as a
from trailspark.operators import format_b as b

SCHEMA_A = """file_path string, line_no long, type string, uuid string, parentUuid string, sessionId string, session_id string, timestamp string, cwd string, gitBranch string, version string, requestId string,
isSidechain boolean, isMeta boolean, isCompactSummary boolean, compactMetadata struct<trigger:string,preTokens:long>, aiTitle string, operation string,
message struct<id:string,role:string,model:string,content:string,usage:struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>>,
toolUseResult struct<agentId:string,agentType:string,totalTokens:long,totalToolUseCount:long,totalDurationMs:long>, attachment string, ingested_at timestamp_ntz"""


def row_a(file, n, type_, content=None, mid=None, usage=None, **kw):
    msg = None if content is None and mid is None else (mid, type_, kw.pop("model", "m-1-20250101"), None if content is None else json.dumps(content), usage)
    base = dict(file_path=file, line_no=n, type=type_, uuid=f"{file}-{n}", parentUuid=None, sessionId="s", session_id=None, timestamp=f"2026-06-01T00:00:{n % 60:02d}Z", cwd="/w", gitBranch="main", version="1", requestId=None, isSidechain=None, isMeta=None, isCompactSummary=None, compactMetadata=None, aiTitle=None, operation=None, message=msg, toolUseResult=None, attachment=None, ingested_at=None)
    base.update(kw)
    return tuple(base.values())


def frame_a(spark, rows):
    return a.lines(spark.createDataFrame(rows, SCHEMA_A))


def test_steps_and_usage_equal_a_sequential_model(spark):
    rng = random.Random(1)
    rows, want_steps, want_usage = [], {}, {}
    for f in range(30):
        steps, calls, seen, cur = [], {}, set(), None
        for n in range(1, rng.randrange(2, 25)):
            k = rng.choice(["prompt", "command", "say", "say", "result", "interrupt", "meta", "blank"])
            if k == "say":
                mid, u = f"m{rng.randrange(6)}", (rng.randrange(9), rng.randrange(9), None, rng.randrange(9))
                rows.append(row_a(f"f{f}", n, "assistant", [{"type": "text", "text": "t"}], mid, u))
                if cur is None:
                    cur = 0
                    steps.append([False])
                if mid not in seen:
                    seen.add(mid)
                    c = calls.setdefault(cur, [0, 0])
                    c[0] += 1
                    c[1] += u[0] + u[1] + u[3]
            else:
                text = {"prompt": "do it", "command": "<command-name>/x</command-name><command-args> </command-args>", "result": [{"type": "tool_result", "tool_use_id": "q"}], "interrupt": "[Request interrupted by user]", "meta": "m", "blank": "  "}[k]
                rows.append(row_a(f"f{f}", n, "user", text, isMeta=True if k == "meta" else None))
                if k in ("prompt", "command"):
                    cur = len(steps)
                    steps.append([False])
                elif k == "interrupt" and cur is not None:
                    steps[cur][0] = True
        want_steps.update({(f"f{f}", i): s[0] for i, s in enumerate(steps)})
        want_usage.update({(f"f{f}", i): tuple(c) for i, c in calls.items()})
    rng.shuffle(rows)
    lines = a.in_steps(frame_a(spark, rows + rows[:20]))
    assert {(r.file_path, r.step_idx): r.aborted for r in a.steps(lines).collect()} == want_steps
    got = a.usage_by(a.api_calls(lines), "file_path", "step_idx").collect()
    assert {(r.file_path, r.step_idx): (r.api_calls, r.total) for r in got} == want_usage


def test_one_response_over_several_rows_counts_once(spark):
    u = (100, 50, 0, 1000)
    rows = [row_a("f", 1, "user", "go"), row_a("f", 2, "assistant", [{"type": "text", "text": "x"}], "m1", u), row_a("f", 3, "assistant", [{"type": "tool_use", "id": "c1", "name": "mcp__my_db__query", "input": {}}, {"type": "tool_use", "id": 7}], "m1", u), row_a("f", 4, "user", [{"type": "tool_result", "tool_use_id": "c1", "content": "a  b", "is_error": "true"}]), row_a("f", 5, "user", [{"type": "tool_result", "tool_use_id": "c1", "content": [1], "is_error": True}])]
    lines = a.in_steps(frame_a(spark, rows))
    assert [tuple(r) for r in a.usage_by(a.api_calls(lines), "file_path").collect()] == [("f", 1, 100, 50, 1000, 0, 1150)]
    c = a.linked(a.tool_calls(lines), a.tool_results(lines)).collect()
    assert len(c) == 1 and c[0].mcp_server == "my_db" and c[0].is_error is True and c[0].output_preview == "a b"


def test_fork_keeps_what_stands_before_the_next_step(spark):
    rows = [row_a("f", 1, "user", "one"), row_a("f", 2, "assistant", "x"), row_a("f", 3, "last-prompt"), row_a("f", 4, "user", "two"), row_a("f", 5, "assistant", "y")]
    lines = a.in_steps(frame_a(spark, rows))
    anchor = spark.createDataFrame([("f", 0), ("other", 0)], "file_path string, step_idx long")
    assert {r.line_no: r.kept for r in a.fork(lines, anchor).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert a.fork(lines, spark.createDataFrame([("f", 9)], "file_path string, step_idx long")).count() == 0


def test_empty_tables(spark):
    lines = frame_a(spark, [])
    assert a.steps(a.in_steps(lines)).count() == a.volume(lines).count() == 0
    lb = b.lines(spark.createDataFrame([], "line_id long, file_path string, line_no long, timestamp string, type string, payload string"))
    assert b.turns(b.in_turns(lb)).count() == b.model_usage(lb).count() == 0


def frame_b(spark, events):
    rows = [(i, "r", i, "2026-06-01T00:00:00Z", t, p if p is None or isinstance(p, str) else json.dumps(p)) for i, (t, p) in enumerate(events, 1)]
    return b.lines(spark.createDataFrame(rows, "line_id long, file_path string, line_no long, timestamp string, type string, payload string"))


def count(total, last=None):
    return ("event_msg", {"type": "token_count", "info": {"total_token_usage": {"input_tokens": total - 10, "output_tokens": 10, "total_tokens": total}, "last_token_usage": {"output_tokens": last or 10}}})


def test_turns_usage_and_models_of_format_b(spark):
    events = [
        ("session_meta", {"id": "s9", "cwd": "/w", "source": {"subagent": {}}, "git": {"branch": "dev"}, "base_instructions": "abc"}), ("turn_context", {"model": "m", "effort": "low"}), ("event_msg", {"type": "user_message", "message": "$tidy all files"}),
        ("event_msg", {"type": "task_started", "turn_id": "t0"}), count(120), ("event_msg", {"type": "task_complete", "duration_ms": 5}), ("event_msg", {"type": "task_started"}), ("event_msg", {"type": "user_message", "message": "late"}), count(350, 60),
        ("response_item", {"type": "function_call", "call_id": "c", "name": "db.query", "arguments": "{}"}), ("response_item", {"type": "function_call_output", "call_id": "c", "output": "ok\n now"}), ("event_msg", {"type": "task_started"}), ("event_msg", '{"cut'), ("event_msg", None),
    ]
    lines = frame_b(spark, events)
    rows = b.in_turns(lines)
    t = {r.turn_idx: r for r in b.turns(rows).collect()}
    assert [(t[i].turn_id, t[i].kind, t[i].command_name, t[i].prompt_text, t[i].aborted) for i in range(3)] == [("t0", "command", "$tidy", "all files", False), ("turn-1", "prompt", None, None, True), ("turn-2", "prompt", None, "late", True)]
    assert {r.turn_idx: r.total for r in b.turn_usage(rows).collect()} == {0: 120, 1: 230}
    assert b.session_usage(rows).first().total == 350
    assert [tuple(r) for r in b.model_usage(lines).collect()] == [("r", "m (low)", 2, 70)]
    m = b.session_meta(lines).first()
    assert (m.session_id, m.is_subagent, m.git_branch) == ("s9", True, "dev")
    c = b.tool_calls(rows).first()
    assert (c.turn_idx, c.mcp_server, c.output_preview) == (1, "db", "ok now")
    assert b.volume(lines).select(F.struct("human_chars", "harness_chars", "tool_chars").alias("s")).first().s == (19, 3, 7)
