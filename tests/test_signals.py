"""Rules and reports over prompts, on tables made for one trait each."""

import statistics

import pytest

import __spark_entry__ as entry

STEPS = "session_id string, id string, step_idx bigint, kind string, commandName string, timestamp string, durationMs bigint, promptText string, promptPreview string, aborted boolean, apiCalls bigint"
RECORDS = "file_path string, line_no bigint, type string, sessionId string, session_id string, ingested_at timestamp_ntz, toolUseResult struct<agentId: string>"


def step(session, i, text="look at the file", **more):
    return {"session_id": session, "id": f"{session}-{i}", "step_idx": i, "kind": "prompt", "timestamp": f"2026-06-01T12:{i:02}:00Z", "promptText": text, "promptPreview": text[:120], "apiCalls": 1, **more}


def run(spark, path, name, **tables):
    for t, (kind, rows) in tables.items():
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
    return entry.queries()[name](spark, str(path)).collect()


@pytest.mark.parametrize("agents, want", [(2, "balanced"), (3, "delegator")])
def test_archetype_counts_subagents(spark, tmp_path, agents, want):
    line = lambda i, s, agent: {"file_path": s, "line_no": i, "type": "user", "sessionId": s, "toolUseResult": (agent,)}
    records = [line(i, "a", f"g{i}") for i in range(agents)] + [line(0, "a", "g0"), line(9, "b", None)]  # one line came twice
    got = run(spark, tmp_path, "archetype", steps=(STEPS, [step("a", 0), step("b", 0)]), claude_records=(RECORDS, records))
    assert [(r.archetype, r.steps, r.sessions) for r in got] == [(want, 2, 2)]


@pytest.mark.parametrize("long, chars, want", [(2, 3001, ["mega-prompts"]), (1, 3001, ["all-clear"]), (2, 3000, ["all-clear"])])
def test_lints_name_mega_prompts(spark, tmp_path, long, chars, want):
    rows = [step("s", i, "see src/a.py " + "x" * (chars - 13) if i < long else "look at src/a.py") for i in range(11)]
    assert [(r.rule, r.hits, r.of) for r in run(spark, tmp_path, "prompt_lints", steps=(STEPS, rows))] == [(want[0], *((long, 11) if want != ["all-clear"] else (0, 0)))]
    p90 = entry.queries()["prompt_chars_ninetieth"](spark, str(tmp_path)).first().p90
    assert (p90 > 3000) == (want == ["mega-prompts"])


def test_lint_examples_are_the_first_of_tripped_rules(spark, tmp_path):
    rows = [step("s", i, f"{i} fix it or something, idk", aborted=i == 0) for i in range(9)]
    got = run(spark, tmp_path, "prompt_lint_examples", steps=(STEPS, rows))
    assert sorted((r.rule, r.place, r.example[0]) for r in got) == [("vague-filler", k, str(k)) for k in range(3)]


def test_correlations(spark, tmp_path):
    vague, wrong = "do it or something, idk, etc", "no, that is wrong, undo it"
    rows = [step(s, i, t) for s in "abcd" for i, t in enumerate([vague if s in "ab" else "fix src/a.py and run `x()`", "see src/a.py"] + [wrong] * (s in "ab"))] + [step("e", 0, wrong)]
    calls = "session_id string, step_id string, call_pos bigint, id string, timestamp string, name string"
    made = [{"session_id": r["session_id"], "step_id": r["id"], "call_pos": k, "id": f"{r['id']}/{k}", "name": "Bash"} for r in rows for k in range(len(r["promptText"]) % 7)]
    (got,) = run(spark, tmp_path, "specificity_corrections_correlation", steps=(STEPS, rows))
    assert got.n == 4 and got.r == -1
    (got,) = run(spark, tmp_path, "chars_tool_calls_correlation", steps=(STEPS, rows), tool_calls=(calls, made))
    xs, ys = [len(r["promptText"]) for r in rows], [len(r["promptText"]) % 7 for r in rows]
    assert got.n == len(rows) and abs(got.r - statistics.correlation(xs, ys)) < 1e-6
