"""Order-dependent columns, clustering, sources, sinks and streams."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from trailspark import report
from trailspark.functions import text as tx
from trailspark.operators import cluster, facts, ordered, rollups
from trailspark.sources import sidecars, transcripts
from trailspark.streaming import tail


def test_running_counts_and_neighbours_over_a_hot_group(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), i, rng.random() < 0.3 or None) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, f boolean").repartition(8)
    got = {r.o: r.n for r in ordered.running_counts(df, "g", ["o"], {"n": F.col("f")}).collect()}
    want, run = {}, {}
    for g, o, f in sorted(rows, key=lambda r: r[1]):
        want[o] = run[g] = run.get(g, 0) + bool(f)
    assert got == want
    n = ordered.with_neighbours(df.filter("g = 'hot'"), "g", ["o"], before={"o": "prev"}, after={"o": "next"}).orderBy("o").collect()
    os = [r.o for r in n]
    assert [r.prev for r in n] == [None, *os[:-1]] and [r.next for r in n] == [*os[1:], None]


@pytest.mark.parametrize("least", [0.2, 0.45, 0.8])
def test_leaders_equal_the_greedy_loop(spark, least):
    rng = random.Random(7)
    sets = list({(rng.choice("qd"), frozenset(rng.sample("abcdefghij", rng.randrange(1, 7)))) for _ in range(150)})
    rng.shuffle(sets)
    rows = [(i, k, sorted(t)) for i, (k, t) in enumerate(sets, 1)]
    want, led = {}, []
    for i, k, t in rows:
        home = next((j for j, kk, tt in led if kk == k and len(set(t) & set(tt)) / len(set(t) | set(tt)) >= least), None)
        if home is None:
            led.append((i, k, t))
        want[i] = home or i
    got = cluster.leaders(spark.createDataFrame(rows, "rank long, kind string, tokens array<string>"), least)
    assert {r["rank"]: r.leader for r in got.collect()} == want


def test_longest_prefix_stops_at_hyphens(spark):
    keys = spark.createDataFrame([("g-5",), ("g-5-mini",)], "key string")
    df = spark.createDataFrame([("g-5",), ("g-5-mini-x",), ("g-5.1",), (None,)], "m string")
    assert {r.m: r.matched for r in rollups.longest_prefix(df, F.col("m"), keys, "key").collect()} == {"g-5": "g-5", "g-5-mini-x": "g-5-mini", "g-5.1": None, None: None}


def test_jsonl_keeps_line_numbers_and_drops_what_is_unreadable(spark, tmp_path):
    f = tmp_path / "p" / "0a0a0a0a-0000-0000-0000-000000000001.jsonl"
    f.parent.mkdir()
    f.write_text('{"cwd":1}\n\nnot json\n  {"cwd":"/w"}\n[1]\n{"half":')
    (tmp_path / "p" / "notes.txt").write_text("x")
    (tmp_path / "p" / "sub").mkdir()
    (tmp_path / "p" / "sub" / "0a0a0a0a-0000-0000-0000-000000000002.jsonl").write_text("{}")
    lines = transcripts.read_jsonl(spark, str(f))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 4, 5]
    assert transcripts.first_folder(lines).first().cwd == "/w"
    assert [r.line_no for r in transcripts.tail(lines, 1).collect()] == [5]
    refs = transcripts.list_a(spark, str(tmp_path))
    assert [r.session_id for r in refs.collect()] == ["0a0a0a0a-0000-0000-0000-000000000001"]
    assert transcripts.list_a(spark, str(tmp_path / "none")).count() == 0
    assert transcripts.find(refs, "0a0a") == "0a0a0a0a-0000-0000-0000-000000000001" and transcripts.find(refs, "ff") is None
    assert transcripts.in_scope(refs, "a", "3d", 5).count() == 1
    with pytest.raises(ValueError):
        transcripts.in_scope(refs, "z")


def test_rollouts_titles_and_quota(spark, tmp_path):
    d = tmp_path / "2026" / "06"
    d.mkdir(parents=True)
    f = d / "rollout-2026-06-01T00-00-00-0b0b0b0b-0000-0000-0000-000000000001.jsonl"
    f.write_text(json.dumps({"type": "event_msg", "payload": {"rate_limits": {"primary": {"used_percent": 12.5, "window_minutes": 300}, "plan_type": "p"}}}) + "\n")
    (d / "rollout-old.json").write_text("{}")
    index = tmp_path / "index.txt"
    index.write_text('{"id":"0b0b0b0b-0000-0000-0000-000000000001","thread_name":"old"}\n{"id":"0b0b0b0b-0000-0000-0000-000000000001","thread_name":"new"}\n')
    refs = transcripts.list_b(spark, str(tmp_path), str(index))
    assert [(r.session_id[:8], r.title) for r in refs.collect()] == [("0b0b0b0b", "new")]
    q = transcripts.rate_limits(refs, transcripts.read_jsonl(spark, str(f))).collect()
    assert [tuple(r) for r in q] == [(12.5, 300, "p")]


def test_sidecars(spark, tmp_path):
    c = tmp_path / "cache.json"
    c.write_text('{"dailyModelTokens":[{"date":"2026-06-01","tokensByModel":{"m":5}}],"other":1}')
    assert [tuple(r) for r in sidecars.usage_cache(spark, str(c)).collect()] == [("2026-06-01", "m", 5)]
    assert sidecars.usage_cache(spark, str(tmp_path / "no")).count() == 0 and sidecars.retention_days(str(tmp_path / "no")) == 30
    ch = sidecars.instruction_changes(spark, ".", ["A.md"], lambda repo, f: "h1|2026-01-02|a | b\n\nh0|2026-01-01|x\nbad")
    assert [tuple(r) for r in ch.collect()] == [("A.md", "h0", "2026-01-01", "x"), ("A.md", "h1", "2026-01-02", "a | b")]
    (tmp_path / "skills" / "tidy").mkdir(parents=True)
    (tmp_path / "commands").mkdir()
    (tmp_path / "commands" / "plan.md").write_text("")
    assert [r.name for r in sidecars.installed_commands(spark, [str(tmp_path)]).collect()] == ["plan", "tidy"]
    assert sidecars.git_trace(spark, [str(tmp_path)]).count() == 0


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 1234, None)], "name string, n long, x double")
    assert report.text_table(df).splitlines()[2].startswith("a<b   1,234")
    assert json.loads(report.as_json(df)) == [{"name": "a<b", "n": 1234, "x": None}]
    page = report.as_html("T", [("Part", df)])
    assert "a&lt;b" in page and "class=n>1,234" in page
    e = {"key": "0123456789ab", "question": "Q?", "answer": "x" * 2000, "source": "s"}
    text, n = report.merge_answers(None, [e, e])
    assert n == 1 and "…" in text
    edited = text.replace("Q?", "Q edited")
    again, n = report.merge_answers(edited, [e])
    assert n == 0 and again == edited
    grades = report.read_grades('so: [{"id":"a","clarity":3,"context":4,"tip":5},{"id":"z","clarity":1,"context":1},{"id":"b","clarity":"3","context":1},{"id":"b","clarity":2,"context":3,"tip":"t"}] end', {"a", "b"})
    assert grades == [{"id": "a", "clarity": 3, "context": 4, "tip": ""}, {"id": "b", "clarity": 2, "context": 3, "tip": "t"}]
    assert tuple(report.grade_averages(spark, grades).first()) == (2, 2.5, 3.5) and tuple(report.grade_averages(spark, []).first()) == (0, None, None)
    assert report.read_themes('x [{"theme":"t","sessions":["a",1]},{"theme":2}]') == [("t", ["a"])]
    with pytest.raises(ValueError):
        report.read_grades("none", {"a"})
    kept = spark.createDataFrame([(2, '{"s":"old","t":"old one"}'), (1, "{}")], "line_no int, raw string")
    (tmp_path / "old" / "deep").mkdir(parents=True)
    (tmp_path / "old" / "deep" / "x.txt").write_text("x")
    new, path, n, copied = report.write_fork(kept, str(tmp_path), "old")
    assert (tmp_path / new / "deep" / "x.txt").read_text() == "x" and copied == 1
    assert n == 2 and open(path).read() == '{}\n{"s":"' + new + '","t":"old one"}\n'


def test_fork_of_format_b_names_its_origin(spark, tmp_path):
    kept = spark.createDataFrame([(1, '{"type":"session_meta","payload":{"id":"old","cwd":"/w"}}'), (2, '{"type":"event_msg","payload":{"note":"session_meta"}}')], "line_no int, raw string")
    new, path, n, _ = report.write_fork(kept, str(tmp_path), "old", agent="b")
    first, second = open(path).read().splitlines()
    assert json.loads(first)["payload"] == {"id": new, "forked_from_id": "old", "cwd": "/w"} and second == '{"type":"event_msg","payload":{"note":"session_meta"}}' and new in path


def test_installed_plugins(spark, tmp_path):
    at = tmp_path / "elsewhere"
    (at / "commands").mkdir(parents=True)
    (at / "commands" / "ship.md").write_text("")
    (tmp_path / "plugins").mkdir()
    (tmp_path / "plugins" / "installed_plugins.json").write_text(json.dumps({"plugins": {"tools@market": [{"installPath": str(at)}], "odd@x": 3}}))
    assert [r.name for r in sidecars.installed_commands(spark, [str(tmp_path)]).collect()] == ["odd", "ship", "tools"]
    files = {r.file: r for r in sidecars.instruction_files(spark, str(tmp_path), ["plugins", "none.md"], log=lambda repo, f: "a|b|c\n" if f == "plugins" else "").collect()}
    assert files["plugins"].present and files["plugins"].commits == 1 and not files["none.md"].present


def test_shells_of_any_depth(spark):
    cmd = "X=1 git status"
    for _ in range(6):
        cmd = f"bash -lc '{cmd}"
    df = spark.createDataFrame([("shell", json.dumps({"command": cmd})), ("shell", json.dumps({"command": "ls -la"})), ("shell", None)], "name string, input string")
    assert [r.label for r in tx.with_labels(df).collect()] == ["shell:git", "shell:ls", "shell"]


def test_facts_and_scopes(spark):
    f = spark.createDataFrame([("a", "f1", "s1", "/r/x", "2026-06-01T00:00:00Z", "2026-06-02T00:00:00Z", False, "[own] x"), ("a", "f2", "s2", "/r", None, None, False, None), ("b", "f3", "s3", "/rx", "2026-06-03T00:00:00Z", "2026-06-01T00:00:00Z", True, "y"), ("b", "f4", "s4", None, "2026-06-04T00:00:00Z", "bad", None, "y")], "agent string, file_path string, session_id string, cwd string, started_raw string, ended_raw string, is_subagent boolean, first_prompt string")
    ids = lambda df: {r.session_id for r in df.collect()}
    assert ids(facts.without_internal(f, "[own]")) == {"s2", "s3", "s4"} and ids(facts.without_subagents(f)) == {"s1", "s2", "s4"} and ids(facts.in_repo(f, "/r/")) == {"s1", "s2"}
    live = spark.createDataFrame([("/r",), (None,), ("/r",)], "cwd string")
    assert {r.session_id: r.orphaned for r in facts.with_orphaned(f, live).collect()} == {"s1": True, "s2": False, "s3": True, "s4": True}
    assert ids(facts.newest_per_agent(f, 1)) == {"s1", "s4"}
    assert [r.cwd for r in facts.project_groups(facts.with_orphaned(f, live)).orderBy("place").collect()] == ["/r", "", "/r/x", "/rx"]
    assert [r.d for r in f.orderBy("session_id").select(facts.duration_ms().alias("d")).collect()] == [86_400_000, None, None, None]
    none = spark.createDataFrame([], "file_path string, line_no bigint, value variant, raw string")
    assert facts.by_session(facts.facts(transcripts.records_a(none), transcripts.lines_b(none))).count() == 0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"uuid": f"u{i % 8}", "sessionId": "s", "timestamp": f"2026-06-0{1 + i % 8}T00:00:00Z", "type": "user"} for i in range(10)]
    (src / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"half":')
    s = tail.tail_jsonl(spark, str(src), {"uuid": "string", "type": "string"})
    q = tail.weekly_counts(s, "type").writeStream.format("memory").queryName("weekly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.week, r.n) for r in spark.table("weekly").collect()} == {("2026-06-01", 7), ("2026-06-08", 1)}
    steps = tmp_path / "steps"
    kind = "session_id string, line_no long, opens boolean"
    out = tail.numbered_steps(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(steps) + "/*.json") if steps.mkdir() is None else None, idle=None)
    (steps / "1.json").write_text('{"session_id":"s","line_no":1,"opens":true}\n{"session_id":"s","line_no":2,"opens":false}\n')
    q = out.writeStream.format("memory").queryName("numbered").outputMode("append").start()
    q.processAllAvailable()
    (steps / "2.json").write_text('{"session_id":"s","line_no":3,"opens":true}\n')
    q.processAllAvailable()
    q.stop()
    assert sorted((r.line_no, r.step_idx) for r in spark.table("numbered").collect()) == [(1, 0), (2, 0), (3, 1)]


def test_steps_with_a_time_limit_on_state(spark, tmp_path):
    steps = tmp_path / "steps"
    steps.mkdir()
    (steps / "1.json").write_text('{"session_id":"s","line_no":1,"opens":true}\n{"session_id":"s","line_no":2,"opens":true}\n')
    out = tail.numbered_steps(spark.readStream.schema("session_id string, line_no long, opens boolean").json(str(steps) + "/*.json"))
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").start()
    # With a limit by the clock batches go on without data, so the rows are waited for.
    for _ in range(60):
        if spark.table("limited").count():
            break
        time.sleep(0.5)
    q.stop()
    assert {(r.line_no, r.step_idx) for r in spark.table("limited").collect()} == {(1, 0), (2, 1)}


def test_stream_join_keeps_the_nearest_event(spark, tmp_path):
    kind = "session_id string, ts timestamp"
    for d in ("p", "e"):
        (tmp_path / d).mkdir()
    (tmp_path / "p" / "1.json").write_text('{"session_id":"s","ts":"2026-06-01T00:00:10Z"}\n')
    (tmp_path / "e" / "1.json").write_text("".join(f'{{"session_id":"s","ts":"2026-06-01T00:00:{t}Z","head":"h{t}"}}\n' for t in ("01", "12", "25")))
    p = spark.readStream.schema(kind).json(str(tmp_path / "p")).withWatermark("ts", "1 minute")
    e = spark.readStream.schema(kind + ", head string").json(str(tmp_path / "e")).withWatermark("ts", "1 minute")
    q = tail.with_git(p, e).writeStream.format("memory").queryName("near").outputMode("append").start()
    q.processAllAvailable()
    for n, d in ((2, "p"), (3, "e")):
        (tmp_path / d / f"{n}.json").write_text('{"session_id":"z","ts":"2026-06-01T01:00:00Z"}\n')
    q.processAllAvailable()
    (tmp_path / "p" / "4.json").write_text('{"session_id":"y","ts":"2026-06-01T02:00:00Z"}\n')
    (tmp_path / "e" / "4.json").write_text('{"session_id":"y","ts":"2026-06-01T03:00:00Z"}\n')
    q.processAllAvailable()
    q.stop()
    assert [(r.session_id, r["head"]) for r in spark.table("near").filter("session_id = 's'").collect()] == [("s", "h12")]
