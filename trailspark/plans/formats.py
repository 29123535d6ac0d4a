"""Queries of the two transcript formats, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import format_a as a
from ..operators import format_b as b
from ..sources.testdata import table
from .sqlparts import LINES_A, LINES_B, STEPS_A, TURNS_B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines_a(spark, folder):
    return a.lines(table(spark, folder, "claude_records"))


def lines_b(spark, folder):
    return b.lines(table(spark, folder, "codex_lines"))


@query(f"WITH {LINES_A} SELECT row_class, count(*) AS n FROM la GROUP BY 1")
def a_row_classes(spark, folder):
    return lines_a(spark, folder).groupBy("row_class").agg(F.count("*").alias("n"))


@query(f"""WITH {STEPS_A}, o AS (SELECT *, row_number() OVER (PARTITION BY file_path, step_idx ORDER BY line_no) AS k, bool_or(row_class = 'interruption') OVER (PARTITION BY file_path, step_idx) AS aborted,
 count(*) OVER (PARTITION BY file_path, step_idx) AS rows FROM ra WHERE step_idx IS NOT NULL)
SELECT file_path, step_idx, uuid AS step_id, CASE WHEN row_class = 'command' THEN 'command' ELSE 'prompt' END AS kind, CASE WHEN row_class = 'command' THEN regexp_extract(text, '<command-name>\\s*([^<\\n]+?)\\s*</command-name>', 1) END AS command_name,
 timestamp AS ts_raw, CASE WHEN row_class = 'command' THEN nullif(regexp_extract(text, '<command-args>\\s*([\\s\\S]*?)\\s*</command-args>', 1), '') WHEN row_class = 'prompt' THEN text END AS prompt_text, aborted, rows FROM o WHERE k = 1""")
def a_steps(spark, folder):
    return a.steps(a.in_steps(lines_a(spark, folder)))


_CALLS = """, ac AS (SELECT *, row_number() OVER (PARTITION BY file_path, coalesce(message.id, requestId, uuid, 'row-' || line_no) ORDER BY line_no) AS k FROM ra WHERE type = 'assistant' AND message IS NOT NULL),
calls AS (SELECT file_path, step_idx, message.model AS model, coalesce(message.usage.input_tokens, 0) AS i, coalesce(message.usage.output_tokens, 0) AS o, coalesce(message.usage.cache_read_input_tokens, 0) AS r, coalesce(message.usage.cache_creation_input_tokens, 0) AS c FROM ac WHERE k = 1)"""
_SUMS = "count(*) AS api_calls, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(r) AS BIGINT) AS cache_read, CAST(sum(c) AS BIGINT) AS cache_creation, CAST(sum(i + o + r + c) AS BIGINT) AS total"


@query(f"WITH {STEPS_A}{_CALLS} SELECT file_path, step_idx, {_SUMS} FROM calls GROUP BY ALL")
def a_step_usage(spark, folder):
    rows = a.stepped(table(spark, folder, "claude_records"), [F.col("type"), F.col("uuid"), F.col("requestId"), F.col("message").dropFields("content").alias("message")])
    return a.usage_by(a.api_calls(rows), "file_path", "step_idx")


@query(f"WITH {STEPS_A}{_CALLS} SELECT file_path, model, {_SUMS} FROM calls WHERE model IS NOT NULL GROUP BY ALL")
def a_model_usage(spark, folder):
    return a.usage_by(a.api_calls(lines_a(spark, folder).withColumn("step_idx", F.lit(0))).filter("model is not null"), "file_path", "model")


_BLOCKS = """, blk AS (SELECT r.file_path, r.line_no, r.type, r.step_idx, CAST(t.i - 1 AS INTEGER) AS pos, CAST(json(r.message.content) AS JSON[])[t.i] AS b FROM (SELECT * FROM ra WHERE json_valid(message.content) AND json_type(message.content) = 'ARRAY') r, range(1, CAST(json_array_length(r.message.content) AS BIGINT) + 1) t(i)),
tc AS (SELECT file_path, line_no, step_idx, pos, b ->> '$.id' AS call_id, CASE WHEN json_type(b, '$.name') = 'VARCHAR' THEN b ->> '$.name' ELSE '(unknown)' END AS name FROM blk WHERE type = 'assistant' AND b ->> '$.type' = 'tool_use' AND json_type(b, '$.id') = 'VARCHAR'),
tr AS (SELECT file_path, line_no, pos, b ->> '$.tool_use_id' AS call_id, coalesce(json_type(b, '$.is_error') = 'BOOLEAN' AND (b ->> '$.is_error') = 'true', false) AS is_error, CASE WHEN json_type(b, '$.content') = 'VARCHAR' THEN regexp_replace(regexp_replace(b ->> '$.content', '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') END AS full_text
 FROM blk WHERE type = 'user' AND b ->> '$.type' = 'tool_result' AND json_type(b, '$.tool_use_id') = 'VARCHAR')"""
_MCP = "regexp_matches(name, '^mcp__(.+?)__') AS is_mcp, nullif(regexp_extract(name, '^mcp__(.+?)__', 1), '') AS mcp_server"


@query(f"WITH {STEPS_A}{_BLOCKS} SELECT file_path, line_no, step_idx, pos, call_id, name, {_MCP} FROM tc")
def a_tool_calls(spark, folder):
    content = F.when(F.col("type") == "assistant", F.col("message.content"))
    return a.tool_calls(a.stepped(table(spark, folder, "claude_records"), [F.col("type"), F.struct(content.alias("content")).alias("message")]))


@query(f"""WITH {STEPS_A}{_BLOCKS} SELECT c.file_path, c.line_no, c.pos, c.call_id, c.name, arg_max(r.is_error, r.line_no * 1000 + r.pos) AS is_error,
 arg_max(CASE WHEN length(r.full_text) > 120 THEN substring(r.full_text, 1, 119) || '…' ELSE r.full_text END, r.line_no * 1000 + r.pos) FILTER (r.full_text IS NOT NULL) AS output_preview
FROM tc c LEFT JOIN tr r ON c.file_path = r.file_path AND c.call_id = r.call_id AND r.line_no > c.line_no GROUP BY ALL""")
def a_tool_links(spark, folder):
    rows = lines_a(spark, folder).withColumn("step_idx", F.lit(None).cast("bigint"))
    return a.linked(a.tool_calls(rows).select("file_path", "line_no", "pos", "call_id", "name"), a.tool_results(rows))


@query(f"""WITH {LINES_A} SELECT file_path, count(*) FILTER (type = 'permission-mode') AS permission_mode_changes, count(*) FILTER (type = 'pr-link') AS pr_links, count(*) FILTER (type = 'queue-operation' AND operation = 'enqueue') AS queued_prompts,
 count(*) FILTER (row_class = 'command') AS commands, count(*) FILTER (row_class = 'interruption') AS interruptions, count(*) FILTER (isCompactSummary) AS compactions FROM la GROUP BY 1""")
def a_counters(spark, folder):
    return a.counters(lines_a(spark, folder))


@query(f"WITH {LINES_A} SELECT file_path, line_no, compactMetadata.trigger AS trigger, compactMetadata.preTokens AS pre_tokens, timestamp AS ts_raw FROM la WHERE isCompactSummary")
def a_compactions(spark, folder):
    return lines_a(spark, folder).filter("isCompactSummary").select("file_path", "line_no", F.col("compactMetadata.trigger").alias("trigger"), F.col("compactMetadata.preTokens").alias("pre_tokens"), F.col("timestamp").alias("ts_raw"))


@query(f"""WITH {LINES_A} SELECT file_path, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS cwd, arg_min(gitBranch, line_no) FILTER (gitBranch IS NOT NULL) AS git_branch, arg_min(version, line_no) FILTER (version IS NOT NULL) AS cli_version,
 arg_min(timestamp, line_no) FILTER (timestamp <> '') AS started_raw, arg_max(timestamp, line_no) FILTER (timestamp <> '') AS ended_raw, arg_max(aiTitle, line_no) FILTER (aiTitle IS NOT NULL) AS title FROM la GROUP BY 1""")
def a_session_attributes(spark, folder):
    return a.attributes(lines_a(spark, folder))


@query(f"WITH {LINES_A} SELECT file_path, line_no, toolUseResult.agentId AS id, toolUseResult.agentType AS agent_type, toolUseResult.totalTokens AS total_tokens, toolUseResult.totalToolUseCount AS tool_use_count, toolUseResult.totalDurationMs AS duration_ms FROM la WHERE type = 'user' AND toolUseResult.agentId IS NOT NULL")
def a_subagents(spark, folder):
    r = "toolUseResult"
    return lines_a(spark, folder).filter(f"type = 'user' and {r}.agentId is not null").select("file_path", "line_no", F.col(f"{r}.agentId").alias("id"), F.col(f"{r}.agentType").alias("agent_type"), F.col(f"{r}.totalTokens").alias("total_tokens"), F.col(f"{r}.totalToolUseCount").alias("tool_use_count"), F.col(f"{r}.totalDurationMs").alias("duration_ms"))


_U16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


@query(f"""WITH {LINES_A}, v AS (SELECT *, coalesce(array_to_string(regexp_extract_all(text, '<system-reminder>[\\s\\S]*?</system-reminder>'), ''), '') AS rem,
 coalesce(nullif(regexp_extract(text, '<command-args>\\s*([\\s\\S]*?)\\s*</command-args>', 1), ''), regexp_extract(text, '<command-name>\\s*([^<\\n]+?)\\s*</command-name>', 1)) AS cmd FROM la)
SELECT file_path, CAST(sum(CASE WHEN row_class = 'prompt' THEN {_U16.format('text')} - {_U16.format('rem')} WHEN row_class = 'command' THEN {_U16.format('cmd')} ELSE 0 END) AS BIGINT) AS human_chars,
 CAST(sum(CASE WHEN type = 'attachment' THEN coalesce({_U16.format('attachment')}, 0) WHEN row_class = 'prompt' THEN {_U16.format('rem')} WHEN type = 'user' AND isMeta THEN {_U16.format('text')} ELSE 0 END) AS BIGINT) AS harness_chars,
 CAST(coalesce(sum(list_sum(list_transform(list_filter(CASE WHEN type = 'user' AND json_valid(message.content) AND json_type(message.content) = 'ARRAY' THEN CAST(json(message.content) AS JSON[]) END, lambda b: (b ->> '$.type') = 'tool_result'),
  lambda b: CASE WHEN json_type(b, '$.content') IS NULL THEN 2 WHEN json_type(b, '$.content') = 'VARCHAR' THEN {_U16.format("(b ->> '$.content')")} ELSE length(CAST(json(b -> '$.content') AS VARCHAR)) END))), 0) AS BIGINT) AS tool_chars FROM v GROUP BY 1""")
def a_content_volume(spark, folder):
    return a.volume(lines_a(spark, folder))


@query(f"""WITH {STEPS_A}, t AS (SELECT file_path, step_idx, regexp_replace(string_agg(text, chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS response FROM ra WHERE type = 'assistant' AND step_idx IS NOT NULL AND text <> '' GROUP BY ALL) SELECT * FROM t WHERE response <> ''""")
def a_responses(spark, folder):
    return a.responses(a.in_steps(lines_a(spark, folder)))


@query(f"""WITH {STEPS_A}, ok AS (SELECT DISTINCT file_path FROM ra WHERE step_idx = 1)
SELECT file_path, count(*) FILTER (coalesce(step_idx <= 1, true) AND type <> 'last-prompt') AS kept, count(*) FILTER (NOT (coalesce(step_idx <= 1, true) AND type <> 'last-prompt')) AS dropped FROM ra JOIN ok USING (file_path) GROUP BY 1""")
def a_fork_at_second_step(spark, folder):
    rows = a.in_steps(lines_a(spark, folder))
    anchors = rows.select("file_path").distinct().withColumn("step_idx", F.lit(1))
    return a.fork(rows, anchors).groupBy("file_path").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


@query(f"""WITH {TURNS_B}, per AS (SELECT file_path, coalesce(turn_idx, -1) AS t, arg_max(coalesce(CASE WHEN json_type(p, '$.message') = 'VARCHAR' THEN p ->> '$.message' END, CASE WHEN json_type(p, '$.text') = 'VARCHAR' THEN p ->> '$.text' END), line_no) FILTER (type = 'event_msg' AND p ->> '$.type' = 'user_message') AS said,
 max(CASE WHEN started AND json_type(p, '$.turn_id') = 'VARCHAR' THEN p ->> '$.turn_id' END) AS turn_id, arg_max(CAST(p ->> '$.duration_ms' AS BIGINT), line_no) FILTER (p ->> '$.type' = 'task_complete' AND json_type(p, '$.duration_ms') IN ('UBIGINT', 'BIGINT', 'DOUBLE')) AS duration_ms, count(*) AS rows FROM rb GROUP BY ALL),
m AS (SELECT a.*, b.said AS s, nullif(regexp_extract(b.said, '^\\$[\\w:.-]+'), '') AS cmd FROM per a LEFT JOIN per b ON a.file_path = b.file_path AND a.t = b.t + 1 WHERE a.t >= 0)
SELECT file_path, t AS turn_idx, coalesce(turn_id, 'turn-' || t) AS turn_id, CASE WHEN cmd IS NOT NULL THEN 'command' ELSE 'prompt' END AS kind, cmd AS command_name,
 CASE WHEN cmd IS NOT NULL THEN nullif(regexp_replace(substring(s, length(cmd) + 1), '^\\s+|\\s+$', '', 'g'), '') ELSE s END AS prompt_text, duration_ms, duration_ms IS NULL AS aborted, rows FROM m""")
def b_turns(spark, folder):
    return b.turns(b.in_turns(lines_b(spark, folder)))


_CUM = """, cum AS (SELECT file_path, coalesce(turn_idx, -1) AS turn_idx, line_no, coalesce(CAST(p ->> '$.info.total_token_usage.input_tokens' AS BIGINT), 0) AS input, coalesce(CAST(p ->> '$.info.total_token_usage.output_tokens' AS BIGINT), 0) AS output,
 coalesce(CAST(p ->> '$.info.total_token_usage.cached_input_tokens' AS BIGINT), 0) AS cache_read, coalesce(CAST(p ->> '$.info.total_token_usage.reasoning_output_tokens' AS BIGINT), 0) AS reasoning,
 CAST(p ->> '$.info.total_token_usage.total_tokens' AS BIGINT) AS tt FROM rb WHERE type = 'event_msg' AND p ->> '$.type' = 'token_count' AND json_type(p, '$.info.total_token_usage') = 'OBJECT')"""


@query(f"""WITH {TURNS_B}{_CUM}, l AS (SELECT *, coalesce(tt, input + output) AS total FROM cum QUALIFY row_number() OVER (PARTITION BY file_path, turn_idx ORDER BY line_no DESC) = 1),
d AS (SELECT file_path, turn_idx, {', '.join(f'greatest(0, {k} - coalesce(lag({k}) OVER w, 0)) AS {k}' for k in ('input', 'output', 'cache_read', 'reasoning', 'total'))} FROM l WINDOW w AS (PARTITION BY file_path ORDER BY turn_idx)) SELECT * FROM d WHERE turn_idx >= 0""")
def b_turn_usage(spark, folder):
    return b.turn_usage(b.in_turns(lines_b(spark, folder)))


@query(f"WITH {TURNS_B}{_CUM} SELECT file_path, input, output, cache_read, reasoning, coalesce(tt, input + output) AS total FROM cum QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY line_no DESC) = 1")
def b_session_usage(spark, folder):
    return b.session_usage(lines_b(spark, folder).withColumn("turn_idx", F.lit(0)))


@query(f"""WITH {LINES_B}, m AS (SELECT *, CASE WHEN type = 'turn_context' AND json_type(p, '$.model') = 'VARCHAR' THEN (p ->> '$.model') || coalesce(' (' || CASE WHEN json_type(p, '$.effort') = 'VARCHAR' THEN p ->> '$.effort' END || ')', '') END AS model FROM lb),
f AS (SELECT *, last_value(model IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS cur FROM m)
SELECT file_path, cur AS model, count(*) AS api_calls, CAST(sum(coalesce(CAST(p ->> '$.info.last_token_usage.output_tokens' AS BIGINT), 0)) AS BIGINT) AS output FROM f WHERE type = 'event_msg' AND p ->> '$.type' = 'token_count' AND cur IS NOT NULL GROUP BY ALL""")
def b_model_usage(spark, folder):
    return b.model_usage(lines_b(spark, folder))


def _last(path: str, name: str) -> str:
    return f"arg_max(p ->> '{path}', line_no) FILTER (json_type(p, '{path}') = 'VARCHAR') AS {name}"


@query(f"""WITH {LINES_B} SELECT file_path, {_last('$.id', 'session_id')}, {_last('$.cwd', 'cwd')}, {_last('$.cli_version', 'cli_version')}, {_last('$.forked_from_id', 'forked_from_id')}, {_last('$.git.branch', 'git_branch')},
 bool_or(coalesce(p ->> '$.thread_source' = 'subagent', false) OR json_exists(p, '$.source.subagent')) AS is_subagent FROM lb WHERE type = 'session_meta' GROUP BY 1""")
def b_session_meta(spark, folder):
    return b.session_meta(lines_b(spark, folder))


_BUILTIN = "('exec', 'shell', 'local_shell', 'apply_patch', 'update_plan', 'view_image', 'web_search', 'read_file', 'list_dir')"


@query(f"""WITH {TURNS_B}, c AS (SELECT file_path, line_no, turn_idx, p ->> '$.call_id' AS call_id, CASE WHEN json_type(p, '$.name') = 'VARCHAR' THEN p ->> '$.name' ELSE '(unknown)' END AS name FROM rb WHERE called),
o AS (SELECT file_path, line_no, p ->> '$.call_id' AS call_id, regexp_replace(regexp_replace(p ->> '$.output', '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM rb WHERE type = 'response_item' AND p ->> '$.type' IN ('function_call_output', 'custom_tool_call_output') AND json_type(p, '$.output') = 'VARCHAR' AND json_type(p, '$.call_id') = 'VARCHAR')
SELECT c.file_path, c.line_no, c.turn_idx, c.call_id, c.name, CASE WHEN c.name IN {_BUILTIN} THEN false ELSE contains(c.name, '__') OR contains(c.name, '.') END AS is_mcp,
 CASE WHEN c.name IN {_BUILTIN} THEN NULL WHEN contains(c.name, '__') THEN split_part(c.name, '__', 1) WHEN contains(c.name, '.') THEN split_part(c.name, '.', 1) END AS mcp_server,
 arg_max(CASE WHEN length(o.t) > 120 THEN substring(o.t, 1, 119) || '…' ELSE o.t END, o.line_no) AS output_preview FROM c LEFT JOIN o ON c.file_path = o.file_path AND c.call_id = o.call_id AND o.line_no > c.line_no GROUP BY ALL""")
def b_tool_calls(spark, folder):
    return b.tool_calls(b.in_turns(lines_b(spark, folder)))


@query(f"""WITH {LINES_B}, v AS (SELECT *, CASE WHEN json_type(p, '$.content') = 'ARRAY' THEN coalesce(array_to_string(list_transform(CAST(p -> '$.content' AS JSON[]), lambda b: CASE WHEN json_type(b, '$.text') = 'VARCHAR' THEN b ->> '$.text' ELSE '' END), ''), '') END AS txt,
 coalesce(CASE WHEN json_type(p, '$.message') = 'VARCHAR' THEN p ->> '$.message' END, CASE WHEN json_type(p, '$.text') = 'VARCHAR' THEN p ->> '$.text' END) AS said FROM lb)
SELECT file_path, CAST(sum(CASE WHEN type = 'event_msg' AND p ->> '$.type' = 'user_message' THEN coalesce({_U16.format('said')}, 0) ELSE 0 END) AS BIGINT) AS human_chars,
 CAST(sum(CASE WHEN type = 'session_meta' AND json_type(p, '$.base_instructions') = 'VARCHAR' THEN {_U16.format("(p ->> '$.base_instructions')")} WHEN type = 'response_item' AND p ->> '$.type' = 'message' AND (p ->> '$.role' = 'developer' OR (p ->> '$.role' = 'user' AND regexp_matches(txt, '^\\s*<'))) THEN coalesce({_U16.format('txt')}, 0) ELSE 0 END) AS BIGINT) AS harness_chars,
 CAST(sum(CASE WHEN type = 'response_item' AND p ->> '$.type' IN ('function_call_output', 'custom_tool_call_output') AND json_type(p, '$.output') = 'VARCHAR' THEN {_U16.format("(p ->> '$.output')")} ELSE 0 END) AS BIGINT) AS tool_chars FROM v GROUP BY 1""")
def b_content_volume(spark, folder):
    return b.volume(lines_b(spark, folder))


@query(f"WITH {LINES_B} SELECT file_path, line_no, timestamp AS ts_raw FROM lb WHERE type = 'compacted'")
def b_compactions(spark, folder):
    return lines_b(spark, folder).filter("type = 'compacted'").select("file_path", "line_no", F.col("timestamp").alias("ts_raw"))


@query(f"""WITH {TURNS_B}, t AS (SELECT file_path, turn_idx, regexp_replace(string_agg(coalesce(p ->> '$.message', p ->> '$.text'), chr(10) ORDER BY line_no), '^\\s+|\\s+$', '', 'g') AS response FROM rb WHERE type = 'event_msg' AND p ->> '$.type' = 'agent_message' AND turn_idx IS NOT NULL GROUP BY ALL) SELECT * FROM t WHERE response <> ''""")
def b_responses(spark, folder):
    return b.responses(b.in_turns(lines_b(spark, folder)))


@query(f"""WITH {TURNS_B}, ok AS (SELECT DISTINCT file_path FROM rb WHERE turn_idx = 0)
SELECT file_path, count(*) FILTER (coalesce(turn_idx <= 0, true)) AS kept, count(*) FILTER (turn_idx > 0) AS dropped FROM rb JOIN ok USING (file_path) GROUP BY 1""")
def b_fork_at_first_turn(spark, folder):
    rows = b.in_turns(lines_b(spark, folder)).select("file_path", "line_no", "turn_idx")
    ok = rows.filter("turn_idx = 0").select("file_path").distinct()
    return rows.join(ok, "file_path", "left_semi").groupBy("file_path").agg(F.count_if(F.coalesce(F.col("turn_idx") <= 0, F.lit(True))).alias("kept"), F.count_if(F.col("turn_idx") > 0).alias("dropped"))
