"""Pieces of SQL (DuckDB) shared by the reference queries."""

TIME = """CASE WHEN regexp_matches({c}, '^\\d{{9,15}}$') THEN CAST({c} AS BIGINT) * 1000
 WHEN regexp_matches({c}, '^\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d') THEN epoch_us(TRY_CAST({c} AS TIMESTAMPTZ)) END"""
TEXT = """CASE WHEN NOT coalesce(json_valid(message.content), false) THEN '' WHEN json_type(message.content) = 'VARCHAR' THEN message.content ->> '$'
 WHEN json_type(message.content) = 'ARRAY' THEN coalesce(array_to_string(list_transform(list_filter(CAST(json(message.content) AS JSON[]), lambda b: (b ->> '$.type') = 'text' AND json_type(b, '$.text') = 'VARCHAR'), lambda b: b ->> '$.text'), chr(10)), '') ELSE '' END"""
RESULT = "CASE WHEN json_valid(message.content) AND json_type(message.content) = 'ARRAY' THEN len(list_filter(CAST(json(message.content) AS JSON[]), lambda b: (b ->> '$.type') = 'tool_result')) > 0 ELSE false END"
CLASS = """CASE WHEN coalesce(type, '') <> 'user' OR coalesce(isMeta, false) OR coalesce(isCompactSummary, false) OR coalesce(isSidechain, false) OR result OR tx = '' THEN 'other'
 WHEN starts_with(tx, '[Request interrupted') THEN 'interruption' WHEN regexp_matches(tx, '<command-name>\\s*([^<\\n]+?)\\s*</command-name>') THEN 'command'
 WHEN starts_with(tx, '<local-command-stdout>') THEN 'command-output' WHEN regexp_matches(tx, '^<(system-reminder|task-notification|background-task|tool-reminder)\\b') THEN 'other' ELSE 'prompt' END"""
#: Lines of format A once, classified; then with their step.
LINES_A = f"""once AS (SELECT DISTINCT ON (file_path, line_no) * FROM claude_records ORDER BY file_path, line_no, ingested_at DESC),
parsed AS (SELECT *, {TEXT} AS text, {RESULT} AS result FROM once),
la AS (SELECT *, {CLASS} AS row_class FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS tx FROM parsed))"""
STEPS_A = (
    LINES_A
    + """, cnt AS (SELECT *, sum(CASE WHEN row_class IN ('prompt', 'command') THEN 1 ELSE 0 END) OVER w AS opened,
 sum(CASE WHEN row_class IN ('prompt', 'command') OR (type = 'assistant' AND message IS NOT NULL) THEN 1 ELSE 0 END) OVER w AS acted FROM la WINDOW w AS (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
ra AS (SELECT *, CAST(CASE WHEN opened > 0 THEN opened - 1 + max(CASE WHEN opened = 0 AND acted > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path) WHEN acted > 0 THEN 0 END AS BIGINT) AS step_idx FROM cnt)"""
)
#: Lines of format B once, with readable payloads; then with their turn.
LINES_B = """lb AS (SELECT line_id, file_path, line_no, timestamp, type, CASE WHEN json_valid(payload) THEN payload END AS p FROM (SELECT DISTINCT * FROM codex_lines))"""
TURNS_B = (
    LINES_B
    + """, kb AS (SELECT *, type = 'event_msg' AND p ->> '$.type' = 'task_started' AS started, type = 'response_item' AND p ->> '$.type' IN ('function_call', 'custom_tool_call') AND json_type(p, '$.call_id') = 'VARCHAR' AS called FROM lb),
cb AS (SELECT *, sum(CASE WHEN started THEN 1 ELSE 0 END) OVER w AS ns, sum(CASE WHEN started OR called THEN 1 ELSE 0 END) OVER w AS na FROM kb WINDOW w AS (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
rb AS (SELECT *, CAST(CASE WHEN ns > 0 THEN ns - 1 + max(CASE WHEN ns = 0 AND na > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path) WHEN na > 0 THEN 0 END AS BIGINT) AS turn_idx FROM cb)"""
)
