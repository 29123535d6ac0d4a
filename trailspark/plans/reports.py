"""Queries over the facts of sessions of both agents, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros
from ..operators import cluster as cl
from ..operators import facts as fx
from ..operators import format_a
from ..operators import rollups as ro
from ..operators import signals as sg
from ..sources.testdata import table
from . import sessions as ss
from .formats import _BLOCKS, _BUILTIN, _CALLS, _CUM, SQL as FORMAT_SQL
from .sqlparts import LINES_B, STEPS_A, TIME

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _readable(sql)
        return f

    return add


_ONCE_A = "once AS (SELECT DISTINCT ON (file_path, line_no) * FROM claude_records ORDER BY file_path, line_no, ingested_at DESC)"


def _readable(sql: str) -> str:
    """The SQL with unreadable content taken for none at once: in large queries the engine moves JSON functions before the test of validity."""
    content = "CASE WHEN message IS NOT NULL THEN struct_pack(id := message.id, role := message.role, model := message.model, content := CASE WHEN json_valid(message.content) THEN message.content END, usage := message.usage) END"
    return sql.replace(_ONCE_A, f"once AS MATERIALIZED (SELECT * REPLACE ({content} AS message) FROM (SELECT DISTINCT ON (file_path, line_no) * FROM claude_records ORDER BY file_path, line_no, ingested_at DESC))")


def all_facts(spark, folder):
    return fx.facts(table(spark, folder, "claude_records"), table(spark, folder, "codex_lines"))


def sessions(spark, folder):
    return fx.by_session(all_facts(spark, folder))


def stats(spark, folder):
    """What the prompts of each session sum up to."""
    return ss.signals(spark, folder).groupBy("session_id").agg(F.count("*").alias("prompts"), F.count_if("is_correction").alias("corrections"), F.sum("chars").alias("prompt_chars"), F.sum("specificity").alias("specificity_sum"), F.sum("vague").alias("vague"), F.median("gap_ms").alias("median_gap_ms"))


def _named(name: str, sql: str) -> str:
    """The query of another module as a CTE."""
    return f"{name} AS ({sql})"


def _us(c: str) -> str:
    return TIME.format(c=c)


_ROUND = ss._ROUND
_TURNS = _named("turns", FORMAT_SQL["b_turns"])
_FACTS = f"""{STEPS_A}{_CALLS}{_BLOCKS},
opn AS (SELECT file_path, min(line_no) FILTER (row_class IN ('prompt', 'command')) AS open_at, min(line_no) FILTER (type = 'assistant' AND message IS NOT NULL) AS said_at FROM la GROUP BY 1),
sid AS (SELECT file_path, arg_max(s, line_no) AS sid FROM (SELECT la.file_path, line_no, nullif(coalesce(sessionId, session_id), '') AS s FROM la JOIN opn USING (file_path) WHERE line_no <= coalesce(least(open_at, said_at), line_no)) WHERE s IS NOT NULL GROUP BY 1),
hda AS (SELECT file_path, count(*) FILTER (row_class IN ('prompt', 'command')) AS opened, count(*) FILTER (row_class = 'command') AS commands, count(*) FILTER (row_class = 'interruption') AS interruptions, count(*) FILTER (type = 'pr-link') AS pr_links,
 count(*) FILTER (isCompactSummary) AS compactions, count(*) FILTER (isCompactSummary AND compactMetadata.trigger = 'auto') AS compactions_auto, count(*) FILTER (isCompactSummary AND compactMetadata.trigger = 'manual') AS compactions_manual,
 max(compactMetadata.preTokens) FILTER (isCompactSummary) AS max_pre_tokens, count(*) FILTER (type = 'user' AND toolUseResult.agentId IS NOT NULL) AS subagents, arg_min(text, line_no) FILTER (row_class IN ('prompt', 'command')) AS first_prompt FROM la GROUP BY 1),
usa AS (SELECT file_path, count(*) AS api_calls, sum(i) AS i, sum(o) AS o, sum(r) AS r, sum(c) AS c FROM calls GROUP BY 1),
lnk AS (SELECT c.file_path, c.line_no, c.pos, c.name, arg_max(r.is_error, r.line_no * 1000 + r.pos) AS err FROM tc c LEFT JOIN tr r ON c.file_path = r.file_path AND c.call_id = r.call_id AND r.line_no > c.line_no GROUP BY ALL),
tla AS (SELECT file_path, count(*) AS tool_calls, count(*) FILTER (regexp_matches(name, '^mcp__(.+?)__')) AS mcp_calls, count(*) FILTER (err) AS tool_errors FROM lnk GROUP BY 1),
{_named('ata', FORMAT_SQL['a_session_attributes'])}, {_named('vla', FORMAT_SQL['a_content_volume'])},
fa AS (SELECT 'a' AS agent, file_path, coalesce(sid, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.jsonl$', '')) AS session_id, title, cwd, git_branch, started_raw, ended_raw, opened + CASE WHEN said_at < coalesce(open_at, said_at + 1) THEN 1 ELSE 0 END AS steps,
 coalesce(api_calls, 0) AS api_calls, coalesce(tool_calls, 0) AS tool_calls, coalesce(tool_errors, 0) AS tool_errors, coalesce(mcp_calls, 0) AS mcp_calls, subagents, interruptions, commands, pr_links, compactions, compactions_auto, compactions_manual, max_pre_tokens,
 coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(r, 0) AS cache_read_tokens, coalesce(c, 0) AS cache_write_tokens, coalesce(i + o + r + c, 0) AS total_tokens, human_chars, harness_chars, tool_chars, false AS is_subagent, first_prompt
 FROM hda JOIN opn USING (file_path) LEFT JOIN sid USING (file_path) LEFT JOIN usa USING (file_path) LEFT JOIN tla USING (file_path) JOIN ata USING (file_path) JOIN vla USING (file_path)),
{_TURNS}, {_named('usb', FORMAT_SQL['b_session_usage'])}, {_named('meb', FORMAT_SQL['b_session_meta'])}, {_named('vlb', FORMAT_SQL['b_content_volume'])}, {_named('tlb', FORMAT_SQL['b_tool_calls'])}, {LINES_B},
hdb AS (SELECT file_path, count(*) FILTER (type = 'compacted') AS compactions, arg_min(timestamp, line_no) FILTER (timestamp <> '') AS started_raw, arg_max(timestamp, line_no) FILTER (timestamp <> '') AS ended_raw,
 min(line_no) FILTER (type = 'event_msg' AND p ->> '$.type' = 'task_started' OR type = 'response_item' AND p ->> '$.type' IN ('function_call', 'custom_tool_call') AND json_type(p, '$.call_id') = 'VARCHAR') AS begun FROM lb GROUP BY 1),
apb AS (SELECT file_path, count(*) AS api_calls FROM lb JOIN hdb USING (file_path) WHERE type = 'event_msg' AND p ->> '$.type' = 'token_count' AND line_no > begun GROUP BY 1),
tnb AS (SELECT file_path, count(*) AS steps, count(*) FILTER (aborted) AS interruptions, count(*) FILTER (kind = 'command') AS commands, arg_min(prompt_text, turn_idx) AS first_prompt FROM turns GROUP BY 1),
cub AS (SELECT file_path, count(*) AS tool_calls, count(*) FILTER (is_mcp) AS mcp_calls FROM tlb GROUP BY 1),
fb AS (SELECT 'b' AS agent, file_path, coalesce(session_id, file_path) AS session_id, NULL AS title, cwd, git_branch, started_raw, ended_raw, coalesce(steps, 0) AS steps, coalesce(api_calls, 0) AS api_calls, coalesce(tool_calls, 0) AS tool_calls, 0 AS tool_errors, coalesce(mcp_calls, 0) AS mcp_calls, 0 AS subagents,
 coalesce(interruptions, 0) AS interruptions, coalesce(commands, 0) AS commands, 0 AS pr_links, compactions, 0 AS compactions_auto, 0 AS compactions_manual, NULL AS max_pre_tokens, coalesce(input, 0) AS input_tokens, coalesce(output, 0) AS output_tokens, coalesce(cache_read, 0) AS cache_read_tokens, 0 AS cache_write_tokens,
 coalesce(total, 0) AS total_tokens, human_chars, harness_chars, tool_chars, coalesce(is_subagent, false) AS is_subagent, first_prompt
 FROM hdb LEFT JOIN usb USING (file_path) LEFT JOIN tnb USING (file_path) LEFT JOIN cub USING (file_path) LEFT JOIN apb USING (file_path) LEFT JOIN meb USING (file_path) LEFT JOIN vlb USING (file_path)),
facts AS MATERIALIZED (SELECT * FROM fa UNION ALL SELECT * FROM fb),
sess AS (SELECT agent, session_id, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in [*fx.TOTALS, 'compactions_auto', 'compactions_manual', *fx.USAGE, *fx.VOLUME])}, max(max_pre_tokens) AS max_pre_tokens, min(started_raw) AS started_raw, max(ended_raw) AS ended_raw,
 {', '.join(f'arg_min({c}, file_path) FILTER ({c} IS NOT NULL) AS {c}' for c in ('title', 'cwd', 'git_branch', 'first_prompt'))}, bool_or(is_subagent) AS is_subagent FROM facts GROUP BY ALL)"""
_COLS = ", ".join(c if c not in {*fx.TOTALS, "compactions_auto", "compactions_manual", *fx.USAGE, *fx.VOLUME, "max_pre_tokens"} else f"CAST({c} AS BIGINT) AS {c}" for c in fx.COLUMNS)


@query(f"WITH {_FACTS} SELECT {_COLS} FROM facts")
def session_facts(spark, folder):
    return all_facts(spark, folder)


_STATS = f"{ss._SIG}, stat AS (SELECT session_id, count(*) AS prompts, count(*) FILTER (is_correction) AS corrections, CAST(sum(chars) AS BIGINT) AS prompt_chars, sum(specificity) AS spec, CAST(sum(vague) AS BIGINT) AS vague, median(gap_ms) AS gap FROM sig GROUP BY 1)"
_METRICS = f"{_FACTS}, {_STATS}, met AS (SELECT agent, coalesce(s.session_id, t.session_id) AS session_id, coalesce(prompts, 0) AS prompts, coalesce(corrections, 0) AS corrections, coalesce(interruptions, 0) AS interruptions, coalesce(commands, 0) AS commands, coalesce(prompt_chars, 0) AS prompt_chars, coalesce(output_tokens, 0) AS output_tokens, coalesce(tool_calls, 0) AS tool_calls, coalesce(vague, 0) AS vague, spec, gap FROM sess s FULL JOIN stat t USING (session_id))"


@query(f"WITH {_METRICS} SELECT agent, session_id, prompts, corrections, interruptions, commands, prompt_chars, output_tokens, tool_calls, vague, spec AS specificity_sum, gap AS median_gap_ms, CASE WHEN prompt_chars > 0 THEN CAST(floor(output_tokens / (prompt_chars / 1000) + 0.5) AS BIGINT) END AS output_per_kchar, {_ROUND.format('spec / prompts', '10000.0')} AS avg_specificity FROM met")
def session_metrics(spark, folder):
    return fx.session_metrics(sessions(spark, folder), stats(spark, folder))


_RATE = lambda x: f"CASE WHEN steps > 0 THEN {_ROUND.format(f'{x} / steps', '1000000.0')} ELSE 0 END"


@query(f"""WITH {_METRICS}, g AS (SELECT agent, CAST(grouping(agent) AS INTEGER) AS overall, count(*) AS sessions, CAST(sum(prompts) AS BIGINT) AS steps, CAST(sum(corrections) AS BIGINT) AS corrections, CAST(sum(interruptions) AS BIGINT) AS interruptions, CAST(sum(commands) AS BIGINT) AS commands, CAST(sum(prompt_chars) AS BIGINT) AS prompt_chars, sum(spec) AS sp, sum(vague) AS v, sum(output_tokens) AS o, sum(tool_calls) AS k
 FROM met WHERE agent IS NOT NULL OR prompts > 0 GROUP BY GROUPING SETS ((), (agent)))
SELECT agent, overall, sessions, steps, corrections, interruptions, commands, prompt_chars, CASE WHEN steps > 0 THEN CAST(floor(prompt_chars / steps + 0.5) AS BIGINT) ELSE 0 END AS avg_prompt_chars, CASE WHEN steps > 0 THEN {_ROUND.format('sp / steps', '10000.0')} END AS avg_specificity, CASE WHEN steps > 0 THEN floor(v / steps * 100 + 0.5) / 10 ELSE 0 END AS vague_per_ten,
 {_RATE('corrections')} AS correction_rate, {_RATE('interruptions')} AS interruption_rate, CASE WHEN prompt_chars > 0 THEN CAST(floor(o / (prompt_chars / 1000) + 0.5) AS BIGINT) END AS output_per_kchar, {_RATE('k')} AS tool_calls_per_step, {_ROUND.format('steps / sessions', '1000000.0')} AS steps_per_session FROM g WHERE overall = 1 OR agent IS NOT NULL""")
def prompter_report(spark, folder):
    """The fourteen metrics overall and per agent."""
    return fx.aggregate(session_metrics(spark, folder))


_DUR = f"CASE WHEN {_us('ended_raw')} >= {_us('started_raw')} THEN floor(({_us('ended_raw')} - {_us('started_raw')}) / 1000) ELSE 0 END"


@query(f"""WITH {_FACTS}, s AS (SELECT *, CAST(floor(coalesce({_DUR}, 0) / 1000 + 0.5) AS BIGINT) AS duration_s FROM sess), e AS (SELECT min(session_id) AS x, max(session_id) AS y FROM sess WHERE agent = 'a'),
u AS (SELECT session_id, metric, CAST(v AS BIGINT) AS v FROM (SELECT session_id, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in fx.COMPARED)} FROM s) UNPIVOT (v FOR metric IN ({', '.join(fx.COMPARED)}))),
g AS (SELECT metric, max(v) FILTER (session_id = e.x) AS a, max(v) FILTER (session_id = e.y) AS b FROM u, e GROUP BY 1) SELECT metric, a, b, b - a AS delta, CASE WHEN a <> 0 THEN {_ROUND.format('(b - a) / a * 100', '100.0')} WHEN b = 0 THEN 0.0 END AS delta_pct FROM g""")
def compare_reports(spark, folder):
    """The fourteen rows of a comparison of the first and the last format A session by id."""
    f = sessions(spark, folder)
    ends = f.filter("agent = 'a'").agg(F.min("session_id").alias("a"), F.max("session_id").alias("b"))
    return fx.compared(f, ends.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("session_id")), F.struct(F.lit("b").alias("side"), F.col("b").alias("session_id")))).alias("x")).select("x.*"))


_WF = f"{_FACTS}, {_named('wc', ss.SQL['workflow_counts'])}, wf AS (SELECT s.session_id, agent, steps, total_tokens, compactions, compactions_auto, compactions_manual, max_pre_tokens, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('git_commits', 'git_pushes', 'git_branch_ops', 'issue_ops', 'pr_ops', 'file_edits'))}, git_branch AS branch, coalesce(git_branch IN ('main', 'master'), false) AS on_default_branch, pr_links FROM sess s LEFT JOIN wc ON wc.session_id = s.session_id)"


def workflows(spark, folder):
    return fx.workflow(sessions(spark, folder), ro.workflow(ss.calls(spark, folder)))


@query(f"WITH {_WF} SELECT * FROM wf")
def workflow_report(spark, folder):
    return workflows(spark, folder)


@query(f"""WITH {_WF} SELECT count(*) AS sessions, count(*) FILTER (compactions > 0) AS sessions_with_compactions, CAST(sum(compactions) AS BIGINT) AS compactions, CASE WHEN sum(compactions_auto + compactions_manual) > 0 THEN {_ROUND.format('sum(compactions_auto) / sum(compactions_auto + compactions_manual)', '1000000.0')} END AS auto_share,
 count(*) FILTER (git_commits > 0) AS sessions_committing, count(*) FILTER (file_edits >= 10 AND git_commits = 0) AS sessions_editing_without_commit FROM wf""")
def workflow_totals(spark, folder):
    return fx.workflow_totals(workflows(spark, folder))


_WRULES = {"compact-heavy": "compactions > 0", "uncommitted-work": "file_edits >= 10 AND git_commits = 0", "mainline-editing": "on_default_branch AND file_edits >= 10 AND git_branch_ops = 0", "untracked-outcomes": "steps >= 10 AND git_commits = 0 AND pr_links = 0 AND issue_ops = 0 AND pr_ops = 0"}
_WL = f"{_WF}, r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS hits, count(*) AS \"of\" FROM wf" for n, c in _WRULES.items()) + ")"


@query(f"""WITH {_WL} SELECT * FROM r WHERE hits > 0 UNION ALL SELECT 'all-clear', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM r WHERE hits > 0)""")
def workflow_lints(spark, folder):
    return fx.workflow_lints(workflows(spark, folder))


@query(f"WITH {_WF}, e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, agent, session_id FROM wf WHERE {c}" for n, c in _WRULES.items()) + ") SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY agent, session_id) - 1 AS place, session_id FROM e QUALIFY place < 3")
def workflow_lint_examples(spark, folder):
    return fx.workflow_lint_examples(workflows(spark, folder))


_MODELF = f"""{_FACTS}, {_named('ma', FORMAT_SQL['a_model_usage'])}, {_named('mb', FORMAT_SQL['b_model_usage'])}, mu AS (SELECT 'a' AS agent, file_path, model AS raw, api_calls, output FROM ma UNION ALL SELECT 'b', file_path, model, api_calls, output FROM mb),
mf AS (SELECT mu.*, regexp_replace(raw, '-20\\d{{6}}(\\s|$|\\()', '\\1') AS model, started_raw, strftime(date_trunc('week', make_timestamp({_us('started_raw')})), '%Y-%m-%d') AS week FROM mu JOIN facts USING (agent, file_path) WHERE NOT starts_with(raw, '<'))"""


def models(spark, folder):
    r, c = table(spark, folder, "claude_records"), table(spark, folder, "codex_lines")
    return fx.model_files(r, c, all_facts(spark, folder))


@query(f"WITH {_MODELF}, g AS (SELECT agent, model, count(*) AS sessions, CAST(sum(api_calls) AS BIGINT) AS api_calls, CAST(sum(output) AS BIGINT) AS output, min(started_raw) AS first_seen, max(started_raw) AS last_seen FROM mf GROUP BY ALL) SELECT *, {_ROUND.format('api_calls / sum(api_calls) OVER (PARTITION BY agent)', '1000000.0')} AS share, row_number() OVER (PARTITION BY agent ORDER BY api_calls DESC, model) = 1 AS favourite FROM g")
def model_stats(spark, folder):
    return fx.model_stats(models(spark, folder))


_MWEEK = f"{_MODELF}, g AS (SELECT week, model, CAST(sum(api_calls) AS BIGINT) AS n FROM mf WHERE week IS NOT NULL GROUP BY ALL), wd AS (SELECT week, model, n, CAST(sum(n) OVER (PARTITION BY week) AS BIGINT) AS total, row_number() OVER (PARTITION BY week ORDER BY n DESC, model) AS k FROM g)"


def model_weekly(spark, folder):
    per = models(spark, folder).filter("week is not null").groupBy("week", "model").agg(F.sum("api_calls").alias("n"))
    g = per.groupBy("week").agg(F.min(F.struct((-F.col("n")).alias("m"), "model")).alias("t"), F.sum("n").alias("total"))
    return g.select("week", F.col("t.model").alias("model"), (-F.col("t.m")).alias("n"), "total")


@query(f"WITH {_MWEEK} SELECT week, model, n, total FROM wd WHERE k = 1 ORDER BY week DESC LIMIT 10")
def model_weeks(spark, folder):
    """The dominant model of each of the last ten weeks, over both agents."""
    return model_weekly(spark, folder).orderBy(F.desc("week")).limit(10)


@query(f"WITH {_MWEEK}, s AS (SELECT week, lag(model) OVER (ORDER BY week) AS from_value, model AS to_value FROM wd WHERE k = 1) SELECT * FROM s WHERE from_value IS NOT NULL AND from_value <> to_value")
def model_week_switches(spark, folder):
    return ro.switches(model_weekly(spark, folder), "week", "model")


_DAYS = f"{ss._MODELS}, dm AS (SELECT day, model, CAST(sum(o) AS BIGINT) AS tokens FROM mc WHERE day IS NOT NULL GROUP BY ALL)"


def daily_matrix(spark, folder):
    """A day's output tokens by model, in the form of the usage cache."""
    per = ss.model_calls(spark, folder).filter("day is not null").groupBy("day", "model").agg(F.sum("output").alias("tokens"))
    return per.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("model", "tokens"))).alias("tokens_by_model"))


@query(f"WITH {_DAYS} SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, min(day) AS first_day, max(day) AS last_day FROM dm WHERE tokens > 0 GROUP BY 1")
def model_daily_history(spark, folder):
    return fx.daily_history(daily_matrix(spark, folder))


@query(f"WITH {_DAYS} SELECT count(DISTINCT day) AS days, min(day) AS from_day, max(day) AS to_day FROM dm")
def model_daily_span(spark, folder):
    return fx.daily_span(daily_matrix(spark, folder))


@query(f"""WITH {_FACTS}, {_STATS} SELECT cwd, count(*) AS sessions, count(*) FILTER (agent = 'a') AS sessions_a, count(*) FILTER (agent = 'b') AS sessions_b, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in [*fx.TOTALS, *fx.USAGE, *fx.VOLUME])},
 CAST(coalesce(sum(corrections), 0) AS BIGINT) AS corrections, min(started_raw) AS first_at, max(started_raw) AS last_at FROM sess s LEFT JOIN stat USING (session_id) WHERE cwd IS NOT NULL GROUP BY 1""")
def project_report(spark, folder):
    """Usage, volume, totals and span of each folder, over both agents."""
    return fx.project_report(sessions(spark, folder), stats(spark, folder).select("session_id", "corrections"))


@query(f"WITH {_FACTS}, x AS (SELECT cwd, agent, session_id, title, started_raw, steps, total_tokens, row_number() OVER (PARTITION BY cwd ORDER BY started_raw DESC NULLS LAST, session_id) AS k FROM sess WHERE cwd IS NOT NULL) SELECT * EXCLUDE (k) FROM x WHERE k <= 10")
def project_recent(spark, folder):
    """The ten newest sessions of each folder."""
    f = sessions(spark, folder).filter("cwd is not null").select("cwd", "agent", "session_id", "title", "started_raw", "steps", "total_tokens")
    return ro.newest(f, "cwd", [F.desc_nulls_last("started_raw"), F.col("session_id")], 10)


@query(f"WITH {_FACTS}, {ss._TC.replace('tc AS', 'tcx AS', 1)}, x AS (SELECT cwd, name, count(*) AS calls, count(*) FILTER (isError) AS errors FROM tcx JOIN sess USING (session_id) WHERE cwd IS NOT NULL AND name IS NOT NULL GROUP BY ALL) SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY cwd ORDER BY calls DESC, name) <= 12")
def project_top_tools(spark, folder):
    """The twelve most used tools of each folder."""
    met = ss.calls(spark, folder).join(sessions(spark, folder).filter("cwd is not null").select("session_id", "cwd"), "session_id").filter("name is not null")
    per = met.groupBy("cwd", "name").agg(F.count("*").alias("calls"), F.count_if(F.coalesce("isError", F.lit(False))).alias("errors"))
    return ro.newest(per, "cwd", [F.desc("calls"), F.col("name")], 12)


@query(f"WITH {_FACTS}, v AS (SELECT sum(human_chars) AS human_chars, sum(harness_chars) AS harness_chars, sum(tool_chars) AS tool_chars FROM facts), u AS (SELECT kind, CAST(chars AS BIGINT) AS chars FROM v UNPIVOT (chars FOR kind IN (human_chars, harness_chars, tool_chars))) SELECT kind, chars, CASE WHEN sum(chars) OVER () > 0 THEN CAST(floor(chars / sum(chars) OVER () * 100 + 0.5) AS BIGINT) ELSE 0 END AS pct FROM u")
def volume_shares(spark, folder):
    return fx.volume_shares(all_facts(spark, folder))


_SENTINEL = "Run it again"


@query(f"WITH {_FACTS} SELECT agent, session_id, coalesce(starts_with(first_prompt, '{_SENTINEL}'), false) AS internal, is_subagent FROM sess WHERE NOT coalesce(starts_with(first_prompt, '{_SENTINEL}'), false) AND NOT is_subagent")
def human_sessions(spark, folder):
    """Sessions that neither the engine itself (told by a sentinel) nor another agent started."""
    f = fx.without_subagents(fx.without_internal(sessions(spark, folder), _SENTINEL))
    return f.select("agent", "session_id", F.coalesce(F.col("first_prompt").startswith(_SENTINEL), F.lit(False)).alias("internal"), "is_subagent")


@query(f"WITH {_FACTS} SELECT agent, session_id, cwd FROM sess WHERE cwd = '/home/dev/work' OR starts_with(cwd, '/home/dev/work/')")
def repo_sessions(spark, folder):
    return fx.in_repo(sessions(spark, folder), "/home/dev/work/").select("agent", "session_id", "cwd")


def _live(spark, folder):
    """Folders taken as live: those whose name is in the first half of the alphabet."""
    return sessions(spark, folder).filter("cwd is not null").select("cwd").distinct().filter(F.lower(F.regexp_extract("cwd", r"([^/]*)$", 1)) < "n")


_ORPH = f"{_FACTS}, lv AS (SELECT DISTINCT cwd FROM sess WHERE lower(regexp_extract(cwd, '([^/]*)$', 1)) < 'n'), ob AS (SELECT s.*, lv.cwd IS NULL AS orphaned FROM sess s LEFT JOIN lv ON s.cwd = lv.cwd)"


@query(f"WITH {_ORPH} SELECT agent, session_id, orphaned FROM ob")
def orphaned_sessions(spark, folder):
    return fx.with_orphaned(sessions(spark, folder), _live(spark, folder)).select("agent", "session_id", "orphaned")


@query(f"WITH {_ORPH}, g AS (SELECT coalesce(cwd, '') AS cwd, orphaned, count(*) AS sessions, max(ended_raw) AS last_active FROM ob GROUP BY ALL) SELECT *, CAST(row_number() OVER (ORDER BY orphaned, last_active DESC NULLS LAST, cwd) AS INTEGER) AS place FROM g")
def project_listing(spark, folder):
    """Folders in the order of a listing: live ones first, newest first, orphans last."""
    return fx.project_groups(fx.with_orphaned(sessions(spark, folder), _live(spark, folder)))


@query(f"WITH {_FACTS} SELECT agent, session_id, started_raw FROM sess QUALIFY row_number() OVER (PARTITION BY agent ORDER BY started_raw DESC NULLS LAST, session_id) <= 15")
def newest_per_agent(spark, folder):
    return fx.newest_per_agent(sessions(spark, folder), 15).select("agent", "session_id", "started_raw")


_DATES = ["2026-06-03T00:00:00Z", "2026-06-10T12:00:00+02:00", "2026-06-20T00:00:00Z"]
_SAMPLES = f"{_FACTS}, {_STATS}, sm AS (SELECT session_id, {_us('started_raw')} AS t, coalesce(prompts, 0) AS prompts, coalesce(corrections, 0) AS corrections, interruptions FROM sess LEFT JOIN stat USING (session_id) WHERE {_us('started_raw')} IS NOT NULL)"


@query(f"""WITH {_SAMPLES}, ch AS (SELECT id AS change_id, {_us('d')} AS ct FROM (VALUES {', '.join(f"('c{i}', '{d}')" for i, d in enumerate(_DATES))}) v(id, d)),
r AS (SELECT change_id, prompts, corrections, interruptions, 'before' AS side, row_number() OVER (PARTITION BY change_id ORDER BY t DESC, session_id DESC) AS k FROM ch JOIN sm ON t < ct UNION ALL SELECT change_id, prompts, corrections, interruptions, 'after', row_number() OVER (PARTITION BY change_id ORDER BY t, session_id) FROM ch JOIN sm ON t >= ct)
SELECT change_id, side, count(*) AS sessions, CAST(sum(prompts) AS BIGINT) AS prompts, CASE WHEN sum(prompts) > 0 THEN {_ROUND.format('sum(corrections) / sum(prompts)', '1000000.0')} END AS correction_rate, CASE WHEN sum(prompts) > 0 THEN {_ROUND.format('sum(interruptions) / sum(prompts)', '1000000.0')} END AS interruption_rate FROM r WHERE k <= 10 GROUP BY ALL""")
def efficacy(spark, folder):
    """Steering in the ten sessions before and after each change of instructions (dates stand in for a file's history)."""
    changes = spark.createDataFrame([(f"c{i}", d) for i, d in enumerate(_DATES)], "change_id string, d string").select("change_id", micros(F.col("d")).alias("t"))
    return ro.efficacy(changes, fx.steering_samples(sessions(spark, folder), stats(spark, folder)), 10)


@query(f"WITH {ss._ONCE}, l AS (SELECT session_id, max(us) AS m FROM st GROUP BY 1), p AS (SELECT st.id, st.session_id, m, regexp_replace(regexp_replace(promptText, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM st LEFT JOIN l ON st.session_id IS NOT DISTINCT FROM l.session_id WHERE promptText IS NOT NULL), e AS (SELECT id, session_id, m, CASE WHEN length(x) > 600 THEN substring(x, 1, 599) || '…' ELSE x END AS excerpt FROM p) SELECT id, excerpt, session_id, count(*) OVER (PARTITION BY id, excerpt) AS copies FROM e QUALIFY row_number() OVER (PARTITION BY id, excerpt ORDER BY m DESC NULLS LAST, session_id DESC) = 1")
def first_of_forks(spark, folder):
    return ro.first_of_forks(ss.steps(spark, folder).filter("promptText is not null"))


@query(f"WITH {_FACTS}, th(theme, s) AS (SELECT 'early', list(substring(session_id, 1, 8) ORDER BY session_id)[1:3] || ['nothere0'] FROM sess WHERE agent = 'a' UNION ALL SELECT 'lone', ['nothere1']), k AS (SELECT substring(session_id, 1, 8) AS short, max(session_id) AS session_id FROM sess GROUP BY 1), m AS (SELECT theme, session_id FROM (SELECT theme, unnest(s) AS short FROM th) JOIN k USING (short)) SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY theme) >= 2")
def theme_sessions(spark, folder):
    """Themes (as a model names them, by short ids) met with the sessions they mean."""
    f = sessions(spark, folder)
    first = f.filter("agent = 'a'").select("session_id").orderBy("session_id").limit(3).agg(F.collect_list(tx.short_id(F.col("session_id"))).alias("s"))
    themes = first.select(F.lit("early").alias("theme"), F.concat("s", F.array(F.lit("nothere0"))).alias("sessions")).unionByName(first.select(F.lit("lone").alias("theme"), F.array(F.lit("nothere1")).alias("sessions")))
    return fx.themes_of(f, themes)


@query(f"WITH {ss._ONCE} SELECT id, CAST(floor((length(promptText) + length(regexp_replace(promptText, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) / 4 + 0.5) AS BIGINT) AS tokens FROM st WHERE promptText IS NOT NULL")
def token_estimates(spark, folder):
    """A rough number of tokens: a quarter of the characters."""
    return ss.steps(spark, folder).filter("promptText is not null").select("id", tx.estimated_tokens(F.col("promptText")).alias("tokens"))


@query(f"WITH {ss._SIG}, g AS (SELECT week, count(DISTINCT session_id) AS sessions, count(*) AS steps FROM sig WHERE week IS NOT NULL GROUP BY 1) SELECT * FROM g ORDER BY week DESC LIMIT 10")
def last_weeks(spark, folder):
    """The last ten weeks of the weekly curve."""
    return sg.weekly(ss.signals(spark, folder)).select("week", "sessions", "steps").orderBy(F.desc("week")).limit(10)


@query(f"WITH {ss._SIG} SELECT id, hour(make_timestamp(us) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Berlin') AS hour FROM sig WHERE us IS NOT NULL")
def local_hours(spark, folder):
    """The hour of each prompt in a zone."""
    return ss.signals(spark, folder).filter("us is not null").select("id", tx.local_hour(F.col("us"), "Europe/Berlin").alias("hour"))


@query()
def cluster_examples(spark, folder):
    """Each cluster's first three prompts, first five members, and the first answer that one of them got."""
    # Neither gaps nor neighbours of a prompt have a part in its cluster.
    return cl.examples(sg.featured(table(spark, folder, "steps")), format_a.answers(table(spark, folder, "claude_records")))
