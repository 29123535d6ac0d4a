"""Queries over steps, tool calls, models and changes, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros, week_key
from ..operators import cluster as cl
from ..operators import records as rec
from ..operators import rollups as ro
from ..operators import signals as sg
from ..sources.testdata import table
from .sqlparts import LINES_A, TIME

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def steps(spark, folder):
    return sg.once(table(spark, folder, "steps")).withColumn("us", micros(F.col("timestamp")))


def signals(spark, folder):
    return sg.signals(table(spark, folder, "steps"))


def calls(spark, folder):
    return ro.calls_once(table(spark, folder, "tool_calls"))


def _esc(p: str) -> str:
    return p.replace("'", "''")


_T = TIME.format(c="timestamp")
_ROUND = "floor(({0}) * {1} + 0.5) / {1}"
_VAGUE = " + ".join(f"len(regexp_extract_all(lower(t), '\\b{p.replace(' ', chr(92) + 's+')}\\b'))" for p in tx.VAGUE)
_ONCE = f"st AS (SELECT *, {_T} AS us FROM (SELECT DISTINCT ON (id) * FROM steps WHERE id IS NOT NULL ORDER BY id, step_idx DESC))"
_FEAT = f"""{_ONCE}, f0 AS (SELECT *, regexp_replace(promptText, '^\\s+|\\s+$', '', 'g') AS t FROM st WHERE promptText IS NOT NULL AND regexp_replace(promptText, '^\\s+|\\s+$', '', 'g') <> ''),
f1 AS (SELECT *, length(t) + length(regexp_replace(t, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS chars, len(regexp_split_to_array(t, '\\s+')) AS words, regexp_matches(t, '\\?\\s*$') OR regexp_matches(t, '{_esc(tx.QUESTION)}') AS is_question,
 regexp_matches(t, '{_esc(tx.CORRECTION)}') AS is_correction, regexp_matches(t, '{_esc(tx.PATH)}') AS has_path, regexp_matches(t, '{_esc(tx.CODE)}') AS has_code, regexp_matches(t, '{_esc(tx.ENUMERATION)}') AS has_enumeration, {_VAGUE} AS vague FROM f0),
fx AS (SELECT *, greatest(0.0::DOUBLE, least(10.0::DOUBLE, floor((5 + CASE WHEN has_path THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN has_code THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN has_enumeration THEN 1 ELSE 0 END + CASE WHEN regexp_matches(t, '{_esc(tx.IMPERATIVE)}') THEN 1 ELSE 0 END
 + CASE WHEN chars BETWEEN 80 AND 2000 THEN 1 ELSE 0 END - CASE WHEN chars < 20 THEN 2 ELSE 0 END - least(3, vague)) * 10 + 0.5) / 10)) AS specificity FROM f1)"""
_SIG = f"""{_FEAT}, sx AS (SELECT *, lag(us) OVER w AS prev, coalesce(lead(is_correction) OVER w, false) AS corrected_by_next, strftime(date_trunc('week', make_timestamp(us)), '%Y-%m-%d') AS week FROM fx WINDOW w AS (PARTITION BY session_id ORDER BY step_idx, id)),
sig AS (SELECT *, CASE WHEN us >= prev THEN CAST(floor((us - prev) / 1000) AS BIGINT) END AS gap_ms FROM sx)"""


@query(f"WITH {_FEAT} SELECT id, chars, words, is_question, is_correction, has_path, has_code, has_enumeration, vague, specificity FROM fx")
def prompt_features(spark, folder):
    s = steps(spark, folder).filter(tx.trimmed(F.col("promptText")) != "")
    f = tx.prompt_features(F.col("promptText"))
    return s.select("id", *[c.alias(n) for n, c in f.items()])


@query(f"WITH {_SIG} SELECT id, gap_ms, corrected_by_next, week FROM sig")
def step_signals(spark, folder):
    return signals(spark, folder).select("id", "gap_ms", "corrected_by_next", "week")


@query(f"""WITH {_SIG} SELECT session_id, count(*) AS steps, count(*) FILTER (is_correction) AS corrections, CAST(sum(chars) AS BIGINT) AS prompt_chars, CAST(floor(sum(chars) / count(*) + 0.5) AS BIGINT) AS avg_prompt_chars,
 {_ROUND.format('avg(specificity)', '10000.0')} AS avg_specificity, CAST(sum(vague) AS BIGINT) AS vague_count, median(gap_ms) AS median_gap_ms FROM sig GROUP BY 1""")
def session_stats(spark, folder):
    return sg.session_stats(signals(spark, folder))


@query(f"""WITH {_SIG}, g AS (SELECT kind, CAST(grouping(kind) AS INTEGER) AS overall, count(DISTINCT session_id) AS sessions, count(*) AS steps, count(*) FILTER (is_correction) AS corrections, CAST(sum(chars) AS BIGINT) AS prompt_chars, CAST(floor(sum(chars) / count(*) + 0.5) AS BIGINT) AS avg_prompt_chars,
 {_ROUND.format('avg(specificity)', '10000.0')} AS avg_specificity, floor(sum(vague) / count(*) * 100 + 0.5) / 10 AS vague_per_ten FROM sig GROUP BY GROUPING SETS ((), (kind)))
SELECT *, {_ROUND.format('corrections / steps', '1000000.0')} AS correction_rate, {_ROUND.format('steps / sessions', '1000000.0')} AS steps_per_session FROM g""")
def prompter_totals(spark, folder):
    return sg.totals(signals(spark, folder), "kind")


@query(f"""WITH {_SIG} SELECT week, count(DISTINCT session_id) AS sessions, count(*) AS steps, {_ROUND.format('avg(CAST(is_correction AS DOUBLE))', '1000000.0')} AS correction_rate, {_ROUND.format('avg(CAST(coalesce(aborted, false) AS DOUBLE))', '1000000.0')} AS interruption_rate,
 {_ROUND.format('avg(specificity)', '10000.0')} AS avg_specificity FROM sig WHERE week IS NOT NULL GROUP BY 1""")
def weekly_curve(spark, folder):
    return sg.weekly(signals(spark, folder))


@query(f"WITH {_FEAT}, c AS (SELECT CAST(chars AS DOUBLE) AS x, CAST(apiCalls AS DOUBLE) AS y FROM fx WHERE apiCalls IS NOT NULL) SELECT count(*) AS n, CASE WHEN count(*) >= 4 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN {_ROUND.format('covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y))', '1000000.0')} END AS r FROM c")
def chars_calls_correlation(spark, folder):
    return sg.pearson(signals(spark, folder), "chars", "apiCalls")


@query(f"WITH {_FEAT}, o AS (SELECT chars, row_number() OVER (ORDER BY chars) - 1 AS k, count(*) OVER () AS n FROM fx) SELECT n, chars AS p90 FROM o WHERE k = floor(n * 0.9)")
def prompt_chars_ninetieth(spark, folder):
    return sg.ninetieth(signals(spark, folder), "chars")


@query("SELECT CAST(count(*) AS BIGINT) AS n, max(CASE WHEN k = floor(n * 0.9) THEN q END) AS p90 FROM (SELECT l_extendedprice AS q, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem)")
def price_ninetieth(spark, folder):
    return sg.ninetieth(table(spark, folder, "lineitem"), "l_extendedprice")


@query(f"""WITH {_SIG}, g AS (SELECT count(*) AS n, coalesce(sum(vague), 0) AS vague, count(*) FILTER (chars > 200 AND NOT has_path AND NOT has_code) AS una, count(*) FILTER (is_correction) AS cor, count(*) FILTER (aborted) AS ab, count(*) FILTER (gap_ms < 15000) AS fast, count(gap_ms) AS gaps, count(*) FILTER (hour(make_timestamp(us)) < 5) AS night FROM sig),
r AS (SELECT 'vague-filler' AS rule, vague AS hits, n AS "of", floor(vague / n * 100 + 0.5) / 10 > 1.5 AS t FROM g UNION ALL SELECT 'unanchored-epics', una, n, n >= 5 AND una / n > 0.3 FROM g UNION ALL SELECT 'correction-heavy', cor, n, cor / n > 0.15 FROM g
 UNION ALL SELECT 'interrupt-heavy', ab, n, ab / n > 0.15 FROM g UNION ALL SELECT 'rapid-fire', fast, gaps, gaps >= 5 AND fast / gaps > 0.2 FROM g UNION ALL SELECT 'night-owl', night, n, n >= 10 AND night / n > 0.2 FROM g)
SELECT rule, CAST(hits AS BIGINT) AS hits, "of" FROM r WHERE t UNION ALL SELECT 'all-clear', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM r WHERE t)""")
def prompt_lints(spark, folder):
    return sg.lints(signals(spark, folder))


@query(f"""WITH {_SIG}, g AS (SELECT count(*) AS n, sum(vague) AS vague, count(*) FILTER (chars > 200 AND NOT has_path AND NOT has_code) AS una, count(*) FILTER (is_correction) AS cor, count(*) FILTER (aborted) AS ab FROM sig),
r AS (SELECT 'vague-filler' AS rule FROM g WHERE floor(vague / n * 100 + 0.5) / 10 > 1.5 UNION ALL SELECT 'unanchored-epics' FROM g WHERE n >= 5 AND una / n > 0.3 UNION ALL SELECT 'correction-heavy' FROM g WHERE cor / n > 0.15 UNION ALL SELECT 'interrupt-heavy' FROM g WHERE ab / n > 0.15),
e AS (SELECT session_id, step_idx, id, promptPreview AS example, unnest(list_filter([CASE WHEN vague > 0 THEN 'vague-filler' END, CASE WHEN chars > 200 AND NOT has_path AND NOT has_code THEN 'unanchored-epics' END, CASE WHEN corrected_by_next THEN 'correction-heavy' END, CASE WHEN aborted THEN 'interrupt-heavy' END], lambda x: x IS NOT NULL)) AS rule FROM sig),
k AS (SELECT rule, row_number() OVER (PARTITION BY rule ORDER BY session_id NULLS FIRST, step_idx, id) - 1 AS place, example FROM e JOIN r USING (rule)) SELECT * FROM k WHERE place < 3""")
def prompt_lint_examples(spark, folder):
    return sg.lint_examples(signals(spark, folder))


@query(f"""WITH {_SIG}, g AS (SELECT count(*) AS steps, count(DISTINCT session_id) AS sessions, CAST(floor(sum(chars) / count(*) + 0.5) AS BIGINT) AS avg_prompt_chars, (count(*) FILTER (is_correction) + count(*) FILTER (aborted)) / count(*) AS steer, count(*) FILTER (kind = 'command') / count(*) AS cmd, count(*) / count(DISTINCT session_id) AS sps FROM sig)
SELECT CASE WHEN steps = 0 THEN 'unknown' WHEN steer > 0.25 THEN 'micromanager' WHEN avg_prompt_chars > 700 AND sps < 4 THEN 'cannonballer' WHEN cmd > 0.25 THEN 'delegator' WHEN sps >= 8 AND avg_prompt_chars < 300 THEN 'gardener' ELSE 'balanced' END AS archetype, steps, sessions, avg_prompt_chars FROM g""")
def archetype(spark, folder):
    n = F.count("*")
    agents = sg.subagents_per_session(table(spark, folder, "claude_records"), table(spark, folder, "steps"))
    t = signals(spark, folder).agg(
        n.alias("steps"), F.count_distinct("session_id").alias("sessions"), F.floor(F.sum("chars") / n + 0.5).cast("bigint").alias("avg_prompt_chars"), ((F.count_if("is_correction") + F.count_if(F.coalesce("aborted", F.lit(False)))) / n).alias("steer_rate"),
        (F.count_if(F.col("kind") == "command") / n).alias("command_rate"), (n / F.count_distinct("session_id")).alias("steps_per_session"),
    )
    return sg.archetype(t.crossJoin(agents))


_TC = f"tc AS (SELECT *, {_T} AS us FROM (SELECT DISTINCT ON (id) * FROM tool_calls WHERE id IS NOT NULL ORDER BY id, call_pos DESC))"


_CORR = f"SELECT count(*) AS n, CASE WHEN count(*) >= 4 AND var_pop(x) > 0 AND var_pop(y) > 0 THEN {_ROUND.format('covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y))', '1000000.0')} END AS r FROM c"


@query(f"WITH {_FEAT}, c AS (SELECT avg(specificity) AS x, count(*) FILTER (is_correction) / count(*) AS y FROM fx GROUP BY session_id HAVING count(*) >= 2) {_CORR}")
def specificity_corrections_correlation(spark, folder):
    return sg.pearson(sg.correction_rates(signals(spark, folder)), "specificity", "correction_rate")


@query(f"WITH {_FEAT}, {_TC}, k AS (SELECT step_id, count(*) AS k FROM tc GROUP BY 1), c AS (SELECT CAST(chars AS DOUBLE) AS x, CAST(coalesce(k, 0) AS DOUBLE) AS y FROM fx LEFT JOIN k ON k.step_id = fx.id) {_CORR}")
def chars_tool_calls_correlation(spark, folder):
    per = calls(spark, folder).groupBy("step_id").agg(F.count("*").alias("tool_calls"))
    met = signals(spark, folder).select("id", "chars").join(per, F.col("id") == F.col("step_id"), "left")
    return sg.pearson(met.fillna(0, ["tool_calls"]), "chars", "tool_calls")


@query(f"WITH {_TC} SELECT name, count(*) AS calls, count(*) FILTER (isError) AS errors, bool_or(coalesce(isMcp, false)) AS is_mcp FROM tc GROUP BY 1")
def tool_stats(spark, folder):
    return ro.tool_stats(calls(spark, folder))


@query(f'WITH {_TC} SELECT mcpServer AS "mcpServer", count(*) AS calls FROM tc WHERE mcpServer IS NOT NULL GROUP BY 1')
def server_stats(spark, folder):
    return ro.server_stats(calls(spark, folder))


@query(f"""WITH {_ONCE}, {_TC}, s AS (SELECT session_id, count(*) AS steps, CAST(coalesce(sum(apiCalls), 0) AS BIGINT) AS api_calls, CAST(floor((max(us) - min(us)) / 1000) AS BIGINT) AS duration_ms FROM st GROUP BY 1),
c AS (SELECT session_id, count(*) AS tool_calls, count(*) FILTER (isMcp) AS mcp_calls, count(*) FILTER (isError) AS tool_errors FROM tc GROUP BY 1)
SELECT s.session_id, steps, api_calls, coalesce(tool_calls, 0) AS tool_calls, coalesce(mcp_calls, 0) AS mcp_calls, coalesce(tool_errors, 0) AS tool_errors, duration_ms FROM s LEFT JOIN c ON s.session_id = c.session_id""")
def session_rollup(spark, folder):
    return ro.session_rollup(steps(spark, folder), calls(spark, folder))


_CMD = """coalesce(CASE WHEN json_valid(input) AND json_type(input) = 'OBJECT' THEN CASE WHEN json_type(input, '$.command') = 'VARCHAR' THEN input ->> '$.command' WHEN json_type(input, '$.command') = 'ARRAY' THEN array_to_string(CAST(input -> '$.command' AS VARCHAR[]), ' ') END END,
 regexp_replace(nullif(regexp_extract(input, '["'']?cmd["'']?\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)"', 1), ''), '\\\\(.)', '\\1', 'g'))"""
_STRIP = "regexp_replace({0}, '^\\s*(?:[A-Za-z_][A-Za-z0-9_]*=\\S*\\s+)+|^\\s+', '')"


def _unwrap(x: str) -> str:
    inner = _STRIP.format(f"regexp_replace(regexp_replace({x}, '^\\S+\\s+-l?c\\s*', ''), '^[''\"]', '')")
    return f"CASE WHEN regexp_matches({x}, '^(?:\\S*/)?(?:bash|sh|zsh)\\s+-l?c(?:\\s|$)') THEN {inner} ELSE {x} END"


_LABEL = f"""cm AS (SELECT *, {_CMD} AS cmd FROM tc), v0 AS (SELECT *, {_STRIP.format('cmd')} AS a0 FROM cm), v1 AS (SELECT *, {_unwrap('a0')} AS a1 FROM v0), v2 AS (SELECT *, {_unwrap('a1')} AS a2 FROM v1), v3 AS (SELECT *, {_unwrap('a2')} AS a3 FROM v2),
vb AS (SELECT *, nullif(regexp_extract(regexp_extract(a3, '^(\\S+)', 1), '([^/]*)$', 1), '') AS verb FROM v3),
lab AS (SELECT *, coalesce(CASE WHEN contains(input, '*** Begin Patch') THEN name || ':apply_patch' WHEN verb IS NOT NULL THEN name || ':' || verb ELSE name END, '(unknown)') AS label FROM vb)"""


@query(f"WITH {_TC}, {_LABEL} SELECT id, cmd AS command, verb, label FROM lab")
def tool_labels(spark, folder):
    return tx.with_labels(calls(spark, folder)).select("id", "command", "verb", "label")


@query(f"""WITH {_TC}, {_LABEL}, n AS (SELECT session_id, label AS l0, lead(label, 1) OVER w AS l1, lead(label, 2) OVER w AS l2, lead(label, 3) OVER w AS l3 FROM lab WHERE step_id IS NOT NULL WINDOW w AS (PARTITION BY step_id ORDER BY call_pos, id)),
g AS (SELECT session_id, [l0, l1] AS sequence FROM n WHERE l1 IS NOT NULL UNION ALL SELECT session_id, [l0, l1, l2] FROM n WHERE l2 IS NOT NULL UNION ALL SELECT session_id, [l0, l1, l2, l3] FROM n WHERE l3 IS NOT NULL)
SELECT array_to_string(sequence, ' > ') AS sequence, count(*) AS count, count(DISTINCT session_id) AS sessions, len(sequence) AS n FROM g GROUP BY sequence HAVING count(*) >= 3 AND count(DISTINCT session_id) >= 2 AND len(list_filter(sequence, lambda x: x NOT IN ('exec', 'wait', 'shell', 'local_shell', 'Bash'))) > 0""")
def tool_sequences(spark, folder):
    return ro.tool_sequences(calls(spark, folder)).withColumn("sequence", F.array_join("sequence", " > "))


@query(f"""WITH {_TC}, {_LABEL}, n AS (SELECT session_id, label AS l0, lead(label, 1) OVER w AS l1, lead(label, 2) OVER w AS l2, lead(label, 3) OVER w AS l3 FROM lab WHERE step_id IS NOT NULL WINDOW w AS (PARTITION BY step_id ORDER BY call_pos, id)),
g AS (SELECT session_id, [l0, l1] AS sequence FROM n WHERE l1 IS NOT NULL UNION ALL SELECT session_id, [l0, l1, l2] FROM n WHERE l2 IS NOT NULL UNION ALL SELECT session_id, [l0, l1, l2, l3] FROM n WHERE l3 IS NOT NULL)
SELECT array_to_string(sequence, ' > ') AS sequence, count(*) * len(sequence) AS weight FROM g GROUP BY sequence HAVING count(*) >= 3 AND count(DISTINCT session_id) >= 2 AND len(list_filter(sequence, lambda x: x NOT IN ('exec', 'wait', 'shell', 'local_shell', 'Bash'))) > 0 ORDER BY 2 DESC, 1 LIMIT 12""")
def top_tool_sequences(spark, folder):
    """The twelve weightiest n-grams: count times length, then by name."""
    g = ro.tool_sequences(calls(spark, folder)).select(F.array_join("sequence", " > ").alias("sequence"), (F.col("count") * F.col("n")).alias("weight"))
    return g.orderBy(F.desc("weight"), "sequence").limit(12)


@query(f"""WITH {_TC}, {_LABEL} SELECT session_id, {', '.join(f"count(*) FILTER (regexp_matches(cmd, '{p}')) AS {n}" for p, n in (('\\bgit\\b[^|;&]*\\bcommit\\b', 'git_commits'), ('\\bgit\\b[^|;&]*\\bpush\\b', 'git_pushes'), ('\\bgit\\s+(checkout\\s+-b|switch\\s+-c|worktree\\s+add)\\b', 'git_branch_ops'), ('\\bgh\\s+issue\\s+(create|edit|comment)\\b', 'issue_ops'), ('\\bgh\\s+pr\\s+(create|merge|edit)\\b', 'pr_ops')))},
 CAST(sum(CASE WHEN name IN ('Edit', 'Write', 'NotebookEdit') THEN 1 ELSE 0 END + CASE WHEN contains(input, '*** Begin Patch') THEN 1 ELSE 0 END) AS BIGINT) AS file_edits FROM lab GROUP BY 1""")
def workflow_counts(spark, folder):
    return ro.workflow(calls(spark, folder))


_STOP = "('" + "', '".join(tx.STOP_WORDS) + "')"
_TOK = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(promptText), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN {_STOP}))"


@query(f"WITH {_ONCE} SELECT id, array_to_string(list_sort({_TOK}), ' ') AS tokens, substring(sha256(array_to_string(list_sort({_TOK}), ' ')), 1, 12) AS question_key FROM st WHERE promptText IS NOT NULL")
def question_keys(spark, folder):
    s = steps(spark, folder).filter("promptText is not null")
    return s.select("id", F.array_join(F.array_sort(tx.token_set(F.col("promptText"))), " ").alias("tokens"), tx.question_key(F.col("promptText")).alias("question_key"))


@query(f"""WITH {_SIG}, t AS (SELECT id, session_id, us, chars, promptText, CASE WHEN is_correction THEN 'correction' WHEN is_question THEN 'question' ELSE 'directive' END AS k, list_sort({_TOK}) AS tok FROM sig WHERE kind = 'prompt' AND chars >= 15)
SELECT k AS kind, len(tok) AS size, count(*) AS n FROM t WHERE len(tok) > 0 GROUP BY ALL""")
def cluster_eligible(spark, folder):
    s = signals(spark, folder).filter("kind = 'prompt' and chars >= 15").select(tx.kind_of(F.col("is_correction"), F.col("is_question")).alias("kind"), F.size(tx.token_set(F.col("promptText"))).cast("bigint").alias("size"))
    return s.filter("size > 0").groupBy("kind", "size").agg(F.count("*").alias("n"))


@query()
def prompt_clusters(spark, folder):
    return cl.clusters(signals(spark, folder))


_INTENT = "CASE " + " ".join(f"WHEN regexp_matches(promptText, '{_esc(p)}') THEN '{n}'" for n, p in tx.INTENTS) + " ELSE 'other' END"
_FIRST = f"""{_ONCE}, fp AS (SELECT *, {_INTENT} AS intent FROM st WHERE kind = 'prompt' AND session_id IS NOT NULL AND regexp_replace(promptText, '^\\s+|\\s+$', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step_idx, id) = 1)"""


@query(f"""WITH {_FIRST}, p AS (SELECT *, regexp_replace(regexp_replace(promptText, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM fp)
SELECT session_id, id AS step_id, CASE WHEN length(x) > 100 THEN substring(x, 1, 99) || '…' ELSE x END AS preview, intent FROM p""")
def session_intents(spark, folder):
    return ro.first_prompts(steps(spark, folder))


@query(f"WITH {_FIRST} SELECT intent, count(*) AS sessions FROM fp GROUP BY 1")
def intent_histogram(spark, folder):
    return ro.first_prompts(steps(spark, folder)).groupBy("intent").agg(F.count("*").alias("sessions"))


_CWD = f"{LINES_A}, cw AS (SELECT coalesce(sessionId, session_id) AS session_id, arg_min(cwd, line_no) FILTER (cwd IS NOT NULL) AS cwd FROM la WHERE coalesce(sessionId, session_id) IS NOT NULL GROUP BY 1)"


def folders(spark, folder):
    """The first folder of each session."""
    c = table(spark, folder, "claude_records").select(rec.session_of().alias("session_id"), "cwd", "line_no").filter("session_id is not null")
    return c.groupBy("session_id").agg(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct("line_no", "cwd"))).alias("cwd"))


@query(f"""WITH {_CWD}, {_FIRST}, g AS (SELECT cwd, intent, count(*) AS n FROM fp JOIN cw USING (session_id) WHERE cwd IS NOT NULL GROUP BY ALL)
SELECT cwd, intent, n, CAST(total AS BIGINT) AS total, {_ROUND.format('n / total', '1000000.0')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY cwd) AS total, row_number() OVER (PARTITION BY cwd ORDER BY n DESC, intent) AS k FROM g) WHERE k = 1 AND total >= 2""")
def project_intents(spark, folder):
    rows = ro.first_prompts(steps(spark, folder)).join(folders(spark, folder), "session_id").filter("cwd is not null")
    return ro.dominant(rows, ["cwd"], "intent").filter("total >= 2")


_EVW = "ev AS (SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week FROM events)"


def event_weeks(spark, folder):
    e = table(spark, folder, "events")
    return e.withColumn("week", week_key(F.unix_micros(F.col("ts").cast("timestamp"))))


@query(f"""WITH {_EVW}, g AS (SELECT week, event_type, count(*) AS n FROM ev GROUP BY ALL)
SELECT week, event_type, n, CAST(total AS BIGINT) AS total, {_ROUND.format('n / total', '1000000.0')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY week) AS total, row_number() OVER (PARTITION BY week ORDER BY n DESC, event_type) AS k FROM g) WHERE k = 1""")
def weekly_dominant(spark, folder):
    return ro.dominant(event_weeks(spark, folder), ["week"], "event_type")


_MODELS = f"""{LINES_A}, c AS (SELECT file_path, regexp_replace(message.model, '-20\\d{{6}}', '') AS model, {_T} AS us, coalesce(message.usage.output_tokens, 0) AS o, row_number() OVER (PARTITION BY file_path, coalesce(message.id, requestId, uuid, 'row-' || line_no) ORDER BY line_no) AS k FROM la WHERE type = 'assistant' AND message IS NOT NULL),
mc AS (SELECT *, strftime(date_trunc('week', make_timestamp(us)), '%Y-%m-%d') AS week, strftime(make_timestamp(us), '%Y-%m-%d') AS day FROM c WHERE k = 1 AND model IS NOT NULL AND NOT starts_with(model, '<'))"""


def model_calls(spark, folder):
    """Each API response once with its display model, week and day; synthetic models are left out."""
    from ..operators import format_a as fa

    rows = fa.lines(table(spark, folder, "claude_records")).filter("type = 'assistant' and message is not null")
    key = F.coalesce("message.id", "requestId", "uuid", F.concat(F.lit("row-"), F.col("line_no").cast("string")))
    first = rows.groupBy("file_path", key.alias("k")).agg(F.min(F.struct("line_no", F.col("message.model").alias("m"), "timestamp", F.coalesce("message.usage.output_tokens", F.lit(0)).alias("o"))).alias("f"))
    m = first.select("file_path", tx.display_model(F.col("f.m")).alias("model"), micros(F.col("f.timestamp")).alias("us"), F.col("f.o").alias("output")).filter("model is not null and not startswith(model, '<')")
    return m.withColumns({"week": week_key(F.col("us")), "day": F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")})


@query(f"WITH {_MODELS}, g AS (SELECT model, count(DISTINCT file_path) AS sessions, count(*) AS calls, CAST(sum(o) AS BIGINT) AS output FROM mc GROUP BY 1) SELECT *, {_ROUND.format('calls / sum(calls) OVER ()', '1000000.0')} AS share FROM g")
def model_report(spark, folder):
    g = model_calls(spark, folder).groupBy("model").agg(F.count_distinct("file_path").alias("sessions"), F.count("*").alias("calls"), F.sum("output").alias("output"))
    total = g.agg(F.sum("calls").alias("all"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", tx.half_up(F.col("calls") / F.col("all"), 6)).drop("all")


_WEEKDOM = f"{_MODELS}, g AS (SELECT week, model, count(*) AS n FROM mc WHERE week IS NOT NULL GROUP BY ALL), wd AS (SELECT week, model FROM g QUALIFY row_number() OVER (PARTITION BY week ORDER BY n DESC, model) = 1)"


@query(f"WITH {_WEEKDOM}, s AS (SELECT week, lag(model) OVER (ORDER BY week) AS from_value, model AS to_value FROM wd) SELECT * FROM s WHERE from_value IS NOT NULL AND from_value <> to_value")
def model_switches(spark, folder):
    weekly = ro.dominant(model_calls(spark, folder).filter("week is not null"), ["week"], "model")
    return ro.switches(weekly, "week", "model")


@query(f"WITH {_MODELS} SELECT model, CAST(sum(o) AS BIGINT) AS output, min(day) AS first_day, max(day) AS last_day, count(DISTINCT day) AS days FROM mc WHERE day IS NOT NULL GROUP BY 1")
def model_history(spark, folder):
    return model_calls(spark, folder).filter("day is not null").groupBy("model").agg(F.sum("output").alias("output"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_distinct("day").alias("days"))


@query("""WITH ch AS (SELECT CAST(event_id AS VARCHAR) AS change_id, ts FROM events WHERE event_type = 'signup' AND value > 300), sm AS (SELECT user_id, min(ts) AS t, count(*) AS prompts, count(*) FILTER (event_type = 'error') AS corrections FROM events GROUP BY 1),
r AS (SELECT change_id, prompts, corrections, 'before' AS side, row_number() OVER (PARTITION BY change_id ORDER BY t DESC, CAST(user_id AS VARCHAR) DESC) AS k FROM ch JOIN sm ON t < ts UNION ALL
 SELECT change_id, prompts, corrections, 'after', row_number() OVER (PARTITION BY change_id ORDER BY t, CAST(user_id AS VARCHAR)) FROM ch JOIN sm ON t >= ts)
SELECT change_id, side, count(*) AS sessions, CAST(sum(prompts) AS BIGINT) AS prompts, CAST(sum(corrections) AS BIGINT) AS corrections FROM r WHERE k <= 10 GROUP BY ALL""")
def before_after(spark, folder):
    e = table(spark, folder, "events")
    changes = e.filter("event_type = 'signup' and value > 300").select(F.col("event_id").alias("change_id"), F.col("ts").alias("t"))
    samples = e.groupBy("user_id").agg(F.min("ts").alias("t"), F.count("*").alias("prompts"), F.count_if(F.col("event_type") == "error").alias("corrections")).withColumnRenamed("user_id", "sample_id")
    return ro.before_after(changes, samples, 10)


@query("""WITH k(key) AS (VALUES ('anodized'), ('anodized-brass'), ('anodized-brass-x'), ('burnished'), ('plated-tin'), ('plated')), p AS (SELECT p_partkey, lower(replace(p_type, ' ', '-')) AS v FROM part)
SELECT p_partkey, v AS name, arg_max(key, length(key)) AS matched FROM p LEFT JOIN k ON v = key OR starts_with(v, key || '-') GROUP BY ALL""")
def longest_prefix(spark, folder):
    keys = spark.createDataFrame([(x,) for x in ("anodized", "anodized-brass", "anodized-brass-x", "burnished", "plated-tin", "plated")], "key string")
    p = table(spark, folder, "part").select("p_partkey", F.lower(F.regexp_replace("p_type", " ", "-")).alias("name"))
    return ro.longest_prefix(p, F.col("name"), keys, "key")


_TWO = f"WITH {_ONCE}, {_TC}, s AS (SELECT session_id, count(*) AS steps, CAST(coalesce(sum(apiCalls), 0) AS BIGINT) AS api_calls FROM st GROUP BY 1), c AS (SELECT session_id, count(*) AS tool_calls, count(*) FILTER (isError) AS tool_errors FROM tc GROUP BY 1), r AS (SELECT s.session_id, steps, api_calls, coalesce(tool_calls, 0) AS tool_calls, coalesce(tool_errors, 0) AS tool_errors FROM s LEFT JOIN c USING (session_id)), e AS (SELECT min(session_id) AS a, max(session_id) AS b FROM s)"


@query(_TWO + f", u AS (SELECT session_id, metric, CAST(v AS DOUBLE) AS v FROM r UNPIVOT (v FOR metric IN (steps, api_calls, tool_calls, tool_errors))), g AS (SELECT metric, max(v) FILTER (session_id = e.a) AS a, max(v) FILTER (session_id = e.b) AS b FROM u, e GROUP BY 1) SELECT metric, a, b, b - a AS delta, CASE WHEN a <> 0 THEN {_ROUND.format('(b - a) / a * 100', '100.0')} END AS delta_pct FROM g")
def compare_sessions(spark, folder):
    """The first and the last session by id, metric by metric."""
    r = ro.session_rollup(steps(spark, folder), calls(spark, folder))
    e = r.agg(F.min("session_id").alias("a"), F.max("session_id").alias("b")).first()
    return ro.compared(r, e.a, e.b, ["steps", "api_calls", "tool_calls", "tool_errors"])


@query(f"""WITH {LINES_A}, c AS (SELECT file_path, regexp_extract(text, '<command-name>\\s*([^<\\n]+?)\\s*</command-name>', 1) AS command FROM la WHERE row_class = 'command'),
inst(name) AS (VALUES ('review'), ('plan'), ('compact'), ('commit')) SELECT command, count(*) AS uses, count(DISTINCT file_path) AS sessions, list_contains((SELECT list(name) FROM inst), ltrim(command, '/')) OR list_contains((SELECT list(name) FROM inst), split_part(ltrim(command, '/'), ':', 1)) AS installed FROM c GROUP BY 1""")
def command_usage(spark, folder):
    from ..operators import format_a as fa

    inst = spark.createDataFrame([(x,) for x in ("review", "plan", "compact", "commit")], "name string")
    c = fa.lines(table(spark, folder, "claude_records")).filter("row_class = 'command'").select("file_path", F.regexp_extract("text", rec.COMMAND_NAME, 1).alias("command"))
    g = c.groupBy("command").agg(F.count("*").alias("uses"), F.count_distinct("file_path").alias("sessions"))
    bare = F.ltrim("command", F.lit("/"))
    keys = g.select("command", F.explode(F.array(bare, F.split_part(bare, F.lit(":"), F.lit(1)))).alias("name")).join(inst, "name", "left_semi").select(F.col("command").alias("_c")).distinct()
    return g.join(keys, g.command == keys["_c"], "left").select("command", "uses", "sessions", F.col("_c").isNotNull().alias("installed"))


@query(f"""WITH {_ONCE}, f AS (SELECT session_id FROM st QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY step_idx, id) = 1 AND starts_with(promptText, 'Run it again')) SELECT id, session_id FROM st WHERE session_id NOT IN (SELECT session_id FROM f)""")
def sentinel_exclusion(spark, folder):
    """Steps of the sessions whose first prompt doesn't start with a sentinel."""
    s = steps(spark, folder).select("id", "session_id", "step_idx", "promptText").filter("session_id is not null")
    first = s.groupBy("session_id").agg(F.min(F.struct("step_idx", "id", "promptText")).alias("f")).filter(F.col("f.promptText").startswith("Run it again")).select("session_id")
    return s.join(first, "session_id", "left_anti").select("id", "session_id")


@query(f"WITH {_ONCE} SELECT promptText AS prompt, min(id) AS first_id, count(*) AS n FROM st WHERE promptText IS NOT NULL GROUP BY 1")
def fork_dedup(spark, folder):
    """Equal prompts once, with the first that holds them."""
    return steps(spark, folder).filter("promptText is not null").groupBy(F.col("promptText").alias("prompt")).agg(F.min("id").alias("first_id"), F.count("*").alias("n"))


_FILES = "fl AS (SELECT file_path, epoch_us(max(ingested_at)) AS updated_us, CAST(sum(coalesce(length(message.content), 0)) AS BIGINT) AS size FROM claude_records GROUP BY 1), fr AS (SELECT *, regexp_extract(file_path, '([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\\.jsonl$', 1) AS session_id, regexp_extract(file_path, 'projects/([^/]+)/', 1) AS project FROM fl)"


def file_refs(spark, folder):
    r = table(spark, folder, "claude_records").groupBy("file_path").agg(F.unix_micros(F.max("ingested_at").cast("timestamp")).alias("updated_us"), F.sum(F.coalesce(F.length("message.content"), F.lit(0))).cast("bigint").alias("size"))
    return r.withColumns({"session_id": F.regexp_extract("file_path", r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})\.jsonl$", 1), "project": F.regexp_extract("file_path", r"projects/([^/]+)/", 1)})


@query(f"WITH {_FILES} SELECT session_id, project, updated_us, size, substring(session_id, 1, 8) AS short_id FROM fr WHERE session_id <> '' AND size <= 31457280")
def session_files(spark, folder):
    return file_refs(spark, folder).filter("session_id != '' and size <= 31457280").select("session_id", "project", "updated_us", "size", tx.short_id(F.col("session_id")).alias("short_id"))


@query(f"WITH {_FILES} SELECT session_id, project, updated_us FROM fr WHERE session_id <> '' QUALIFY row_number() OVER (PARTITION BY project ORDER BY updated_us DESC, session_id) <= 3")
def recent_per_project(spark, folder):
    """The three newest sessions of each project; session refs are small rows, one per file."""
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy(F.desc("updated_us"), "session_id")
    return file_refs(spark, folder).filter("session_id != ''").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("session_id", "project", "updated_us")


@query(f"WITH {_FILES} SELECT project, count(*) AS sessions, max(updated_us) AS last_active FROM fr GROUP BY 1")
def project_groups(spark, folder):
    return file_refs(spark, folder).groupBy("project").agg(F.count("*").alias("sessions"), F.max("updated_us").alias("last_active"))


@query(f"WITH {_FILES} SELECT session_id, updated_us FROM fr ORDER BY updated_us DESC, session_id LIMIT 15")
def newest_sessions(spark, folder):
    return file_refs(spark, folder).select("session_id", "updated_us").orderBy(F.desc("updated_us"), "session_id").limit(15)


@query(f"""WITH {_CWD}, {_ONCE}, {_TC}, s AS (SELECT cwd, count(DISTINCT st.session_id) AS sessions, count(*) AS steps, CAST(sum(apiCalls) AS BIGINT) AS api_calls, min(us) AS first_us, max(us) AS last_us FROM st JOIN cw USING (session_id) WHERE cwd IS NOT NULL GROUP BY 1),
t AS (SELECT cwd, count(*) AS tool_calls, count(DISTINCT mcpServer) AS servers FROM tc JOIN cw USING (session_id) WHERE cwd IS NOT NULL GROUP BY 1) SELECT s.*, coalesce(tool_calls, 0) AS tool_calls, coalesce(servers, 0) AS servers FROM s LEFT JOIN t USING (cwd)""")
def project_dossier(spark, folder):
    cw = folders(spark, folder).filter("cwd is not null")
    s = steps(spark, folder).join(cw, "session_id").groupBy("cwd").agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("steps"), F.sum("apiCalls").alias("api_calls"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    t = calls(spark, folder).join(cw, "session_id").groupBy("cwd").agg(F.count("*").alias("tool_calls"), F.count_distinct("mcpServer").alias("servers"))
    return s.join(t, "cwd", "left").na.fill(0, ["tool_calls", "servers"])


_TRACE = f"tr AS (SELECT DISTINCT event_id, session_id, head, dirty_files, {TIME.format(c='ts')} AS t FROM git_trace WHERE event = 'UserPromptSubmit' AND head <> '')"


@query(f"""WITH {_ONCE}, {_TRACE} SELECT id, head AS git_head, dirty_files FROM st JOIN tr USING (session_id) WHERE abs(us - t) <= 20000000 QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(us - t), event_id) = 1""")
def steps_with_git(spark, folder):
    """Each step's git state: the nearest event of its session within 20 s, met by time slices."""
    width = 20_000_000
    ev = table(spark, folder, "git_trace").filter("event = 'UserPromptSubmit' and head != ''").select("session_id", "event_id", "head", "dirty_files", micros(F.col("ts")).alias("t")).distinct()
    ev = ev.filter("t is not null").withColumn("slice", F.explode(F.array(*[F.floor(F.col("t") / width) + k for k in (-1, 0, 1)])))
    s = steps(spark, folder).filter("us is not null").select("id", "session_id", "us", F.floor(F.col("us") / width).alias("slice"))
    d = F.abs(F.col("us") - F.col("t"))
    met = s.join(ev, ["session_id", "slice"]).filter(d <= width)
    best = met.groupBy("id").agg(F.min(F.struct(d.alias("d"), "event_id", "head", "dirty_files")).alias("b"))
    return best.select("id", F.col("b.head").alias("git_head"), F.col("b.dirty_files").alias("dirty_files"))


@query("SELECT n_regionkey AS k, 'both' AS side FROM (SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region) UNION ALL SELECT k, 'nations only' FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region) UNION ALL SELECT k, 'union' FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region)")
def set_operations(spark, folder):
    n, r = table(spark, folder, "nation"), table(spark, folder, "region").select(F.col("r_regionkey").alias("k"))
    a = n.select(F.col("n_regionkey").alias("k")).intersect(r).withColumn("side", F.lit("both"))
    b = n.select(F.col("n_nationkey").alias("k")).subtract(r).withColumn("side", F.lit("nations only"))
    c = n.select(F.col("n_nationkey").alias("k")).union(r).distinct().withColumn("side", F.lit("union"))
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {_ONCE}, d AS (SELECT id, durationMs AS ms, CAST(floor(durationMs / 1000 + 0.5) AS BIGINT) AS s, regexp_replace(regexp_replace(promptText, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM st)
SELECT id, CASE WHEN ms IS NULL THEN '—' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || ((s % 3600) // 60) || 'm' END AS duration, CASE WHEN length(x) > 64 THEN substring(x, 1, 63) || '…' ELSE x END AS preview FROM d""")
def formatted_steps(spark, folder):
    return steps(spark, folder).select("id", tx.duration(F.col("durationMs")).alias("duration"), tx.preview(F.col("promptText")).alias("preview"))


@query(f"""WITH {_SIG}, {_CWD} SELECT sig.id, intent_preview FROM (SELECT id, CASE WHEN is_correction THEN 0 ELSE 1 END AS o, chars, substring(promptText, 1, 40) AS intent_preview FROM sig) sig ORDER BY o, chars DESC, id LIMIT 20""".replace(f", {_CWD}", ""))
def judge_sample(spark, folder):
    """Twenty prompts to be judged: corrections first, then the longest."""
    s = signals(spark, folder).select("id", (~F.col("is_correction")).cast("int").alias("o"), "chars", F.substring("promptText", 1, 40).alias("intent_preview"))
    return s.orderBy("o", F.desc("chars"), "id").limit(20).select("id", "intent_preview")
