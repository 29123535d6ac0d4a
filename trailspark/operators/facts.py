"""One row of facts per session file of either format, and the reports that are made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros, week_key
from . import format_a as a
from . import format_b as b
from . import records as rec

#: Numbers that are summed over sessions.
USAGE = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "total_tokens"]
VOLUME = ["human_chars", "harness_chars", "tool_chars"]
TOTALS = ["steps", "api_calls", "tool_calls", "tool_errors", "mcp_calls", "subagents", "interruptions", "commands", "pr_links", "compactions"]
COLUMNS = [
    "agent", "file_path", "session_id", "title", "cwd", "git_branch", "started_raw", "ended_raw", *TOTALS, "compactions_auto", "compactions_manual", "max_pre_tokens", *USAGE, *VOLUME, "is_subagent", "first_prompt",
]


def _count(cond: Column, name: str) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False))).alias(name)


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.join(y, "file_path", "left"), parts)


def _filled(df: DataFrame, agent: str) -> DataFrame:
    zero = {*TOTALS, "compactions_auto", "compactions_manual", *USAGE, *VOLUME}
    kinds = {"max_pre_tokens": "bigint", "is_subagent": "boolean"}
    out = df.withColumn("agent", F.lit(agent))
    return out.select(*[
        F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) if c in zero and c in out.columns else F.lit(0).cast("bigint").alias(c) if c in zero
        else F.col(c) if c in out.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c)
        for c in COLUMNS
    ])


def of_files_a(lines: DataFrame) -> DataFrame:
    """Facts of format A files. The session's id is the last one named up to the line that opens the first step, else the file's name."""
    opens = F.col("row_class").isin("prompt", "command")
    said = (F.col("type") == "assistant") & F.col("message").isNotNull()
    at = lambda cond: F.min(F.when(cond, F.col("line_no")))
    sid = F.nullif(rec.session_of(), F.lit(""))
    head = lines.groupBy("file_path").agg(
        at(opens).alias("_open"), at(said).alias("_said"), _count(opens, "_prompts"), _count(F.col("row_class") == "command", "commands"), _count(F.col("row_class") == "interruption", "interruptions"),
        _count(F.col("type") == "pr-link", "pr_links"), _count(F.col("isCompactSummary"), "compactions"),
        _count(F.col("isCompactSummary") & (F.col("compactMetadata.trigger") == "auto"), "compactions_auto"), _count(F.col("isCompactSummary") & (F.col("compactMetadata.trigger") == "manual"), "compactions_manual"),
        F.max(F.when(F.col("isCompactSummary"), F.col("compactMetadata.preTokens"))).alias("max_pre_tokens"), _count((F.col("type") == "user") & F.col("toolUseResult.agentId").isNotNull(), "subagents"),
        F.min(F.when(opens, F.struct("line_no", "text"))).alias("_first"),
    )
    first = F.least("_open", "_said")
    ids = lines.filter(sid.isNotNull()).select("file_path", "line_no", sid.alias("sid")).join(head.select("file_path", first.alias("_at")), "file_path").filter(F.col("line_no") <= F.coalesce("_at", F.col("line_no"))).groupBy("file_path").agg(F.max_by("sid", "line_no").alias("_sid"))
    calls = a.api_calls(lines.withColumn("step_idx", F.lit(0)))
    use = calls.groupBy("file_path").agg(
        F.count("*").alias("api_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cache_read_input_tokens").alias("cache_read_tokens"), F.sum("cache_creation_input_tokens").alias("cache_write_tokens"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens"))
    rows = lines.withColumn("step_idx", F.lit(None).cast("bigint"))
    made = a.linked(a.tool_calls(rows).select("file_path", "line_no", "pos", "call_id", "is_mcp"), a.tool_results(rows))
    tools = made.groupBy("file_path").agg(F.count("*").alias("tool_calls"), _count(F.col("is_mcp"), "mcp_calls"), _count(F.col("is_error"), "tool_errors"))
    met = _joined([head, ids, use, tools, a.attributes(lines), a.volume(lines)])
    name = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"\.jsonl$", "")
    return _filled(met.withColumns({
        "steps": F.col("_prompts") + F.when(F.col("_said") < F.coalesce("_open", F.col("_said") + 1), 1).otherwise(0),
        "session_id": F.coalesce("_sid", name), "first_prompt": F.col("_first.text"), "is_subagent": F.lit(False),
    }), "a")


def of_files_b(lines: DataFrame) -> DataFrame:
    """Facts of format B files; the session's id is that of its meta line, else the file's path."""
    event = F.col("type") == "event_msg"
    started = event & (F.col("pt") == "task_started")
    at = lambda cond: F.min(F.when(cond, F.col("line_no")))
    name = F.coalesce(b.text_of("$.name"), F.lit("(unknown)"))
    stamp = F.nullif("timestamp", F.lit(""))
    head = lines.groupBy("file_path").agg(
        _count(started, "_started"), at(started).alias("_open"), at(b.is_call()).alias("_called"), _count(event & (F.col("pt") == "token_count"), "_counts"),
        _count(b.is_call(), "tool_calls"), _count(b.is_call() & tx.server_b(name).isNotNull(), "mcp_calls"), _count(F.col("type") == "compacted", "compactions"),
        F.min_by(stamp, F.when(stamp.isNotNull(), F.col("line_no"))).alias("started_raw"), F.max_by(stamp, F.when(stamp.isNotNull(), F.col("line_no"))).alias("ended_raw"),
    )
    use = b.session_usage(lines.withColumn("turn_idx", F.lit(0))).select("file_path", F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("cache_read").alias("cache_read_tokens"), F.col("total").alias("total_tokens"))
    turns = b.turns(b.in_turns(lines))
    per = turns.groupBy("file_path").agg(F.count("*").alias("steps"), _count(F.col("aborted"), "interruptions"), _count(F.col("kind") == "command", "commands"), F.min_by("prompt_text", "turn_idx").alias("first_prompt"))
    inside = b.in_turns(lines.select("file_path", "line_no", "type", "payload", "p", "pt")).filter(event & (F.col("pt") == "token_count") & F.col("turn_idx").isNotNull()).groupBy("file_path").agg(F.count("*").alias("api_calls"))
    met = _joined([head, use, per, inside, b.session_meta(lines), b.volume(lines)])
    return _filled(met.withColumn("session_id", F.coalesce("session_id", "file_path")).withColumn("is_subagent", F.coalesce("is_subagent", F.lit(False))), "b")


def facts(records: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts of all session files of both formats (raw tables in, see ``COLUMNS``)."""
    return of_files_a(a.lines(records)).unionByName(of_files_b(b.lines(lines)))


def by_session(f: DataFrame) -> DataFrame:
    """Facts summed over the files of a session (a resumed session has several); the first file by path gives what can't be summed."""
    sums = [F.sum(c).alias(c) for c in [*TOTALS, "compactions_auto", "compactions_manual", *USAGE, *VOLUME]]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("file_path"))).alias(c)
    return f.groupBy("agent", "session_id").agg(*sums, F.max("max_pre_tokens").alias("max_pre_tokens"), F.min("started_raw").alias("started_raw"), F.max("ended_raw").alias("ended_raw"), *[first(c) for c in ("title", "cwd", "git_branch", "first_prompt")], F.max("is_subagent").alias("is_subagent"))


def duration_ms(first: str = "started_raw", last: str = "ended_raw") -> Column:
    """Milliseconds between two raw times; null when either is unreadable or they run backwards."""
    d = F.floor((micros(F.col(last)) - micros(F.col(first))) / 1000)
    return F.when(d >= 0, d)


# -- scopes ---------------------------------------------------------------


def without_internal(f: DataFrame, sentinel: str) -> DataFrame:
    """Leaves out sessions whose first prompt begins with the engine's own sentinel."""
    return f.filter(~F.coalesce(F.col("first_prompt").startswith(sentinel), F.lit(False)))


def without_subagents(f: DataFrame) -> DataFrame:
    return f.filter(~F.coalesce("is_subagent", F.lit(False)))


def in_repo(f: DataFrame, root: str) -> DataFrame:
    """Sessions that ran in a folder or below it."""
    root = root.rstrip("/")
    return f.filter((F.col("cwd") == root) | F.col("cwd").startswith(root + "/"))


def with_orphaned(f: DataFrame, live: DataFrame) -> DataFrame:
    """Adds ``orphaned``: the folder is unknown, or none of the ``live`` ones (column ``cwd``)."""
    known = live.select(F.col("cwd").alias("_live")).filter("_live is not null").distinct()
    return f.join(known, F.col("cwd") == F.col("_live"), "left").withColumn("orphaned", F.col("_live").isNull()).drop("_live")


def newest_per_agent(f: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest sessions of each agent: rank-limited per agent, so no agent crowds out another."""
    out = None
    for agent in ("a", "b"):
        top = f.filter(F.col("agent") == agent).orderBy(F.desc_nulls_last("started_raw"), "session_id").limit(k)
        out = top if out is None else out.unionByName(top)
    return out


def project_groups(f: DataFrame) -> DataFrame:
    """A row per folder: sessions, last activity; ``place`` lists live folders first, newest first, orphans last."""
    g = f.groupBy(F.coalesce("cwd", F.lit("")).alias("cwd"), "orphaned").agg(F.count("*").alias("sessions"), F.max("ended_raw").alias("last_active"))
    # A row per folder.
    w = Window.orderBy("orphaned", F.desc_nulls_last("last_active"), "cwd")
    return g.withColumn("place", F.row_number().over(w))


# -- reports --------------------------------------------------------------


def session_metrics(f: DataFrame, stats: DataFrame) -> DataFrame:
    """Facts by session next to the signals of its prompts; rates are null where they have nothing to divide by.

    ``stats``: session_id, prompts, corrections, prompt_chars,
    specificity_sum, vague, median_gap_ms. A session of either side has a row.
    """
    # Without facts a session has no agent.
    met = f.select("agent", "session_id", "interruptions", "commands", "output_tokens", "tool_calls").join(stats, "session_id", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return met.select(
        "agent", "session_id", z("prompts"), z("corrections"), z("interruptions"), z("commands"), z("prompt_chars"), z("output_tokens"), z("tool_calls"), z("vague"), "specificity_sum", "median_gap_ms",
        F.when(F.col("prompt_chars") > 0, tx.half_up(F.coalesce("output_tokens", F.lit(0)) / (F.col("prompt_chars") / 1000)).cast("bigint")).alias("output_per_kchar"),
        tx.half_up(F.col("specificity_sum") / F.col("prompts"), 4).alias("avg_specificity"),
    )


def aggregate(metrics: DataFrame) -> DataFrame:
    """The fourteen metrics over all sessions (``agent`` null, ``overall`` 1) and per agent, in one pass."""
    s = lambda c: F.sum(c).alias(c)
    g = metrics.filter("agent is not null or prompts > 0").rollup("agent").agg(
        F.grouping("agent").cast("int").alias("overall"), F.count("*").alias("sessions"), F.sum("prompts").alias("steps"), s("corrections"), s("interruptions"), s("commands"), s("prompt_chars"), F.sum("specificity_sum").alias("_spec"), F.sum("vague").alias("_vague"), F.sum("output_tokens").alias("_out"), F.sum("tool_calls").alias("_calls"),
    )
    per = lambda n, d=6: F.when(F.col("steps") > 0, tx.half_up(n / F.col("steps"), d)).otherwise(0.0)
    return g.filter("overall = 1 or agent is not null").select(
        "agent", "overall", "sessions", "steps", "corrections", "interruptions", "commands", "prompt_chars",
        F.when(F.col("steps") > 0, tx.half_up(F.col("prompt_chars") / F.col("steps"))).otherwise(0).cast("bigint").alias("avg_prompt_chars"),
        F.when(F.col("steps") > 0, tx.half_up(F.col("_spec") / F.col("steps"), 4)).alias("avg_specificity"),
        F.when(F.col("steps") > 0, tx.half_up(F.col("_vague") / F.col("steps") * 100).cast("double") / 10).otherwise(0.0).alias("vague_per_ten"),
        per(F.col("corrections")).alias("correction_rate"), per(F.col("interruptions")).alias("interruption_rate"),
        F.when(F.col("prompt_chars") > 0, tx.half_up(F.col("_out") / (F.col("prompt_chars") / 1000)).cast("bigint")).alias("output_per_kchar"),
        per(F.col("_calls")).alias("tool_calls_per_step"), F.when(F.col("sessions") > 0, tx.half_up(F.col("steps") / F.col("sessions"), 6)).otherwise(0.0).alias("steps_per_session"),
    )


#: The rows of a comparison.
COMPARED = ["steps", "api_calls", "tool_calls", "tool_errors", "mcp_calls", "subagents", "compactions", "interruptions", "duration_s", *USAGE]


def compared(f: DataFrame, pick: DataFrame, metrics: list[str] = COMPARED) -> DataFrame:
    """``metric, a, b, delta, delta_pct`` of two sessions.

    ``pick``: side (``a`` or ``b``) and session_id. The share is 0 when both
    sides are 0, and null when only the first is.
    """
    rows = f.withColumn("duration_s", F.floor(F.coalesce(duration_ms(), F.lit(0)) / 1000 + 0.5)).join(pick, "session_id")
    long = rows.select("side", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m), F.lit(0)).cast("bigint").alias("v")) for m in metrics])).alias("x"))
    v = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("x.v"))), F.lit(0)).alias(side)
    g = long.groupBy("x.metric").agg(v("a"), v("b"))
    delta = F.col("b") - F.col("a")
    return g.withColumn("delta", delta).withColumn("delta_pct", F.when(F.col("a") != 0, tx.half_up(delta / F.col("a") * 100, 2)).when(F.col("b") == 0, 0.0))


def workflow(f: DataFrame, counts: DataFrame) -> DataFrame:
    """The workflow columns of each session: facts next to the command counts of its calls (see ``rollups.workflow``)."""
    names = ["git_commits", "git_pushes", "git_branch_ops", "issue_ops", "pr_ops", "file_edits"]
    met = f.join(counts, "session_id", "left")
    return met.select(
        "session_id", "agent", "steps", "total_tokens", "compactions", "compactions_auto", "compactions_manual", "max_pre_tokens", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names],
        F.col("git_branch").alias("branch"), F.coalesce(F.col("git_branch").isin("main", "master"), F.lit(False)).alias("on_default_branch"), "pr_links",
    )


# Least edits of a session that edits heavily, least steps of a long one.
HEAVY_EDITS, LONG_STEPS = 10, 10


def _workflow_rules() -> dict[str, Column]:
    heavy = F.col("file_edits") >= HEAVY_EDITS
    none = lambda *cs: reduce(lambda x, y: x & y, [F.col(c) == 0 for c in cs])
    return {
        "compact-heavy": F.col("compactions") > 0,
        "uncommitted-work": heavy & none("git_commits"),
        "mainline-editing": F.col("on_default_branch") & heavy & none("git_branch_ops"),
        "untracked-outcomes": (F.col("steps") >= LONG_STEPS) & none("git_commits", "pr_links", "issue_ops", "pr_ops"),
    }


def workflow_totals(w: DataFrame) -> DataFrame:
    auto, known = F.sum("compactions_auto"), F.sum("compactions_auto") + F.sum("compactions_manual")
    z = lambda c: F.coalesce(c, F.lit(0))
    return w.agg(
        F.count("*").alias("sessions"), _count(F.col("compactions") > 0, "sessions_with_compactions"), z(F.sum("compactions")).alias("compactions"), F.when(known > 0, tx.half_up(auto / known, 6)).alias("auto_share"),
        _count(F.col("git_commits") > 0, "sessions_committing"), _count((F.col("file_edits") >= HEAVY_EDITS) & (F.col("git_commits") == 0), "sessions_editing_without_commit"),
    )


def workflow_lints(w: DataFrame) -> DataFrame:
    """``rule, hits, of`` of the rules that some session trips; ``all-clear`` if none."""
    rules = _workflow_rules()
    g = w.agg(F.count("*").alias("of"), *[_count(cond, name) for name, cond in rules.items()])
    rows = g.select("of", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("hits")) for n in rules])).alias("x")).select("x.rule", "x.hits", "of")
    hit = rows.filter("hits > 0")
    none = rows.agg(F.max("hits").alias("k")).filter("k = 0").select(F.lit("all-clear").alias("rule"), F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("of"))
    return hit.unionByName(none)


def workflow_lint_examples(w: DataFrame, most: int = 3) -> DataFrame:
    """``rule, place, session_id``: the first sessions by agent and id that trip each rule."""
    out = None
    for name, cond in _workflow_rules().items():
        top = w.filter(cond).select("agent", "session_id").orderBy("agent", "session_id").limit(most).agg(F.array_sort(F.collect_list(F.struct("agent", "session_id"))).alias("t"))
        rows = top.select(F.lit(name).alias("rule"), F.posexplode("t").alias("place", "x")).select("rule", "place", "x.session_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def model_files(records: DataFrame, lines: DataFrame, f: DataFrame) -> DataFrame:
    """``agent, file_path, raw, model, api_calls, output, started_raw, week``: each model of each file of both agents; stamped ones (``<...>``) are left out."""
    la = a.lines(records)
    ua = a.api_calls(la.withColumn("step_idx", F.lit(0))).filter("model is not null").groupBy("file_path", "model").agg(F.count("*").alias("api_calls"), F.sum("output_tokens").alias("output")).withColumn("agent", F.lit("a"))
    ub = b.model_usage(b.lines(lines)).withColumn("agent", F.lit("b"))
    both = ua.unionByName(ub.select(*ua.columns)).withColumnRenamed("model", "raw").filter("not startswith(raw, '<')")
    when = f.select("agent", "file_path", "started_raw", week_key(micros(F.col("started_raw"))).alias("week"))
    return both.join(when, ["agent", "file_path"]).withColumn("model", tx.display_model(F.col("raw")))


def model_stats(m: DataFrame) -> DataFrame:
    """Each model of each agent: sessions (one per raw entry of a file), calls, output, first and last start, share of the agent's calls, and whether it is its favourite (ties by name)."""
    g = m.groupBy("agent", "model").agg(F.count("*").alias("sessions"), F.sum("api_calls").alias("api_calls"), F.sum("output").alias("output"), F.min("started_raw").alias("first_seen"), F.max("started_raw").alias("last_seen"))
    w = Window.partitionBy("agent")  # a row per model
    return g.withColumns({"share": tx.half_up(F.col("api_calls") / F.sum("api_calls").over(w), 6), "favourite": F.row_number().over(w.orderBy(F.desc("api_calls"), "model")) == 1})


def daily_history(matrix: DataFrame) -> DataFrame:
    """``model, tokens, first_day, last_day`` of a matrix of days (``day``, ``tokens_by_model`` map); stamped models and empty cells are left out."""
    cells = matrix.select("day", F.explode("tokens_by_model").alias("raw", "tokens")).filter("day != '' and not startswith(raw, '<') and tokens > 0")
    return cells.groupBy(tx.display_model(F.col("raw")).alias("model")).agg(F.sum("tokens").alias("tokens"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def daily_span(matrix: DataFrame) -> DataFrame:
    """``days, from_day, to_day`` of the matrix."""
    return matrix.filter("day != '' and tokens_by_model is not null").agg(F.count("*").alias("days"), F.min("day").alias("from_day"), F.max("day").alias("to_day"))


def project_report(f: DataFrame, corrections: DataFrame) -> DataFrame:
    """Usage, volume, totals, sessions per agent and span of each folder.

    ``corrections``: session_id and their number.
    """
    met = f.filter("cwd is not null").join(corrections, "session_id", "left")
    return met.groupBy("cwd").agg(
        F.count("*").alias("sessions"), _count(F.col("agent") == "a", "sessions_a"), _count(F.col("agent") == "b", "sessions_b"), *[F.sum(c).alias(c) for c in [*TOTALS, *USAGE, *VOLUME]],
        F.coalesce(F.sum("corrections"), F.lit(0)).alias("corrections"), F.min("started_raw").alias("first_at"), F.max("started_raw").alias("last_at"),
    )


def volume_shares(f: DataFrame) -> DataFrame:
    """What share of all characters each kind has, in whole percent (0 of nothing)."""
    g = f.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in VOLUME])
    total = reduce(lambda x, y: x + y, [F.col(c) for c in VOLUME])
    pct = lambda c: F.when(total > 0, tx.half_up(F.col(c) / total * 100)).otherwise(0).cast("bigint")
    return g.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("chars"), pct(c).alias("pct")) for c in VOLUME])).alias("x")).select("x.*")


def themes_of(sessions: DataFrame, themes: DataFrame) -> DataFrame:
    """``theme, session_id``: the sessions that each theme names by their short ids.

    Unknown ids are dropped; of sessions that share a short id the last by
    id is meant; themes with fewer than two known sessions are left out.
    """
    known = sessions.groupBy(tx.short_id(F.col("session_id")).alias("short")).agg(F.max("session_id").alias("session_id"))
    met = themes.filter("theme is not null").select("theme", F.explode("sessions").alias("short")).join(known, "short")
    enough = met.groupBy("theme").agg(F.count("*").alias("n")).filter("n >= 2").select("theme")
    return met.join(enough, "theme", "left_semi").select("theme", "session_id")


def steering_samples(f: DataFrame, stats: DataFrame) -> DataFrame:
    """``sample_id, t, prompts, corrections, interruptions`` of the sessions with a readable start."""
    met = f.join(stats.select("session_id", "prompts", "corrections"), "session_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return met.select(F.col("session_id").alias("sample_id"), micros(F.col("started_raw")).alias("t"), z("prompts"), z("corrections"), z("interruptions")).filter("t is not null")
