"""Format A rows (flat, one object per line) to steps, API calls, tool calls and session facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import records as rec
from .ordered import joined, numbered


def lines(raw: DataFrame, needed: list[Column] | None = None, content: Column | None = None) -> DataFrame:
    """Each line of each file once (re-ingested copies are equal), classified.

    With ``needed`` (of the classified columns) only these travel, each
    worked out before the shuffle, from ``content`` (see ``rec.classified``).
    """
    rows = raw.filter("file_path is not null and line_no is not null")
    if needed is not None:
        rows = rec.classified(rows, content).select("file_path", "line_no", "ingested_at", *needed)
    cols = [c for c in rows.columns if c not in ("file_path", "line_no")]
    once = rows.groupBy("file_path", "line_no").agg(F.max_by(F.struct(*cols), F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp_ntz"))).alias("_r")).select("file_path", "line_no", "_r.*")
    return rec.classified(once) if needed is None else once.drop("ingested_at")


def _marks() -> tuple[Column, Column]:
    """Whether a row opens a step, and whether it stands in one even if none was opened before."""
    opens = F.col("row_class").isin("prompt", "command")
    return opens, opens | ((F.col("type") == "assistant") & F.col("message").isNotNull())


def in_steps(lines_: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Adds ``step_idx`` (from 0; null before the first step).

    A prompt or command opens a step; an assistant row before any of them
    opens one without a prompt. ``marks``: the same lines with ``_opens`` and
    ``_acts`` of :func:`stepped`, if these are known.
    """
    if marks is None:
        opens, acts = _marks()
        marks = lines_.select("file_path", "line_no", opens.alias("_opens"), acts.alias("_acts"))
    # Only the numbers are shuffled by order; each query joins them to the columns it needs.
    n = numbered(marks, "file_path", ["line_no"], {"_opened": F.col("_opens"), "_acted": F.col("_acts")})
    first = n.groupBy("file_path").agg(F.max((F.col("_opened") == 0) & (F.col("_acted") > 0)).cast("bigint").alias("_anon"))
    # A row per file: these may be many, so they are never broadcast.
    n = joined(lines_, n.hint("merge").join(first, "file_path"), "file_path", ["line_no"])
    idx = F.when(F.col("_opened") > 0, F.col("_opened") - 1 + F.col("_anon")).when(F.col("_acted") > 0, F.lit(0))
    return n.withColumn("step_idx", idx).drop("_opened", "_acted", "_anon")


def stepped(raw: DataFrame, needed: list[Column]) -> DataFrame:
    """:func:`in_steps` of the :func:`lines` of ``raw`` with the ``needed`` columns; the numbers are made of keys and marks alone."""
    opens, acts = _marks()
    # Only the class of user rows depends on what they hold.
    said_by_users = F.when(F.col("type") == "user", F.col("message.content"))
    return in_steps(lines(raw, needed), lines(raw, [opens.alias("_opens"), acts.alias("_acts")], said_by_users))


def steps(rows: DataFrame) -> DataFrame:
    """One row per step of :func:`in_steps` rows."""
    opens = F.col("row_class").isin("prompt", "command")
    first = F.min(F.when(opens | (F.col("type") == "assistant"), F.struct("line_no", "uuid", "timestamp", "row_class", "text"))).alias("o")
    g = rows.filter("step_idx is not null").groupBy("file_path", "step_idx").agg(first, F.max(F.col("row_class") == "interruption").alias("aborted"), F.count("*").alias("rows"))
    is_cmd = F.col("o.row_class") == "command"
    args = F.nullif(F.regexp_extract("o.text", rec.COMMAND_ARGS, 1), F.lit(""))
    return g.select(
        "file_path", "step_idx", F.col("o.uuid").alias("step_id"), F.when(is_cmd, "command").otherwise("prompt").alias("kind"),
        F.when(is_cmd, F.regexp_extract("o.text", rec.COMMAND_NAME, 1)).alias("command_name"), F.col("o.timestamp").alias("ts_raw"),
        F.when(is_cmd, args).when(F.col("o.row_class") == "prompt", F.col("o.text")).alias("prompt_text"), "aborted", "rows",
    )


def api_calls(rows: DataFrame) -> DataFrame:
    """Each API response once, at its first row, with its usage; a row without any id is a response of its own."""
    said = rows.filter("type = 'assistant' and message is not null")
    key = F.coalesce("message.id", "requestId", "uuid", F.concat(F.lit("row-"), F.col("line_no").cast("string")))
    u = lambda c: F.coalesce(F.col(f"message.usage.{c}"), F.lit(0)).alias(c)
    first = F.min(F.struct("line_no", "step_idx", F.col("message.model").alias("model"), u("input_tokens"), u("output_tokens"), u("cache_read_input_tokens"), u("cache_creation_input_tokens"))).alias("f")
    return said.groupBy("file_path", key.alias("api_key")).agg(first).select("file_path", "api_key", "f.*")


def usage_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls and summed usage per key; total is the sum of the four kinds."""
    s = lambda c, n: F.sum(c).alias(n)
    out = calls.groupBy(*keys).agg(F.count("*").alias("api_calls"), s("input_tokens", "input"), s("output_tokens", "output"), s("cache_read_input_tokens", "cache_read"), s("cache_creation_input_tokens", "cache_creation"))
    return out.withColumn("total", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation"))


def blocks(rows: DataFrame, kind: str) -> DataFrame:
    """The content blocks of one type, with their position, as VARIANT ``b``."""
    v = rec.json_value(F.col("message.content"))
    arr = F.when(F.schema_of_variant(v).startswith("ARRAY"), v.try_cast("array<variant>"))
    return rows.filter("message is not null").select("*", F.posexplode(arr).alias("pos", "b")).filter(F.try_variant_get("b", "$.type", "string") == kind)


def string_member(name: str):
    """A member of ``b`` if it is a JSON string."""
    x = F.try_variant_get("b", f"$.{name}", "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def tool_calls(rows: DataFrame) -> DataFrame:
    b = blocks(rows.filter("type = 'assistant'"), "tool_use").withColumn("call_id", string_member("id")).filter("call_id is not null")
    name = F.coalesce(string_member("name"), F.lit("(unknown)"))
    return b.select("file_path", "line_no", "step_idx", "pos", "call_id", name.alias("name"), tx.server_a(name).isNotNull().alias("is_mcp"), tx.server_a(name).alias("mcp_server"))


def tool_results(rows: DataFrame) -> DataFrame:
    b = blocks(rows.filter("type = 'user'"), "tool_result").withColumn("call_id", string_member("tool_use_id")).filter("call_id is not null")
    err = F.try_variant_get("b", "$.is_error", "variant")
    return b.select("file_path", "line_no", "pos", "call_id", (F.coalesce(F.schema_of_variant(err) == "BOOLEAN", F.lit(False)) & F.coalesce(F.try_variant_get("b", "$.is_error", "boolean"), F.lit(False))).alias("is_error"), tx.preview(string_member("content"), 120).alias("preview"))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with its last result after it (a null preview keeps the one before)."""
    r = results.select(F.col("file_path").alias("_f"), F.col("call_id").alias("_c"), F.struct("line_no", "pos").alias("_at"), F.col("line_no").alias("_l"), "is_error", "preview")
    met = calls.join(r, (F.col("file_path") == F.col("_f")) & (F.col("call_id") == F.col("_c")) & (F.col("_l") > F.col("line_no")), "left")
    keys = [c for c in calls.columns]
    return met.groupBy(*keys).agg(F.max_by("is_error", "_at").alias("is_error"), F.max_by("preview", F.when(F.col("preview").isNotNull(), F.col("_at"))).alias("output_preview"))


def counters(lines_: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return lines_.groupBy("file_path").agg(
        n(F.col("type") == "permission-mode", "permission_mode_changes"), n(F.col("type") == "pr-link", "pr_links"), n((F.col("type") == "queue-operation") & (F.col("operation") == "enqueue"), "queued_prompts"),
        n(F.col("row_class") == "command", "commands"), n(F.col("row_class") == "interruption", "interruptions"), n(F.coalesce("isCompactSummary", F.lit(False)), "compactions"),
    )


def attributes(lines_: DataFrame) -> DataFrame:
    """First folder, branch and version, first and last time in file order, last title, of each file."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    t = lines_.withColumn("timestamp", F.nullif("timestamp", F.lit("")))
    return t.groupBy("file_path").agg(first("cwd").alias("cwd"), first("gitBranch").alias("git_branch"), first("version").alias("cli_version"), first("timestamp").alias("started_raw"), last("timestamp").alias("ended_raw"), last("aiTitle").alias("title"))


def volume(lines_: DataFrame) -> DataFrame:
    """Characters (UTF-16 units) that humans, the harness and tools put into each file.

    An attachment counts with its JSON text; a tool result with its string,
    or the length of its JSON.
    """
    n = lambda c: F.coalesce(tx.utf16_length(c), F.lit(0))
    reminders = F.array_join(F.regexp_extract_all("text", F.lit(r"(<system-reminder>[\s\S]*?</system-reminder>)"), 1), "")
    args = F.nullif(F.regexp_extract("text", rec.COMMAND_ARGS, 1), F.lit(""))
    human = F.when(F.col("row_class") == "prompt", n(F.col("text")) - n(reminders)).when(F.col("row_class") == "command", n(F.coalesce(args, F.regexp_extract("text", rec.COMMAND_NAME, 1)))).otherwise(0)
    harness = F.when(F.col("type") == "attachment", n(F.col("attachment"))).when(F.col("row_class") == "prompt", n(reminders)).when((F.col("type") == "user") & F.coalesce("isMeta", F.lit(False)), n(F.col("text"))).otherwise(0)
    own = lines_.groupBy("file_path").agg(F.sum(human).alias("human_chars"), F.sum(harness).alias("harness_chars"))
    content = F.try_variant_get("b", "$.content", "variant")
    size = F.when(content.isNull(), F.lit(2)).when(F.schema_of_variant(content) == "STRING", n(F.try_variant_get(content, "$", "string"))).otherwise(n(F.to_json(content)))
    tool = blocks(lines_.filter("type = 'user'"), "tool_result").groupBy(F.col("file_path").alias("_f")).agg(F.sum(size).alias("tool_chars"))
    return own.join(tool, F.col("file_path") == F.col("_f"), "left").select("file_path", "human_chars", "harness_chars", F.coalesce("tool_chars", F.lit(0)).alias("tool_chars"))


def responses(rows: DataFrame) -> DataFrame:
    """Text of the assistant rows of each step, joined by line ends; steps without any have no row."""
    t = rows.filter("type = 'assistant' and step_idx is not null and text != ''").groupBy("file_path", "step_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("t"))
    return t.select("file_path", "step_idx", tx.trimmed(F.array_join("t.text", "\n")).alias("response")).filter("response != ''")


def answers(raw: DataFrame) -> DataFrame:
    """``id`` (lower case), ``answer``: the least response of each step id of raw rows, as :func:`steps` and :func:`responses` tell them, in one pass."""
    opens, said = _marks()[0], F.col("type") == "assistant"
    rows = stepped(raw, [F.col("type"), F.col("row_class"), F.when(opens | said, F.col("uuid")).alias("uuid"), F.when(said, F.col("text")).alias("text")])
    # Other rows have no part in either, and no step is without one of these.
    g = rows.filter((opens | said) & F.col("step_idx").isNotNull()).groupBy("file_path", "step_idx").agg(F.min(F.struct("line_no", "uuid")).alias("o"), F.collect_list(F.when(said & (F.col("text") != ""), F.struct("line_no", "text"))).alias("t"))
    response = tx.trimmed(F.array_join(F.array_sort("t").getField("text"), "\n"))
    return g.select(F.lower("o.uuid").alias("id"), response.alias("response")).filter("response != ''").groupBy("id").agg(F.min("response").alias("answer"))


def fork(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The lines kept when each file is forked at a step: ``rows`` plus ``kept``.

    ``anchors``: file_path, step_idx; files without an anchor, or whose step
    doesn't exist, have no rows. Kept is what stands before the next step,
    but for rows of type ``last-prompt``.
    """
    a = anchors.select(F.col("file_path").alias("_f"), F.col("step_idx").alias("_s"))
    known = rows.filter("step_idx is not null").select(F.col("file_path").alias("_f"), F.col("step_idx").alias("_s")).distinct()
    met = rows.join(a.join(known, ["_f", "_s"]), F.col("file_path") == F.col("_f"))
    return met.withColumn("kept", (F.coalesce(F.col("step_idx") <= F.col("_s"), F.lit(True))) & (F.col("type") != "last-prompt")).drop("_f", "_s")


def steps_table(rows: DataFrame) -> DataFrame:
    """The normalized steps of :func:`in_steps` rows, in the columns of the ``steps`` table."""
    s = steps(rows)
    use = usage_by(api_calls(rows), "file_path", "step_idx").select(F.col("file_path").alias("_f"), F.col("step_idx").alias("_s"), "api_calls")
    ids = rows.groupBy("file_path").agg(F.max_by(rec.session_of(), F.when(rec.session_of().isNotNull(), -F.col("line_no"))).alias("session_id")).withColumnRenamed("file_path", "_p")
    met = s.join(use, (F.col("file_path") == F.col("_f")) & (F.col("step_idx") == F.col("_s")), "left").join(ids, F.col("file_path") == F.col("_p"))
    return met.select(
        "session_id", F.coalesce("step_id", F.concat_ws("#", "file_path", "step_idx")).alias("id"), "step_idx", "kind", F.col("command_name").alias("commandName"), F.col("ts_raw").alias("timestamp"), F.lit(None).cast("bigint").alias("durationMs"),
        F.col("prompt_text").alias("promptText"), tx.preview(F.col("prompt_text"), 120).alias("promptPreview"), F.when(F.col("aborted"), True).alias("aborted"), F.coalesce("api_calls", F.lit(0)).alias("apiCalls"),
    )


def calls_table(rows: DataFrame) -> DataFrame:
    """The normalized tool calls of :func:`in_steps` rows, in the columns of the ``tool_calls`` table."""
    inputs = blocks(rows.filter("type = 'assistant'"), "tool_use").select(F.col("file_path").alias("_f"), F.col("line_no").alias("_l"), F.col("pos").alias("_q"), rec.session_of().alias("session_id"), "timestamp", F.coalesce(string_member("input"), F.to_json(F.try_variant_get("b", "$.input", "variant"))).alias("input"))
    c = linked(tool_calls(rows), tool_results(rows))
    sid = steps(rows).select(F.col("file_path").alias("_sf"), F.col("step_idx").alias("_ss"), F.coalesce("step_id", F.concat_ws("#", "file_path", "step_idx")).alias("step_id"))
    met = c.join(inputs, (F.col("file_path") == F.col("_f")) & (F.col("line_no") == F.col("_l")) & (F.col("pos") == F.col("_q"))).join(sid, (F.col("file_path") == F.col("_sf")) & (F.col("step_idx") == F.col("_ss")), "left")
    return met.select("session_id", "step_id", (F.col("line_no") * 1000 + F.col("pos")).alias("call_pos"), F.col("call_id").alias("id"), "name", F.col("is_mcp").alias("isMcp"), F.col("mcp_server").alias("mcpServer"), "input", F.col("output_preview").alias("outputPreview"), F.col("is_error").alias("isError"), "timestamp")
