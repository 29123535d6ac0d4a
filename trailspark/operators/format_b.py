"""Format B lines (envelope and payload) to turns, usage, tool calls and session facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import records as rec
from .ordered import running_counts


def text_of(path: str) -> Column:
    """A payload member if it is a JSON string."""
    x = F.try_variant_get("p", path, "variant")
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def number_of(path: str) -> Column:
    x = F.try_variant_get("p", path, "variant")
    kind = F.schema_of_variant(x)
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), F.try_variant_get(x, "$", "bigint"))


def lines(raw: DataFrame) -> DataFrame:
    """Each line once with its payload as VARIANT ``p`` (null when unreadable) and its payload type ``pt``."""
    once = raw.filter("file_path is not null and line_no is not null").groupBy("file_path", "line_no").agg(F.max(F.struct("timestamp", "type", "payload", "line_id")).alias("r")).select("file_path", "line_no", "r.*")
    return once.withColumn("p", rec.json_value(F.col("payload"))).withColumn("pt", text_of("$.type"))


def is_call() -> Column:
    return (F.col("type") == "response_item") & F.col("pt").isin("function_call", "custom_tool_call") & text_of("$.call_id").isNotNull()


def in_turns(lines_: DataFrame) -> DataFrame:
    """Adds ``turn_idx`` (from 0; null before the first turn).

    ``task_started`` opens a turn; a tool call opens one if none is open.
    """
    started = (F.col("type") == "event_msg") & (F.col("pt") == "task_started")
    flat = lines_.withColumns({"started": F.coalesce(started, F.lit(False)), "called": F.coalesce(is_call(), F.lit(False))}).drop("p")
    n = running_counts(flat, "file_path", ["line_no"], {"_s": F.col("started"), "_a": F.col("started") | F.col("called")})
    first = n.groupBy("file_path").agg(F.max((F.col("_s") == 0) & (F.col("_a") > 0)).cast("bigint").alias("_anon")).withColumnRenamed("file_path", "_fp")
    n = n.join(first, F.col("file_path") == F.col("_fp"))
    idx = F.when(F.col("_s") > 0, F.col("_s") - 1 + F.col("_anon")).when(F.col("_a") > 0, F.lit(0))
    return n.withColumn("turn_idx", idx).drop("_s", "_a", "_anon", "_fp").withColumn("p", rec.json_value(F.col("payload")))


def turns(rows: DataFrame) -> DataFrame:
    """One row per turn.

    Its prompt is the last user message of the turn before (a message that
    comes after the start counts for the next turn, and once); a message
    ``$name args`` is a command; a turn without a duration was aborted.
    """
    said = F.when((F.col("type") == "event_msg") & (F.col("pt") == "user_message"), F.coalesce(text_of("$.message"), text_of("$.text")))
    g = rows.withColumns({"said": said, "turn_id": F.when(F.col("started"), text_of("$.turn_id")), "dur": F.when(F.col("pt") == "task_complete", number_of("$.duration_ms"))})
    # Rows before the first turn are turn -1: what is said there is the first turn's prompt.
    per = g.groupBy("file_path", F.coalesce("turn_idx", F.lit(-1)).cast("bigint").alias("turn_idx")).agg(
        F.max_by("said", F.when(F.col("said").isNotNull(), F.col("line_no"))).alias("said"), F.max("turn_id").alias("turn_id"), F.max_by("dur", F.when(F.col("dur").isNotNull(), F.col("line_no"))).alias("duration_ms"), F.min_by("timestamp", "line_no").alias("ts_raw"), F.count("*").alias("rows"),
    )
    before = per.select(F.col("file_path").alias("_f"), (F.col("turn_idx") + 1).alias("_t"), F.col("said").alias("_said"))
    met = per.filter("turn_idx >= 0").join(before, (F.col("file_path") == F.col("_f")) & (F.col("turn_idx") == F.col("_t")), "left")
    name = F.nullif(F.regexp_extract("_said", r"^\$[\w:.-]+", 0), F.lit(""))
    rest = F.nullif(tx.trimmed(F.expr("substring(_said, length(regexp_extract(_said, '^\\\\$[\\\\w:.-]+', 0)) + 1)")), F.lit(""))
    return met.select(
        "file_path", "turn_idx", F.coalesce("turn_id", F.concat(F.lit("turn-"), F.col("turn_idx").cast("string"))).alias("turn_id"), F.when(name.isNotNull(), "command").otherwise("prompt").alias("kind"), name.alias("command_name"),
        F.when(name.isNotNull(), rest).otherwise(F.col("_said")).alias("prompt_text"), "duration_ms", F.col("duration_ms").isNull().alias("aborted"), "rows",
    )


def cumulative(rows: DataFrame) -> DataFrame:
    """The running totals of the token counts: file, turn, line and the five kinds."""
    u = "$.info.total_token_usage"
    info = rows.filter((F.col("type") == "event_msg") & (F.col("pt") == "token_count")).withColumn("_u", F.try_variant_get("p", u, "variant")).filter(F.schema_of_variant("_u").startswith("OBJECT"))
    n = lambda c: F.coalesce(number_of(f"{u}.{c}"), F.lit(0))
    return info.select(
        "file_path", "turn_idx", "line_no", n("input_tokens").alias("input"), n("output_tokens").alias("output"), n("cached_input_tokens").alias("cache_read"), n("reasoning_output_tokens").alias("reasoning"),
        F.coalesce(number_of(f"{u}.total_tokens"), n("input_tokens") + n("output_tokens")).alias("total"),
    )


KINDS = ["input", "output", "cache_read", "reasoning", "total"]


def turn_usage(rows: DataFrame) -> DataFrame:
    """Usage of each turn: its last running total less the last one before it, at least 0.

    Turns without a token count have used nothing. The last total of each
    turn is one small row, and the one before is found among these.
    """
    from pyspark.sql import Window

    last = cumulative(rows).groupBy("file_path", F.coalesce("turn_idx", F.lit(-1)).cast("bigint").alias("turn_idx")).agg(F.max_by(F.struct(*KINDS), "line_no").alias("u"))
    w = Window.partitionBy("file_path").orderBy("turn_idx")
    prev = F.lag("u").over(w)
    return last.select("file_path", "turn_idx", *[F.greatest(F.lit(0), F.col(f"u.{k}") - F.coalesce(prev[k], F.lit(0))).alias(k) for k in KINDS]).filter("turn_idx >= 0")


def session_usage(rows: DataFrame) -> DataFrame:
    return cumulative(rows).groupBy("file_path").agg(F.max_by(F.struct(*KINDS), "line_no").alias("u")).select("file_path", *[F.col(f"u.{k}").alias(k) for k in KINDS])


def model_usage(lines_: DataFrame) -> DataFrame:
    """Calls and output of each model of each file; a token count belongs to the last model named before it."""
    model = F.when((F.col("type") == "turn_context"), F.concat(text_of("$.model"), F.coalesce(F.concat(F.lit(" ("), text_of("$.effort"), F.lit(")")), F.lit(""))))
    flat = lines_.select("file_path", "line_no", model.alias("model"), ((F.col("type") == "event_msg") & (F.col("pt") == "token_count")).alias("is_count"), F.coalesce(number_of("$.info.last_token_usage.output_tokens"), F.lit(0)).alias("output")).filter("model is not null or is_count")
    n = running_counts(flat, "file_path", ["line_no"], {"_m": F.col("model").isNotNull()})
    # Each run of counts meets the model that opened it.
    named = n.filter("model is not null").select(F.col("file_path").alias("_f"), F.col("_m").alias("_k"), F.col("model").alias("named"))
    met = n.filter("is_count").drop("model").join(named, (F.col("file_path") == F.col("_f")) & (F.col("_m") == F.col("_k")))
    return met.groupBy("file_path", F.col("named").alias("model")).agg(F.count("*").alias("api_calls"), F.sum("output").alias("output"))


def session_meta(lines_: DataFrame) -> DataFrame:
    """Facts of the ``session_meta`` lines of each file, the last one that has them."""
    m = lines_.filter("type = 'session_meta'")
    last = lambda path: F.max_by(text_of(path), F.when(text_of(path).isNotNull(), F.col("line_no")))
    sub = F.coalesce(text_of("$.thread_source") == "subagent", F.lit(False)) | F.try_variant_get("p", "$.source.subagent", "variant").isNotNull()
    return m.groupBy("file_path").agg(last("$.id").alias("session_id"), last("$.cwd").alias("cwd"), last("$.cli_version").alias("cli_version"), last("$.forked_from_id").alias("forked_from_id"), last("$.git.branch").alias("git_branch"), F.max(sub).alias("is_subagent"))


def tool_calls(rows: DataFrame) -> DataFrame:
    """The calls with the preview of their last output after them."""
    name = F.coalesce(text_of("$.name"), F.lit("(unknown)"))
    calls = rows.filter("called").select("file_path", "line_no", "turn_idx", text_of("$.call_id").alias("call_id"), name.alias("name"), tx.server_b(name).isNotNull().alias("is_mcp"), tx.server_b(name).alias("mcp_server"))
    outs = rows.filter((F.col("type") == "response_item") & F.col("pt").isin("function_call_output", "custom_tool_call_output")).select(F.col("file_path").alias("_f"), F.col("line_no").alias("_l"), text_of("$.call_id").alias("_c"), tx.preview(text_of("$.output"), 120).alias("preview")).filter("preview is not null and _c is not null")
    met = calls.join(outs, (F.col("file_path") == F.col("_f")) & (F.col("call_id") == F.col("_c")) & (F.col("_l") > F.col("line_no")), "left")
    return met.groupBy(*calls.columns).agg(F.max_by("preview", "_l").alias("output_preview"))


def volume(lines_: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(tx.utf16_length(c), F.lit(0))
    parts = F.try_variant_get("p", "$.content", "array<variant>")
    text = F.array_join(F.transform(parts, lambda b: F.when(F.schema_of_variant(F.try_variant_get(b, "$.text", "variant")) == "STRING", F.try_variant_get(b, "$.text", "string")).otherwise("")), "")
    item = F.col("type") == "response_item"
    role = text_of("$.role")
    harness = F.when(F.col("type") == "session_meta", n(text_of("$.base_instructions"))).when(item & (F.col("pt") == "message") & ((role == "developer") | ((role == "user") & text.rlike(r"^\s*<"))), n(text)).otherwise(0)
    human = F.when((F.col("type") == "event_msg") & (F.col("pt") == "user_message"), n(F.coalesce(text_of("$.message"), text_of("$.text")))).otherwise(0)
    tool = F.when(item & F.col("pt").isin("function_call_output", "custom_tool_call_output"), n(text_of("$.output"))).otherwise(0)
    return lines_.groupBy("file_path").agg(F.sum(human).alias("human_chars"), F.sum(harness).alias("harness_chars"), F.sum(tool).alias("tool_chars"))


def responses(rows: DataFrame) -> DataFrame:
    said = F.coalesce(text_of("$.message"), text_of("$.text"))
    t = rows.filter((F.col("type") == "event_msg") & (F.col("pt") == "agent_message") & F.col("turn_idx").isNotNull()).withColumn("said", said).filter("said is not null").groupBy("file_path", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("line_no", "said"))).alias("t"))
    return t.select("file_path", "turn_idx", tx.trimmed(F.array_join("t.said", "\n")).alias("response")).filter("response != ''")


def steps_table(rows: DataFrame) -> DataFrame:
    """The normalized steps of :func:`in_turns` rows, in the columns of the ``steps`` table."""
    t = turns(rows)
    use = rows.filter((F.col("type") == "event_msg") & (F.col("pt") == "token_count") & F.col("turn_idx").isNotNull()).groupBy(F.col("file_path").alias("_f"), F.col("turn_idx").alias("_t")).agg(F.count("*").alias("api_calls"))
    first = rows.filter("turn_idx is not null").groupBy(F.col("file_path").alias("_g"), F.col("turn_idx").alias("_u")).agg(F.min_by("timestamp", "line_no").alias("ts"))
    met = t.join(use, (F.col("file_path") == F.col("_f")) & (F.col("turn_idx") == F.col("_t")), "left").join(first, (F.col("file_path") == F.col("_g")) & (F.col("turn_idx") == F.col("_u")))
    return met.select(
        F.col("file_path").alias("session_id"), F.concat_ws("#", "file_path", "turn_id").alias("id"), F.col("turn_idx").alias("step_idx"), "kind", F.col("command_name").alias("commandName"), F.col("ts").alias("timestamp"), F.col("duration_ms").alias("durationMs"),
        F.col("prompt_text").alias("promptText"), tx.preview(F.col("prompt_text"), 120).alias("promptPreview"), F.when(F.col("aborted"), True).alias("aborted"), F.coalesce("api_calls", F.lit(0)).alias("apiCalls"),
    )


def calls_table(rows: DataFrame) -> DataFrame:
    """The normalized tool calls of :func:`in_turns` rows, in the columns of the ``tool_calls`` table."""
    c = tool_calls(rows)
    more = rows.filter("called").select(F.col("file_path").alias("_f"), F.col("line_no").alias("_l"), "timestamp", F.coalesce(text_of("$.arguments"), F.to_json(F.try_variant_get("p", "$.arguments", "variant")), text_of("$.input"), F.to_json(F.try_variant_get("p", "$.input", "variant"))).alias("input"))
    ids = turns(rows).select(F.col("file_path").alias("_g"), F.col("turn_idx").alias("_u"), F.concat_ws("#", "file_path", "turn_id").alias("step_id"))
    met = c.join(more, (F.col("file_path") == F.col("_f")) & (F.col("line_no") == F.col("_l"))).join(ids, (F.col("file_path") == F.col("_g")) & (F.col("turn_idx") == F.col("_u")), "left")
    return met.select(F.col("file_path").alias("session_id"), "step_id", F.col("line_no").alias("call_pos"), F.col("call_id").alias("id"), "name", F.col("is_mcp").alias("isMcp"), F.col("mcp_server").alias("mcpServer"), "input", F.col("output_preview").alias("outputPreview"), F.lit(None).cast("boolean").alias("isError"), "timestamp")
