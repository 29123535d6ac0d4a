"""Rollups and mining over the normalized tables: sessions, steps, tool calls, models, intents, changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.times import micros
from .ordered import running_counts


def calls_once(calls: DataFrame) -> DataFrame:
    """Each call once, with its time in microseconds."""
    rest = [c for c in calls.columns if c not in ("id", "call_pos")]
    return calls.filter("id is not null").groupBy("id").agg(F.max(F.struct("call_pos", *rest)).alias("_r")).select("id", "_r.*").withColumn("us", micros(F.col("timestamp")))


def tool_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("name").agg(F.count("*").alias("calls"), F.count_if(F.coalesce("isError", F.lit(False))).alias("errors"), F.max(F.coalesce("isMcp", F.lit(False))).alias("is_mcp"))


def server_stats(calls: DataFrame) -> DataFrame:
    return calls.filter("mcpServer is not null").groupBy("mcpServer").agg(F.count("*").alias("calls"))


def session_rollup(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """Steps, calls, server calls, errors and span of each session (span null when unknown)."""
    s = steps.groupBy("session_id").agg(F.count("*").alias("steps"), F.coalesce(F.sum("apiCalls"), F.lit(0)).alias("api_calls"), F.min("us").alias("a"), F.max("us").alias("b"))
    c = calls.groupBy("session_id").agg(F.count("*").alias("tool_calls"), F.count_if(F.coalesce("isMcp", F.lit(False))).alias("mcp_calls"), F.count_if(F.coalesce("isError", F.lit(False))).alias("tool_errors"))
    z = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return s.join(c, "session_id", "left").select("session_id", "steps", "api_calls", z("tool_calls"), z("mcp_calls"), z("tool_errors"), F.floor((F.col("b") - F.col("a")) / 1000).alias("duration_ms"))


# Labels that say no more than that something was run; tools that edit files.
GENERIC = ["exec", "wait", "shell", "local_shell", "Bash"]
EDITORS = ["Edit", "Write", "NotebookEdit"]


def tool_sequences(calls: DataFrame, shortest: int = 2, longest: int = 4, least: int = 3, least_sessions: int = 2) -> DataFrame:
    """n-grams of tool labels inside a step that recur: ``sequence, n, count, sessions``.

    The calls of a step, in order of call_pos and id, are numbered by ranges
    (see ``ordered``), so a step may have any number of calls; a call hands
    its label to the starts of the n-grams that it can end or lie in, and
    n-grams are counted before the shuffle.
    """
    lab = tx.with_labels(calls.filter("step_id is not null")).select("session_id", "step_id", "call_pos", "id", "label")
    placed = running_counts(lab, "step_id", ["call_pos", "id"], {"place": F.lit(True)})
    given = placed.select("step_id", "session_id", "label", F.posexplode(F.sequence(F.col("place"), F.col("place") - (longest - 1), F.lit(-1))).alias("k", "at")).filter("at > 0")
    slot = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    n = given.groupBy("step_id", "at").agg(slot(0, "session_id").alias("session_id"), *[slot(k, "label").alias(f"l{k}") for k in range(longest)])
    grams = n.select("session_id", F.explode(F.array(*[F.when(F.col(f"l{k - 1}").isNotNull(), F.array(*[F.col(f"l{i}") for i in range(k)])) for k in range(shortest, longest + 1)])).alias("sequence")).filter("sequence is not null")
    per = grams.groupBy("sequence", "session_id").agg(F.count("*").alias("c"))
    g = per.groupBy("sequence").agg(F.sum("c").alias("count"), F.count("*").alias("sessions"))
    return g.filter((F.col("count") >= least) & (F.col("sessions") >= least_sessions) & F.exists("sequence", lambda x: ~x.isin(GENERIC))).withColumn("n", F.size("sequence").cast("bigint"))


def workflow(calls: DataFrame) -> DataFrame:
    """How often each session committed, pushed, branched, used issues and pull requests, and edited files."""
    cmd = F.col("cmd")
    hit = lambda p, name: F.count_if(F.coalesce(cmd.rlike(p), F.lit(False))).alias(name)
    edits = F.sum(F.coalesce(F.col("name").isin(EDITORS), F.lit(False)).cast("bigint") + F.coalesce(F.col("input").contains(tx.PATCH), F.lit(False)).cast("bigint"))
    # What a command line is searched for.
    return calls.withColumn("cmd", tx.command_text(F.col("input"))).groupBy("session_id").agg(
        hit(r"\bgit\b[^|;&]*\bcommit\b", "git_commits"), hit(r"\bgit\b[^|;&]*\bpush\b", "git_pushes"), hit(r"\bgit\s+(checkout\s+-b|switch\s+-c|worktree\s+add)\b", "git_branch_ops"),
        hit(r"\bgh\s+issue\s+(create|edit|comment)\b", "issue_ops"), hit(r"\bgh\s+pr\s+(create|merge|edit)\b", "pr_ops"), edits.alias("file_edits"),
    )


def first_prompts(steps: DataFrame) -> DataFrame:
    """The first non-blank prompt of each session and its intent."""
    p = steps.filter((F.col("kind") == "prompt") & (tx.trimmed(F.col("promptText")) != "") & F.col("session_id").isNotNull())
    first = p.groupBy("session_id").agg(F.min(F.struct("step_idx", "id", "promptText")).alias("f"))
    return first.select("session_id", F.col("f.id").alias("step_id"), tx.preview(F.col("f.promptText"), 100).alias("preview"), tx.intent(F.col("f.promptText")).alias("intent"))


def dominant(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, its count, the total and its share; ties by value."""
    per = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    g = per.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("t"), F.sum("n").alias("total"))
    return g.select(*group, F.col("t.v").alias(value), (-F.col("t.m")).alias("n"), "total", tx.half_up(-F.col("t.m") / F.col("total"), 6).alias("share"))


def switches(weekly: DataFrame, period: str, value: str) -> DataFrame:
    """Where the dominant value differs from that of the period before: one small row per period."""
    w = Window.orderBy(period)
    return weekly.select(period, F.lag(value).over(w).alias("from_value"), F.col(value).alias("to_value")).filter("from_value is not null and from_value != to_value")


def before_after(changes: DataFrame, samples: DataFrame, k: int, sums: tuple[str, ...] = ("prompts", "corrections")) -> DataFrame:
    """The ``k`` samples before and from each change: ``change_id, side, sessions`` and the ``sums``.

    ``changes``: change_id, t; ``samples``: sample_id, t and whole numbers
    to sum; rows without a time are left out. Samples are numbered by time
    once, and a change takes the ranks next to its place, so no pair of all
    changes and all samples is made. With ``k`` of 0 both sides are empty.
    """
    flat = samples.filter("t is not null").select("t", F.lit(1).alias("is_sample"), F.col("sample_id").cast("string").alias("sid"), *sums, F.lit("all").alias("g"))
    marks = changes.filter("t is not null").select("t", F.lit(0).alias("is_sample"), F.col("change_id").cast("string").alias("sid"), *[F.lit(None).cast("bigint").alias(c) for c in sums], F.lit("all").alias("g"))
    # At equal times a change stands before the samples, which so count as after it.
    n = running_counts(flat.unionByName(marks), "g", ["t", "is_sample", "sid"], {"place": F.col("is_sample") == 1})
    around = n.filter("is_sample = 0").select(F.col("sid").alias("change_id"), F.explode(F.sequence(F.col("place") - (k - 1), F.col("place") + k) if k > 0 else F.array().cast("array<bigint>")).alias("at"), F.col("place").alias("p")).withColumn("side", F.when(F.col("at") <= F.col("p"), "before").otherwise("after"))
    met = around.join(n.filter("is_sample = 1").select(F.col("place").alias("at"), *sums), "at")
    return met.groupBy("change_id", "side").agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in sums])


def efficacy(changes: DataFrame, samples: DataFrame, k: int) -> DataFrame:
    """:func:`before_after` with the rates of corrections and interruptions per prompt (null without prompts)."""
    g = before_after(changes, samples, k, ("prompts", "corrections", "interruptions"))
    per = lambda c: F.when(F.col("prompts") > 0, tx.half_up(F.col(c) / F.col("prompts"), 6))
    return g.select("change_id", "side", "sessions", "prompts", per("corrections").alias("correction_rate"), per("interruptions").alias("interruption_rate"))


def first_of_forks(steps: DataFrame) -> DataFrame:
    """Steps once per id and excerpt, as forked transcripts repeat them: that of the newest session, by its last time and id."""
    key = F.struct("session_last", "session_id")
    last = steps.groupBy(F.col("session_id").alias("_s")).agg(F.max("us").alias("session_last"))
    seen = steps.join(last, F.col("session_id").eqNullSafe(F.col("_s")), "left")
    return seen.groupBy("id", tx.preview(F.col("promptText"), 600).alias("excerpt")).agg(F.max(key).alias("k"), F.count("*").alias("copies")).select("id", "excerpt", F.col("k.session_id").alias("session_id"), "copies")


def newest(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in an order.

    Spark keeps only ``k`` rows of a group in each task before the shuffle
    (a rank filter over a window), so no group is gathered whole.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def longest_prefix(rows: DataFrame, value: Column, keys: DataFrame, key: str) -> DataFrame:
    """Adds ``matched``: the longest key that equals the value or precedes a ``-`` in it; null if none.

    A value's candidates are its own prefixes at ``-``, so an equi-join finds
    them, however many keys there are.
    """
    v = rows.select(value.alias("_v")).filter("_v is not null").distinct()
    pre = v.select("_v", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("_v", "-"))), lambda i: F.array_join(F.slice(F.split(F.col("_v"), "-"), F.lit(1), i), "-"))).alias("_k"))
    best = pre.join(keys.select(F.lower(key).alias("_k")).distinct(), "_k").groupBy("_v").agg(F.max_by("_k", F.length("_k")).alias("matched"))
    return rows.withColumn("_own", value).join(best, F.col("_own") == F.col("_v"), "left").drop("_own", "_v")


def compared(report: DataFrame, a: str, b: str, metrics: list[str]) -> DataFrame:
    """Metric rows ``metric, a, b, delta, delta_pct`` of two sessions of a report."""
    stack = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")
    long = report.filter(F.col("session_id").isin(a, b)).select("session_id", stack).select("session_id", "x.*")
    g = long.groupBy("metric").agg(F.max(F.when(F.col("session_id") == a, F.col("v"))).alias("a"), F.max(F.when(F.col("session_id") == b, F.col("v"))).alias("b"))
    return g.withColumn("delta", F.col("b") - F.col("a")).withColumn("delta_pct", F.when(F.col("a") != 0, tx.half_up((F.col("b") - F.col("a")) / F.col("a") * 100, 2)))
